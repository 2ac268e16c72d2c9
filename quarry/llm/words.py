"""A dictionary of words with costs, and the cheapest split of a text into its words."""

from __future__ import annotations

import json
import math
import os
import re

#: Folder of public tokenizer files; only their vocabularies are read.
TOKENIZER_DIR = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")

# Words of programs that a general vocabulary lacks or ranks low.
_PROGRAM_WORDS = "api auth config db env init kv param passwd password pwd svc tmp url uri async str int bool uuid username userid changeme passphrase webhook".split()


def dictionary(folder: str = TOKENIZER_DIR, least: int = 3) -> dict[str, float]:
    """Word to cost, the logarithm of its rank, from the whole words of a public vocabulary; at most its 49,408 entries."""
    vocab = json.load(open(f"{folder}/word_bpe_49k.json", encoding="utf-8"))["model"]["vocab"]
    ranks = {t[:-4]: i for t, i in vocab.items() if t.endswith("</w>") and len(t) - 4 >= least and t[:-4].isalpha() and t.isascii()}
    out = {w: math.log(2 + i) for w, i in ranks.items()}
    for w in _PROGRAM_WORDS:
        out.setdefault(w, math.log(20_000))
    return out


_PARTS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def residual(text: str, words: dict[str, float], longest: int = 18, unknown: float = 14.0) -> int:
    """Characters that the cheapest segmentation into dictionary words leaves unexplained.

    Viterbi over each alphabetic hump: a word costs the logarithm of its rank, a
    letter outside of words `unknown`. Blanks and the separators - _ . : / ,
    between words are explained; digits and other signs are not.
    """
    left = 0
    for part in _PARTS.findall(text):
        if part.isalpha() and part.isascii():
            low = part.lower()
            if low in words:
                continue
            for hump in _HUMPS.findall(part):
                left += _unexplained(hump.lower(), words, longest, unknown)
        elif part not in "-_.:/, \t":
            left += 1
    return left


def _unexplained(s: str, words: dict[str, float], longest: int, unknown: float) -> int:
    if s in words:
        return 0
    n = len(s)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, n + 1):
        c, u = best[i - 1]
        top = (c + unknown, u + 1)
        for j in range(max(0, i - longest), i - 2):
            w = words.get(s[j:i])
            if w is not None:
                c, u = best[j]
                if c + w < top[0]:
                    top = (c + w, u)
        best.append(top)
    return best[n][1]
