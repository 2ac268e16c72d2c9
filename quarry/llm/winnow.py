"""Winnowing: fingerprints that guarantee every sufficiently long shared span, and their extension.

Of the hashes of all k-grams of words, the smallest in each window of `WINDOW`
consecutive ones is kept. Two texts that share `K + WINDOW - 1` words in a row
therefore share a fingerprint.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np

#: Words in a gram and grams in a window: any shared run of K + WINDOW - 1 = 7 words has a common fingerprint.
K, WINDOW = 5, 3

_BREAKS = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_OTHER = re.compile(r"[^\w]|_")
_HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(K)]
_HASH_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[bytes]:
    """Runs of letters and digits in small letters; all else only parts them."""
    if not text.isascii():
        text = _OTHER.sub(" ", _HIDDEN.sub("", text))
    return text.lower().encode("utf-8", "replace").translate(_BREAKS).split()


class Codes(dict):
    """Word to a stable 64-bit code; forgets all when it grows beyond a million words, which changes no code."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = (zlib.crc32(word) << 32 | zlib.crc32(word, 0x5BD1E995)) or 1
        self[word] = code
        return code


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the K-gram that starts at each position; a gram over a 0, which parts texts, has the greatest hash."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    apart = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for i in range(K):
            part = codes[i : i + n]
            out = (out ^ part) * _MIX[i]
            out ^= out >> np.uint64(29)
            apart |= part == 0
    out[apart] = _HASH_MAX
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the rightmost smallest hash of each window, texts shorter than a window included."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    if n < WINDOW:
        keep[n - 1 - int(np.argmin(hashes[::-1]))] = True
    else:
        m = n - WINDOW + 1
        best, at = hashes[:m].copy(), np.zeros(m, np.int64)
        for i in range(1, WINDOW):
            part = hashes[i : i + m]
            low = part <= best
            best[low] = part[low]
            at[low] = i
        keep[np.arange(m) + at] = True
    keep &= hashes != _HASH_MAX
    return np.flatnonzero(keep)


def longest_carry(doc: Sequence[bytes], item: Sequence[bytes], chunk_end: Sequence[int], p: int, q: int, apart: int = 7) -> int:
    """Words of `item` that `doc` carries in one stretch through the common word at (p, q).

    The stretch may pass over single words of the item that are lost or replaced
    in the document, if at least `apart` common words lie between two of them.
    chunk_end: for each word of the item, where the blank-separated word ends that it belongs to.
    """
    a, b = p, q
    while a and b and doc[a - 1] == item[b - 1]:
        a, b = a - 1, b - 1
    total = _forward(doc, item, chunk_end, a, b, apart)
    n, m = len(doc), len(item)
    first = _run(doc, item, a, b)
    reach = 7 * (b + 1)  # no step passes over more than six words of the document for a word of the item
    rdoc, ritem = doc[max(0, a - reach) : a][::-1], item[:b][::-1]
    ends = [m - s for s in _starts(chunk_end)[::-1]]
    rend = [_end_of(i, ends) for i in range(m - b, m)]
    back = _backward(rdoc, ritem, [e - (m - b) for e in rend], apart, first)
    return total + back if n else 0


def _starts(chunk_end: Sequence[int]) -> list[int]:
    return [0, *sorted(set(chunk_end))[:-1]] if chunk_end else []


def _end_of(i: int, ends: list[int]) -> int:
    return next(e for e in ends if e > i)


def _run(doc: Sequence[bytes], item: Sequence[bytes], a: int, b: int) -> int:
    k, n = 0, min(len(doc) - a, len(item) - b)
    while k < n and doc[a + k] == item[b + k]:
        k += 1
    return k


def _step(doc: Sequence[bytes], item: Sequence[bytes], ends: Sequence[int], a: int, b: int) -> tuple[int, int, int] | None:
    """Over one lost or replaced word of the item at b: the next common run of three words or more."""
    nb = ends[b]
    for da in range(0, 7):
        k = _run(doc, item, a + da, nb)
        if k >= 3:
            return a + da, nb, k
    return None


def _forward(doc: Sequence[bytes], item: Sequence[bytes], ends: Sequence[int], a: int, b: int, apart: int) -> int:
    total, k, errors = 0, _run(doc, item, a, b), 0
    while True:
        total += k
        a, b = a + k, b + k
        if b >= len(item) or (errors and k < apart):
            return total
        start = b
        while start and ends[start - 1] > b:  # a replaced word that begins alike
            start -= 1
        if b - start >= k:
            start = b
        step = _step(doc, item, ends, a - (b - start), start)
        if step is None:
            return total
        a, b, k = step
        errors += 1


def _backward(doc: Sequence[bytes], item: Sequence[bytes], ends: Sequence[int], apart: int, first: int) -> int:
    """Words before the stretch, read backwards; its first run must be long enough to pass over another word."""
    total, a, b, k = 0, 0, 0, first
    while b < len(item) and k >= apart:
        step = _step(doc, item, ends, a, b)
        if step is None:
            break
        a, b, k = step
        total += k
        a, b = a + k, b + k
    return total
