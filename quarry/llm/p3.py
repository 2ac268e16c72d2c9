"""Problem 3: generated, minified or vendored source files and data under a source suffix."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.syntax import SUFFIXES, language_of
from quarry.tables import table

LANGUAGES = tuple(sorted(set(SUFFIXES.values())))
#: Characters of the models: letters without case, one sign for any digit, _ and $, the two ends of a name, and one for all else.
_SIGNS = 32
_START, _END, _ELSE = 29, 30, 31
_CLASS = bytearray([_ELSE] * 256)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i
for _i in range(10):
    _CLASS[48 + _i] = 26
_CLASS[95], _CLASS[36], _CLASS[94], _CLASS[10] = 27, 28, _START, _END
_CLASS = bytes(_CLASS)
CODES = _SIGNS**3
_THIRD = np.arange(CODES) % _SIGNS
_FIRST = np.arange(CODES) // _SIGNS**2
_SECOND = np.arange(CODES) // _SIGNS % _SIGNS
#: Trigrams within a name.
_INSIDE = (_FIRST != _END) & (_SECOND != _END) & (_THIRD != _START)

_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'')
_DIGITS = re.compile(r"\d+")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{200,}")

# How the notes of generators begin, in the languages they are written in.
_GENERATED = re.compile(
    r"(?i)^\s*(?://+|#+|/\*+!?|\*|--|<!--|;|%)\s*(?:[-=*]+\s*)?(?:code generated\b|@generated\b|auto-?generated\b|automatically generated\b|generated (?:file|code|by|from|automatically)\b|this (?:file|code|class) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created|produced)\b|machine[- ]made\b|machine[- ]generated\b|<auto-?generated|automatisch (?:erzeugt|generiert|erstellt)\b|(?:fichier|code) (?:produit|généré|genere|cree|créé)\b|(?:archivo|código|codigo) generado\b|generado (?:por|automáticamente)\b|.{0,60}\b(?:manual (?:edits|changes)|edits|changes) (?:are|will be) (?:overwritten|lost)\b|.{0,60}\bdo not edit\b\.?\s*(?:\*/)?\s*$)"
)
_BY_HAND = re.compile(r"(?i)\b(?:by hand|hand-?written|manually (?:written|maintained))\b")
# How the notes of a third party's rights and origin read.
_FOREIGN = re.compile(
    r"(?i)^\s*(?://+|#+|/\*+!?|\*|--|;)\s*(?:copyright (?:\(c\)|©)?\s*[\d ,-]+(?:the )?[\w .-]+ (?:authors|contributors|project|foundation|developers|team)\b|part of the [\w .-]+ project\b|(?:released|licensed|distributed|available|redistributed) under (?:the|an?) |spdx-license-identifier|use of this source (?:code )?is governed by|redistribution\b.*\bpermitted|permission is hereby granted|(?:adapted|copied|taken|ported|vendored|derived|forked|borrowed) from (?!the\b)\S+ v?\d|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?(?:[-+]\S+)?\s*(?:\*/)?\s*$)"
)
_OWN_NOTE = re.compile(r"(?i)all rights reserved|internal use only|confidential|proprietary")

#: Distinct blocks of three lines' shapes among all below which names and lines follow a template, and the repeated ones it takes.
LOW_DIVERSITY, LEAST_REPEATS = 0.42, 4
#: Bits a character above which names are no names but encoded bytes; and, for short names, mangled.
BYTES_BITS, MANGLED_BITS, MANGLED_LENGTH, MANGLED_NAMES = 3.6, 2.4, 4.6, 8
#: Share of a file in unbroken encoded runs, or in digits, that makes it data.
BLOB_SHARE, DIGIT_SHARE = 0.6, 0.25


def _names(text: str) -> bytes:
    """The distinct names of a file, each between its ends."""
    found = set(_NAME.findall(text))
    return ("^^" + "\n^^".join(sorted(found)) + "\n").encode("latin-1", "replace") if found else b""


def _codes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw.translate(_CLASS), np.uint8).astype(np.int32)
    return (a[:-2] * _SIGNS + a[1:-1]) * _SIGNS + a[2:] if len(a) > 2 else np.zeros(0, np.int32)


def name_models(df: DataFrame, path: str, content: str) -> dict[str, np.ndarray]:
    """For each language the bits of each trigram of its names, trained on all files.

    Every file counts each of its names once. The driver gets sums of at most
    32^3 trigrams a language, whatever the number of files.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {l: np.zeros(CODES, np.int64) for l in LANGUAGES}
        for batch in batches:
            parts: dict[str, list[bytes]] = {l: [] for l in LANGUAGES}
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang = language_of(p)
                if lang and text:
                    parts[lang].append(_names(text))
            for lang, raws in parts.items():
                if raws:
                    sums[lang] += np.bincount(_codes(b"".join(raws)), minlength=CODES)
        for i, lang in enumerate(LANGUAGES):
            at = np.flatnonzero(sums[lang])
            yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[lang][at])], names=["lang", "code", "n"])

    rows = df.select(path, content).mapInArrow(count, "lang int, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for i, lang in enumerate(LANGUAGES):
        own = rows[rows["lang"] == i]
        n = np.zeros(CODES)
        n[own["code"].to_numpy()] = own["n"].to_numpy()
        n *= _INSIDE
        before = n.reshape(-1, _SIGNS).sum(axis=1)
        bits = -np.log2((n + 0.1) / (np.repeat(before, _SIGNS) + 0.1 * _SIGNS))
        bits[~_INSIDE] = 0
        out[lang] = bits.astype(np.float32)
    return out


_COMMENT = re.compile(r"(?m)^[ \t]*(?://|#|/\*|\*|--|<!--|;|%)[^\n]*")


def _notes(text: str) -> list[str]:
    """All lines of the file that are nothing but a comment, where notes about a file stand."""
    return _COMMENT.findall(text)


def _judge(text: str, raw: bytes, bits: np.ndarray) -> str | None:
    notes = _notes(text)
    if any(_GENERATED.match(x) and not _BY_HAND.search(x) for x in notes):
        return "generated"
    if any(_FOREIGN.match(x) and not _OWN_NOTE.search(x) for x in notes):
        return "vendored"
    codes = _codes(raw)
    inside = int(_INSIDE[codes].sum())
    entropy = float(bits[codes].sum()) / inside if inside else 0.0
    names = raw.count(b"\n")
    length = (len(raw) - 3 * names) / names if names else 0.0
    blob = sum(len(x) for x in _BLOB.findall(text))
    digits = sum(map(text.count, "0123456789"))
    if blob > BLOB_SHARE * len(text) or digits > DIGIT_SHARE * len(text) or (entropy > BYTES_BITS and names >= MANGLED_NAMES):
        return "data"
    if names >= MANGLED_NAMES and length < MANGLED_LENGTH and entropy > MANGLED_BITS and "(" in _COMMENT.sub("", text):
        return "minified"
    shape = _DIGITS.sub("0", _NAME.sub("w", _STRING.sub("s", text)))
    lines = [x for x in map(str.strip, shape.split("\n")) if x]
    blocks = list(zip(lines, lines[1:], lines[2:], strict=False))
    distinct = len(set(blocks))
    if len(blocks) - distinct >= LEAST_REPEATS and distinct < LOW_DIVERSITY * len(blocks):
        return "generated" if shape.count("w") > 0.04 * len(shape) and any(c in shape for c in "({") and "{" + "w" not in shape else "data"
    return None


def not_hand_written(df: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """(key, kind) of the files nobody wrote by hand here: generated, minified, vendored or data.

    Models of the names of each language are trained on all files first. Names
    that are short and cost many bits are mangled, names that cost more are
    encoded bytes; blocks of lines of few distinct shapes come from a template.
    Notes of generators and of a third party's rights count where such notes
    stand, as comments, not as words in the code. Null, empty and blank
    contents, and suffixes of no known language, give no row.
    """
    models = df.sparkSession.sparkContext.broadcast(name_models(df, path, content))  # 5 x 32^3 floats
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in batches:
            take, kinds = [], []
            for i, (p, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lang = language_of(p)
                if lang is None or not text or not text.strip():
                    continue
                what = _judge(text, _names(text), known[lang])
                if what:
                    take.append(i)
                    kinds.append(what)
            if take:
                yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string())], names=[key, "kind"])

    return df.select(key, path, content).mapInArrow(judge, f"`{key}` {kind}, kind string")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_hand_written(table(spark, folder, "files"), "file_id", "path", "content").select("file_id").distinct()


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each kind by repository; kind 'hand' is what remains."""
    files = table(spark, folder, "files")
    found = not_hand_written(files, "file_id", "path", "content").groupBy("file_id").agg(F.min("kind").alias("kind"))
    own = files.select("file_id", "repo_id").distinct()
    return own.join(found, "file_id", "left").groupBy("repo_id", F.coalesce("kind", F.lit("hand")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))
