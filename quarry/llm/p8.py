"""Problem 8: texts that were cut, and how often each source cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.endings import ending
from quarry.session import materialize
from quarry.tables import table

#: Texts that must end with the same shape for it to count as a whole line, and how much commoner a longer one must be to outweigh it.
RECURS, OUTWEIGHS = 2, 5
#: Most bytes of rows that are sent to every worker; larger tables are joined by a shuffle.
SENT_BYTES = 16 << 20


def _classify(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, verdict, unit, shape, whole = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                e = ending(t) if t else None
                if e is None or e[0] == "complete":
                    continue
                v, u, s = e
                if v == "list" and len(u) < LEAST_ENTRY:
                    v = "cut"
                take.append(i)
                verdict.append(v)
                unit.append(u)
                shape.append(s)
                whole.append(len(t.rstrip()))
            if take:
                cols = [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.string()) for x in (verdict, unit, shape)), pa.array(whole, pa.int64())]
                yield pa.record_batch(cols, names=[key, "verdict", "unit", "shape", "chars"])

    return df.select(key, text).mapInArrow(judge, f"`{key}` {kind}, verdict string, unit string, shape string, chars bigint")


#: Characters of the shortest list entry; fewer are the beginning of one.
LEAST_ENTRY = 4


def _step(length: Column) -> Column:
    """The number of the prefix of 2^i characters by which a text meets longer ones: the greatest that fits it."""
    return F.floor(F.log2(length.cast("double") + 0.25)).cast("int")


def _head(text: Column, step: Column) -> Column:
    return F.xxhash64(F.substring(text, F.lit(1), F.call_function("shiftleft", F.lit(1), step)), step)


def _heads(rows: DataFrame, text: str) -> DataFrame:
    """The rows with each `p` and the hash `h` of that prefix, for all prefixes shorter than the text."""
    m = F.length(text)
    return rows.filter(m > 1).withColumn("p", F.explode(F.sequence(F.lit(0), _step(m - 1)))).withColumn("h", _head(F.col(text), F.col("p")))


def _mark(text: Column, n: Column) -> Column:
    """128 bits of the first n characters."""
    part = F.substring(text, F.lit(1), n)
    return F.struct(F.xxhash64(part, n).alias("a"), F.xxhash64(n, part).alias("b"))


def _small(df: DataFrame) -> DataFrame:
    """The rows of a written table with a broadcast hint if their strings and numbers sum to at most `SENT_BYTES`."""
    size = sum((F.octet_length(c) if t == "string" else F.size(c) * 4 if t.startswith("array") else F.lit(16)) + 16 for c, t in df.dtypes)
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= SENT_BYTES else df


def longer_copies(short: DataFrame, rows: DataFrame, goes_on: Column) -> DataFrame:
    """The distinct `s` of `short` that are strict prefixes of a text `t` of `rows`, which goes on as `goes_on` says.

    short: s. rows: t, and whatever else. goes_on: a condition on `s_end`, the
    last common character, and `t_next`, the one after it. Empty and null texts
    meet nothing.

    Texts meet by the hash of a fixed-length prefix first, without being paired:
    for each such prefix the lengths of the short texts that begin with it are
    known, at most as many as the prefix is long, and a longer text gives the
    128-bit hash of its own prefix of each of these lengths. A prefix that many
    texts share costs each of them one row a length, never a pair of texts.
    """
    n = F.length("s")
    own = short.filter(n > 0).select("s", n.alias("n")).distinct().withColumn("p", _step(F.col("n")))
    lengths = own.groupBy("p", _head(F.col("s"), F.col("p")).alias("h")).agg(F.collect_set("n").alias("lengths"))
    lengths = _small(materialize(lengths, "lengths"))
    met = _heads(rows, "t").join(lengths, ["p", "h"]).select("t", F.explode("lengths").alias("n")).filter(F.col("n") < F.length("t"))
    met = met.withColumn("s_end", F.substring(F.col("t"), F.col("n"), F.lit(1))).withColumn("t_next", F.substring(F.col("t"), F.col("n") + 1, F.lit(1)))
    seen = met.filter(goes_on).select(_mark(F.col("t"), F.col("n")).alias("k")).distinct()
    marks = own.withColumn("k", _mark(F.col("s"), F.col("n")))
    return marks.join(seen, "k", "left_semi").select("s")


def longer_units(units: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """The distinct `unit`s that are strict prefixes of a sentence or line elsewhere; a number that goes on as a longer number is none."""
    starts = df.select(F.explode(F.split(F.col(text), r"(?<=[.!?])\s+|\n\s*(?:[-*+]\s+|\d+[.)]\s+)?")).alias("t"))
    goes_on = ~(F.col("s_end").rlike("^[0-9]$") & F.col("t_next").rlike("^[0-9]$"))
    return longer_copies(units.select(F.col("unit").alias("s")), starts, goes_on).select(F.col("s").alias("unit"))


def longer_texts(cand: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of `cand` whose whole text, without blanks at its end, is a strict prefix of another text that goes on in the same line."""
    rows = df.select(F.col(key), F.col(text).alias("t"))
    ids = _small(cand.select(key).distinct())
    own = rows.join(ids, key, "left_semi").select(key, F.rtrim("t").alias("s"))
    found = longer_copies(own, rows.select("t"), F.col("t_next").rlike(r"[^\s0-9]"))
    return own.join(found.select(_mark(F.col("s"), F.length("s")).alias("k")), _mark(F.col("s"), F.length("s")) == F.col("k"), "left_semi").select(key)


def cut_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the texts that stop within a word, a sentence or a code block.

    A text whose end leaves the matter open is settled by the rest of the
    corpus: it is cut if its last line is a strict prefix of a longer sentence
    or line elsewhere, if its whole text is a strict prefix of a text that goes
    on in the same line, or if the shape of its last line never recurs. A text that is a prefix of a longer one but ends
    complete is not cut. Null, empty and blank texts give no row.
    """
    ends = materialize(_classify(df, key, text), "ends")  # every text is judged once
    opens = ends.filter("verdict = 'open'")
    shapes = opens.groupBy("shape").agg(F.count_distinct("chars", "unit").alias("texts"))
    outweighed = _outweighed(shapes)
    whole = shapes.join(outweighed, "shape", "left").filter((F.col("texts") >= RECURS) & (F.coalesce("n", F.lit(0)) < OUTWEIGHS * F.col("texts"))).select("shape")
    by_shape = opens.join(whole, "shape", "left_anti").select(key)
    unsure = ends.filter("verdict <> 'cut'")
    by_unit = unsure.join(longer_units(unsure.filter(F.length("unit") >= LEAST_ENTRY), df, text), "unit", "left_semi").select(key)
    by_text = longer_texts(unsure, df, key, text)
    return ends.filter("verdict = 'cut'").select(key).unionByName(by_shape).unionByName(by_unit).unionByName(by_text).distinct()


def _outweighed(shapes: DataFrame) -> DataFrame:
    """(shape, n): the most texts that a longer shape has which begins with the shape.

    Each longer shape gives one row for each length, of those that occur under
    the same beginning, as in `longer_copies`.
    """
    n = F.length("shape")
    own = shapes.filter(n > 0).withColumn("p", _step(n))
    lengths = own.groupBy("p", _head(F.col("shape"), F.col("p")).alias("h")).agg(F.collect_set(n).alias("lengths"))
    met = _heads(shapes, "shape").join(lengths, ["p", "h"]).select("shape", "texts", F.explode("lengths").alias("m")).filter(F.col("m") < n)
    return met.groupBy(F.substring(F.col("shape"), F.lit(1), F.col("m")).alias("shape")).agg(F.max("texts").alias("n"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a text, cut ones and their share for each source."""
    docs = table(spark, folder, "documents")
    cut = cut_texts(docs, "doc_id", "text").withColumn("cut", F.lit(1))
    own = docs.filter(F.length("text") > 0).select("doc_id", "source")
    return own.join(cut, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("cut").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
