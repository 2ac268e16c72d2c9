"""Problem 4: source files that do not parse, one by one and as rates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.syntax import SUFFIXES, language_of, problem
from quarry.tables import table


def unparsable(df: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """(key, language, problem) of every row whose content is not valid in the language of its path's suffix.

    Null paths and contents and suffixes of other languages give no row; an
    empty content is wrong only in Go. Rows repeated in `df` are repeated here.
    """
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, take, langs, found = batch.column(0), [], [], []
            for i, (p, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lang = language_of(p)
                what = problem(lang, text)
                if what:
                    take.append(i)
                    langs.append(lang)
                    found.append(what)
            if take:
                yield pa.record_batch([ids.take(pa.array(take, pa.int64())), pa.array(langs, pa.string()), pa.array(found, pa.string())], names=[key, "language", "problem"])

    return df.select(key, path, content).mapInArrow(judge, f"`{key}` {kind}, language string, problem string")


def suffix_language(path: F.Column) -> F.Column:
    suffix = F.lower(F.substring_index(path, ".", -1))
    return F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return unparsable(table(spark, folder, "files"), "file_id", "path", "content").select("file_id").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, unparsable files and their rate by repository and language, beside the counters of the repository's scans."""
    files = table(spark, folder, "files")
    bad = unparsable(files, "file_id", "path", "content").select("file_id").distinct().withColumn("bad", F.lit(1))
    own = files.select("file_id", "repo_id", suffix_language(F.col("path")).alias("language")).distinct()
    rates = (
        own.join(bad, "file_id", "left")
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("unparsable"))
    )
    scans = (
        table(spark, folder, "scans")
        .select("scan_id", "repo_id", "files_parsed", "files_skipped")
        .distinct()
        .groupBy("repo_id")
        .agg(F.sum(F.col("files_parsed").cast("bigint")).alias("files_parsed"), F.sum(F.col("files_skipped").cast("bigint")).alias("files_skipped"))
    )
    return rates.join(scans, "repo_id", "left").select("repo_id", "language", "files", "unparsable", F.round(F.col("unparsable") / F.col("files"), 6).alias("rate"), "files_parsed", "files_skipped")
