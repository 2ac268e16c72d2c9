"""How much of a tree was read, by language and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages with an extractor; each supports all stages.
SUPPORTED = ["Go", "Python", "Rust", "C#"]
#: Stages in the order in which a file passes them; one is tried only where the one before succeeded.
STAGES = ["parse", "structural", "semantic"]


def language_coverage(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, files, supported, attempted, succeeded, failed) of the parse; files need `parsed`, true, false or null if not tried."""
    known = F.col("language").isin(*SUPPORTED)
    out = files.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("files"), F.bool_or(known).alias("supported"), F.count_if(known & F.col("parsed").isNotNull()).alias("attempted"), F.count_if(known & F.coalesce("parsed", F.lit(False))).alias("succeeded")
    )
    return out.withColumn("failed", F.col("attempted") - F.col("succeeded"))


def stage_coverage(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, stage, files, supported, attempted, succeeded) for all three stages.

    files: language and a column for each stage, true, false or null if not
    tried. A stage counts as tried only where the stage before it succeeded.
    """
    known = F.col("language").isin(*SUPPORTED)
    before, parts = F.lit(True), []
    for stage in STAGES:
        tried = known & before & F.col(stage).isNotNull()
        parts.append(F.struct(F.lit(stage).alias("stage"), F.coalesce(known, F.lit(False)).alias("supported"), F.coalesce(tried, F.lit(False)).alias("tried"), F.coalesce(tried & F.col(stage), F.lit(False)).alias("done")))
        before = before & F.coalesce(F.col(stage), F.lit(False))
    rows = files.select(*keys, "language", F.explode(F.array(*parts)).alias("s"))
    return rows.groupBy(*keys, "language", F.col("s.stage").alias("stage")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("s.supported").alias("supported"), F.count_if("s.tried").alias("attempted"), F.count_if("s.done").alias("succeeded")
    )


def parse_failures(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, failures): files tried and not read, over all languages."""
    return coverage.groupBy(*keys).agg(F.sum(F.col("attempted") - F.col("succeeded")).alias("failures"))


def analyzed_languages(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, languages): languages of which at least one file was read."""
    return coverage.groupBy(*keys).agg(F.count_distinct(F.when(F.col("succeeded") > 0, F.col("language"))).alias("languages"))
