"""Queries over the structure extracted from source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract.structure import records
from quarry.functions.text import classify_language
from quarry.operators.coverage import analyzed_languages, language_coverage, parse_failures, stage_coverage
from quarry.operators.graph import resolve_calls
from quarry.tables import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").dropDuplicates(["file_id"]).withColumn("language", classify_language(F.col("rel_path"), F.col("content")))


def _coverage(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Coverage of the parse: files that the extractors read."""
    files = _files(spark, folder)
    done = records(files).filter("kind = 'parsed'").select("file_id", (F.col("end_line") == 1).alias("parsed"))
    return language_coverage(files.select("file_id", "language", *keys).join(done, "file_id", "left"), keys)


def x2_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage by language with the extractors' own results."""
    return _coverage(spark, folder, [])


def a4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the three stages by repository and language: a file that is read passes all of them."""
    files = _files(spark, folder)
    done = records(files).filter("kind = 'parsed'").select("file_id", (F.col("end_line") == 1).alias("parse"))
    staged = files.select("file_id", "language", "repo_id").join(done, "file_id", "left").withColumns({"structural": F.col("parse"), "semantic": F.col("parse")})
    return stage_coverage(staged, ["repo_id"])


def a8_parse_failures(spark: SparkSession, folder: str) -> DataFrame:
    return parse_failures(_coverage(spark, folder, ["repo_id"]), ["repo_id"])


def a9_analyzed_languages(spark: SparkSession, folder: str) -> DataFrame:
    return analyzed_languages(_coverage(spark, folder, ["repo_id"]), ["repo_id"])


def x3_functions(spark: SparkSession, folder: str) -> DataFrame:
    return records(_files(spark, folder)).filter("kind = 'function'").select("file_id", "name", "receiver", F.array_join("params", ",").alias("params"), "start_line", "end_line")


def x4_types(spark: SparkSession, folder: str) -> DataFrame:
    return records(_files(spark, folder)).filter("kind = 'type'").select("file_id", "name", F.col("receiver").alias("type_kind"), "start_line", "end_line")


def x6_calls(spark: SparkSession, folder: str) -> DataFrame:
    return records(_files(spark, folder)).filter("kind = 'call'").select("file_id", "caller", "name", "receiver", "start_line")


def g8_resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls between functions of the same file or, by receiver, of the repository's types, where one function alone fits."""
    rows = records(_files(spark, folder))
    f = F.col("file_id").cast("string")
    fn = rows.filter("kind = 'function'").select(F.concat_ws(":", f, F.concat_ws(".", "receiver", "name")).alias("node_id"), f.alias("file"), "name", "receiver")
    call = rows.filter("kind = 'call'").select(F.xxhash64("file_id", "start_line", "caller", "name").alias("call_id"), f.alias("file"), "caller", F.col("name").alias("callee"), "receiver")
    own = F.when(F.col("receiver").isin("self", "this", "s"), F.substring_index("caller", ".", 1)).otherwise(F.col("receiver"))
    return resolve_calls(call.distinct().withColumn("receiver", own), fn)


def r11_long_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of more than 100 lines Medium, of more than 200 High."""
    n = F.col("end_line") - F.col("start_line") + 1
    rows = records(_files(spark, folder)).filter("kind = 'function'").select("file_id", "name", "receiver", "start_line", n.alias("lines"))
    return rows.filter("lines > 100").withColumn("severity", F.when(F.col("lines") > 200, "High").otherwise("Medium"))


def r13_complex_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(_files(spark, folder)).filter("kind = 'function'").select("file_id", "name", "receiver", (F.col("decisions") + 1).alias("complexity"))
    return rows.filter("complexity > 10").withColumn("severity", F.when(F.col("complexity") > 20, "High").otherwise("Medium"))


QUERIES = {f.__name__: f for f in (x2_parsed, a4_coverage, a8_parse_failures, a9_analyzed_languages, x3_functions, x4_types, x6_calls, g8_resolved_calls, r11_long_functions, r13_complex_functions)}
ORACLE: dict[str, str] = {}
