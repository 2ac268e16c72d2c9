"""Rules over the order of facts in a function: resources, intervals, thresholds.

All joins carry equality on file and function; the order of lines is a residual
condition, or, where only the next or last match counts, a window, so that no
pair is formed that a later fact makes needless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["file", "function"]


def unreleased(facts: DataFrame) -> DataFrame:
    """Acquisitions with no later release of the same operation and symbol in the same function.

    The last release of each place, operation and symbol decides, so each
    acquisition meets one row. Rows without a symbol are never released.
    """
    last = facts.filter("kind = 'resource_release'").groupBy(*PLACE, "operation", F.col("input").alias("output")).agg(F.max("line").alias("last"))
    rows = facts.filter("kind = 'resource_acquire'").join(last, [*PLACE, "operation", "output"], "left")
    return rows.filter("last is null or last <= line").drop("last")


def escaping(acquired: DataFrame, facts: DataFrame) -> DataFrame:
    """Acquisitions whose symbol goes on after them: an input of a later propagation in the same function."""
    last = facts.filter("kind = 'propagation' and input is not null").groupBy(*PLACE, F.col("input").alias("output")).agg(F.max("line").alias("last"))
    return acquired.join(last, [*PLACE, "output"]).filter("last > line").drop("last")


def leaks(facts: DataFrame) -> DataFrame:
    """Resources neither released nor handed on."""
    open_ = unreleased(facts)
    gone = escaping(open_, facts).select("id")
    return open_.join(gone, "id", "left_anti")


def as_of(versions: DataFrame, reads: DataFrame) -> DataFrame:
    """Each read with the newest version at or before it, by one window over both sides.

    versions: file, function, symbol, line, value. reads: id, file, function,
    symbol, line. A version on the read's own line counts; reads without a
    version are left out. Neither side is joined pair by pair.
    """
    v = versions.select(*PLACE, "symbol", "line", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("id"), F.struct(F.col("line").alias("at"), F.col("value").alias("value")).alias("v"))
    r = reads.select(*PLACE, "symbol", "line", F.lit(1).alias("side"), F.col("id").cast("bigint").alias("id"), F.lit(None).cast(v.schema["v"].dataType).alias("v"))
    w = Window.partitionBy(*PLACE, "symbol").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = v.unionByName(r).withColumn("v", F.last("v", ignorenulls=True).over(w))
    return both.filter("side = 1 and v is not null").select("id", *PLACE, "symbol", "line", F.col("v.at").alias("version_line"), F.col("v.value").alias("value"))


def undisturbed(facts: DataFrame, first: str, second: str, between: str) -> DataFrame:
    """Pairs (first, second) of neighbours: each `second` with the last `first` before it, if no `between` of the same function lies between them."""
    rows = facts.filter(F.col("kind").isin(first, second, between))
    w = Window.partitionBy(*PLACE).orderBy("line", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("f", F.last(F.when(F.col("kind") == first, F.struct("line", "id")), ignorenulls=True).over(w)).withColumn("b", F.last(F.when(F.col("kind") == between, F.col("line")), ignorenulls=True).over(w))
    return rows.filter((F.col("kind") == second) & F.col("f").isNotNull() & (F.col("b").isNull() | (F.col("b") < F.col("f.line")))).select(F.col("f.id").alias("first_id"), F.col("id").alias("second_id"), *PLACE)


def complexity(facts: DataFrame, kinds: list[str], medium: int, high: int) -> DataFrame:
    """(file, function, complexity, line, severity) of functions above the limit, placed at their last decision."""
    rows = facts.filter(F.col("kind").isin(*kinds)).groupBy(*PLACE).agg((F.count(F.lit(1)) + 1).alias("complexity"), F.max("line").alias("line"))
    return rows.filter(F.col("complexity") > medium).withColumn("severity", F.when(F.col("complexity") > high, "High").otherwise("Medium"))


def unchecked_iteration(facts: DataFrame) -> DataFrame:
    """Acquisitions that are read later in the function, but never released after the last reading."""
    reads = facts.filter("kind = 'propagation' and input is not null").groupBy(*PLACE, F.col("input").alias("output")).agg(F.max("line").alias("read"))
    done = facts.filter("kind = 'resource_release'").groupBy(*PLACE, F.col("input").alias("output")).agg(F.max("line").alias("done"))
    rows = facts.filter("kind = 'resource_acquire'").join(reads, [*PLACE, "output"]).filter("read > line")
    return rows.join(done, [*PLACE, "output"], "left").filter("done is null or done <= read").drop("read", "done")


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """For each point the span around it that starts last; spans: file, name, start_line, end_line; points: id, file, line.

    The join is by file with the lines as a residual condition: a file's functions
    are few, whatever the number of files.
    """
    near = points.join(spans, "file").filter("start_line <= line and line <= end_line")
    w = Window.partitionBy("id").orderBy(F.desc("start_line"), "end_line", "name")
    return near.withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "file", "line", "name")
