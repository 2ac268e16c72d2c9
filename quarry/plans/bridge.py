"""Facts and graphs in the engine's record shapes, projected from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.tables import table

#: Events as facts: the kind by event type, the function by user, the line by order of time.
KINDS = {"signup": "source", "error": "sink", "click": "propagation", "view": "resource_acquire", "purchase": "resource_release"}
SYMBOLS = 5


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """id, kind, operation, file, function, line, input, output; inputs and outputs are one symbol each or null."""
    e = table(spark, folder, "events")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    k = F.regexp_extract("props", r"(\d+)", 1).try_cast("int")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.filter("event_id is not null and user_id is not null").select("event_id", "user_id", kind.alias("kind"), k.alias("k"), line.alias("line"))
    return rows.select(
        F.col("event_id").alias("id"),
        "kind",
        F.when(F.col("kind").isin("resource_acquire", "resource_release"), F.concat(F.lit("r"), (F.col("k") % 3).cast("string"))).otherwise(F.col("kind")).alias("operation"),
        F.concat(F.lit("file"), (F.col("user_id") % 20).cast("string")).alias("file"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("function"),
        "line",
        F.when(F.col("kind").isin("sink", "resource_release") | ((F.col("kind") == "propagation") & (F.col("k") % 4 != 0)), F.concat(F.lit("v"), (F.col("k") % SYMBOLS).cast("string"))).alias("input"),
        F.when(F.col("kind").isin("source", "propagation", "resource_acquire"), F.concat(F.lit("v"), (F.col("event_id") % SYMBOLS).cast("string"))).alias("output"),
    )


FACTS = f"""
ev AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'source' WHEN 'error' THEN 'sink' WHEN 'click' THEN 'propagation' WHEN 'view' THEN 'resource_acquire' WHEN 'purchase' THEN 'resource_release' END AS kind,
  TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line FROM events),
facts AS (SELECT event_id AS id, kind, CASE WHEN kind IN ('resource_acquire', 'resource_release') THEN 'r' || (k % 3) ELSE kind END AS operation, 'file' || (user_id % 20) AS file, 'f' || user_id AS function, line,
  CASE WHEN kind IN ('sink', 'resource_release') OR (kind = 'propagation' AND k % 4 <> 0) THEN 'v' || (k % {SYMBOLS}) END AS input,
  CASE WHEN kind IN ('source', 'propagation', 'resource_acquire') THEN 'v' || (event_id % {SYMBOLS}) END AS output FROM ev)
"""


def call_edges(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, src, dst, n: neighbours in the call chains of findings and how often each pair occurs."""
    f = table(spark, folder, "findings").dropDuplicates(["id"]).filter(F.size("call_chain") > 1)
    pairs = f.select(*keys, F.explode(F.arrays_zip(F.slice("call_chain", 1, F.size("call_chain") - 1).alias("src"), F.slice("call_chain", 2, F.size("call_chain")).alias("dst"))).alias("p"))
    return pairs.select(*keys, F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).filter("src is not null and dst is not null").groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


EDGES = """
fd AS (SELECT DISTINCT ON (id) id, call_chain FROM findings),
pr AS (SELECT unnest(list_zip(call_chain[1:len(call_chain)-1], call_chain[2:len(call_chain)])) AS p FROM fd WHERE len(call_chain) > 1),
edges AS (SELECT p[1] AS src, p[2] AS dst, count(*) AS n FROM pr WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL GROUP BY ALL)
"""
