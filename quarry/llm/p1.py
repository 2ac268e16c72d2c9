"""Problem 1: the three findings that rank highest for every repository and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.severity import rule_key, severity_rank, unit_confidence
from quarry.llm.topn import top_n
from quarry.tables import table

TOP = 3


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "findings").select(
        "repo_id",
        rule_key(F.col("rule_id")).alias("rule_id"),
        severity_rank(F.col("severity")).alias("severity"),
        unit_confidence(F.col("confidence")).alias("confidence"),
        "id",
    )
    best = top_n(rows.filter(F.col("rule_id").isNotNull()), ["repo_id", "rule_id"], [("severity", True), ("confidence", True), ("id", False)], TOP)
    return best.select("repo_id", "rule_id", "place", "id")


P1_FOUND_SQL = """
WITH r AS (
  SELECT DISTINCT repo_id, upper(trim(rule_id)) AS rule_id, id,
    CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS s,
    CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE greatest(0.0, least(1.0, confidence)) END AS c
  FROM findings WHERE trim(rule_id) <> ''),
t AS (SELECT repo_id, rule_id, id, row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY s DESC, c DESC, id) AS place FROM r)
SELECT repo_id, rule_id, CAST(place AS BIGINT) AS place, id FROM t WHERE place <= 3
"""
