"""Problem 2: report bodies as flat tables of runs, rules, results, locations, flows, threads and steps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shred import Layout, folded, layout, schema_graph, shred
from quarry.tables import table

RUN = ("runs",)
RULE = (*RUN, "tool", "driver", "rules")
RESULT = (*RUN, "results")
LOCATION = (*RESULT, "locations")
FLOW = (*RESULT, "codeFlows")
THREAD = (*FLOW, "threadFlows")
STEP = (*THREAD, "locations")
_URI = ("physicalLocation", "artifactLocation", "uri")

# The arrays of the report format, their kind and the member that labels a row.
KINDS = {RUN: "run", RULE: "rule", RESULT: "result", LOCATION: "location", FLOW: "flow", THREAD: "thread", STEP: "step"}
LABELS = {RUN: [("tool", "driver", "name")], RULE: [("id",)], RESULT: [("ruleId",)], LOCATION: [_URI], FLOW: [], THREAD: [], STEP: [("location", *_URI)]}


def report_layout(reports: DataFrame) -> Layout:
    """Tables of the reports: the driver gets one row for each element of the format, see `folded`."""
    return layout(folded(schema_graph(reports, "body")), repeated=list(KINDS))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    reports = table(spark, folder, "sarif_reports").select("report_id", "body")
    rows = shred(reports, "report_id", "body", report_layout(reports), LABELS, levels=0)
    kind = F.create_map(*[x for p, k in KINDS.items() for x in (F.lit(json.dumps(p)), F.lit(k))])
    label = F.coalesce(F.try_element_at(F.map_values("members"), F.lit(1)), F.lit(""))
    return rows.select("report_id", kind[F.col("node")].alias("kind"), "path", "parent", label.alias("label")).distinct()


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table that the layout makes of the reports: why it is one, its rows, its reports and the inlined values it holds."""
    reports = table(spark, folder, "sarif_reports").select("report_id", "body").dropDuplicates(["report_id"])
    tables = report_layout(reports)
    why = F.create_map(*[x for p, w in tables.tabled.items() for x in (F.lit(json.dumps(p)), F.lit(w))])
    rows = shred(reports, "report_id", "body", tables)
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("report_id").alias("reports"), F.sum(F.size("members")).alias("members")).select("node", why[F.col("node")].alias("why"), "rows", "reports", "members")
