from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import core_findings

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_an_advisory_rule_shows_its_first_25(spark, tmp_path):
    one = spark.read.parquet(f"{DATA}/findings.parquet").limit(1).drop("id", "repo_id", "rule_id", "category", "title")
    rows = one.crossJoin(spark.range(60).withColumnRenamed("id", "n")).withColumn("id", F.format_string("%03d", "n"))
    rows = rows.withColumn("repo_id", F.lit(1).cast("bigint")).withColumn("rule_id", F.when(F.col("n") < 30, "LONG").otherwise("LEAK"))
    rows = rows.withColumn("category", F.when(F.col("n") < 30, "Maintainability").otherwise("Security")).withColumn("title", F.format_string("Function too long (%d lines)", "n"))
    rows.drop("n").write.parquet(f"{tmp_path}/findings.parquet")
    got = {(r.rule_id, r.id, r.place) for r in core_findings.w3_human_order(spark, str(tmp_path)).collect()}
    assert got == {("LONG", f"{29 - i:03d}", i + 1) for i in range(25)} | {("LEAK", f"{59 - i:03d}", i + 1) for i in range(30)}
