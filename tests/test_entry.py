from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_queries_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p2_found" in entry.queries() and "a1_category_score" in entry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["a1_category_score", "f4_gate", "d9_as_of", "x5_imports", "k2_report_rules"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {re.sub('.parquet$', '', f)} as select * from '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    rel = con.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(map(str, rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())) and got
