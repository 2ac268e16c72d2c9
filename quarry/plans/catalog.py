"""All queries of the core with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import core_facts, core_files, core_findings, core_rules, core_structure
from quarry.plans.p2 import p2_found, p2_tables

_PARTS = [core_findings, core_facts, core_files, core_structure, core_rules]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_tables": p2_tables}
ORACLE: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
