"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.p1 import P1_FOUND_SQL, p1_found
from quarry.llm.p3 import p3_found, p3_kinds
from quarry.llm.p4 import p4_found, p4_rates
from quarry.llm.p5 import p5_found, p5_redacted
from quarry.llm.p6 import p6_fill, p6_packets
from quarry.llm.p7 import p7_found, p7_items
from quarry.llm.p8 import p8_found, p8_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found, "p3_kinds": p3_kinds, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_packets": p6_packets, "p6_fill": p6_fill, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_rates": p8_rates}
ORACLE: dict[str, str] = {"p1_found": P1_FOUND_SQL}
