"""Severity, confidence and rule id as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, highest first.
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]


def severity_rank(col: Column) -> Column:
    """Critical 5 ... Info 1; anything else and null 0. Case and outer blanks do not count."""
    name = F.lower(F.trim(col))
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(name == s.lower(), F.lit(len(SEVERITIES) - i)).otherwise(out)
    return out


def unit_confidence(col: Column) -> Column:
    """Clamped to 0..1; null and NaN are 0."""
    return F.when(col.isNull() | F.isnan(col), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def rule_key(col: Column) -> Column:
    """Rule id without outer blanks and in capitals; null when nothing is left."""
    return F.nullif(F.upper(F.trim(col)), F.lit(""))
