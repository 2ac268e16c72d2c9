"""Health scores: per-rule diminishing penalties, category and overall scores, and their two scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.severity import severity_rank, unit_confidence

# Penalty of a finding by severity, share of a category in the overall score, cap of a rule's penalty.
PENALTY = {"Critical": 15.0, "High": 8.0, "Medium": 3.0, "Low": 1.0, "Info": 0.0}
CATEGORY_SHARE = {"Security": 0.30, "Correctness": 0.25, "Performance": 0.20, "Architecture": 0.15, "Maintainability": 0.10}
CAP_BASE, CAP_FACTOR = 10.0, 2.0


def rule_penalties(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, rule_id, penalty): contributions sorted down, the i-th divided by the root of i, capped by the heaviest severity.

    A hot rule is not collected: equal contributions are counted first, and a
    run of n equal ones that starts at rank r adds c * (S(r + n) - S(r)), where S
    sums 1/sqrt(i). S is summed exactly up to the longest run by a table of the
    ranks that occur, not by ranking each row.
    """
    weight = F.lit(0.0)
    for name, w in PENALTY.items():
        weight = F.when(F.lower(F.trim("severity")) == name.lower(), F.lit(w)).otherwise(weight)
    rows = findings.select(*keys, "category", "rule_id", weight.alias("weight"), unit_confidence(F.col("confidence")).alias("confidence")).withColumn("c", F.col("weight") * F.col("confidence"))
    runs = rows.groupBy(*keys, "category", "rule_id", "c").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    own = Window.partitionBy(*keys, "category", "rule_id")
    before = own.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("r", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("cap", CAP_BASE + CAP_FACTOR * F.max("weight").over(own))
    part = F.col("c") * (_roots(F.col("r") + F.col("n")) - _roots(F.col("r")))
    total = runs.groupBy(*keys, "category", "rule_id", "cap").agg(F.sum(part).alias("raw"))
    return total.select(*keys, "category", "rule_id", F.least("raw", "cap").alias("penalty"))


def _roots(n: F.Column) -> F.Column:
    """Sum of 1/sqrt(i) for i = 1..n: exact for small n, by the Euler-Maclaurin series beyond 64, with an error below 1e-12."""
    small = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(n, F.lit(64)), F.lit(1)).cast("bigint")), F.lit(0.0), lambda a, i: a + 1 / F.sqrt(i.cast("double")))
    x = n.cast("double")
    large = 2 * F.sqrt(x) - F.lit(1.4603545088095868) + 1 / (2 * F.sqrt(x)) - 1 / (24 * x * F.sqrt(x)) + 1 / (384 * F.pow(x, F.lit(3.5)))
    return F.when(n <= 0, F.lit(0.0)).when(n <= 64, small).otherwise(large)


def category_scores(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, score) for the five categories; one without findings scores 100. Unknown categories do not count."""
    spark = findings.sparkSession
    cats = spark.createDataFrame([(c, s) for c, s in CATEGORY_SHARE.items()], "category string, share double")
    lost = rule_penalties(findings, keys).groupBy(*keys, "category").agg(F.sum("penalty").alias("lost"))
    scopes = findings.select(*keys).distinct() if keys else spark.range(1).select()
    return scopes.crossJoin(F.broadcast(cats)).join(lost, [*keys, "category"], "left").select(*keys, "category", "share", F.greatest(F.lit(0.0), 100 - F.coalesce("lost", F.lit(0.0))).alias("score"))


def overall_scores(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overall): the categories' scores weighted by their shares."""
    scores = category_scores(findings, keys)
    return (scores.groupBy(*keys) if keys else scores.groupBy()).agg(F.sum(F.col("score") * F.col("share")).alias("overall"))


def scoped_scores(candidates: DataFrame, finals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, available, overall): STATIC_RISK over all candidates, VERIFIED_HEALTH over accepted ones.

    VERIFIED_HEALTH is not available where a candidate that needs context is
    UNCERTAIN, NOT_REVIEWED or without status; its score is then null.
    """
    risk = overall_scores(candidates, keys).select(*keys, F.lit("STATIC_RISK").alias("scope"), F.lit(True).alias("available"), "overall")
    waiting = (F.col("review_policy") != "STATIC_AUTHORITATIVE") & F.coalesce(F.col("status"), F.lit("")).isin("UNCERTAIN", "NOT_REVIEWED", "")
    gate = candidates.groupBy(*keys).agg(F.bool_or(F.coalesce(waiting, F.lit(True))).alias("open"))
    health = gate.join(overall_scores(finals, keys), keys, "left")
    health = health.select(*keys, F.lit("VERIFIED_HEALTH").alias("scope"), (~F.col("open")).alias("available"), F.when(~F.col("open"), F.coalesce("overall", F.lit(100.0))).alias("overall"))
    return risk.unionByName(health)


def severity_matrix(findings: DataFrame) -> DataFrame:
    """(severity, defects, measured): Maintainability findings are measured, all others defects."""
    measured = F.col("category") == "Maintainability"
    rank = severity_rank(F.col("severity"))
    name = F.when(rank == 5, "Critical").when(rank == 4, "High").when(rank == 3, "Medium").when(rank == 2, "Low").when(rank == 1, "Info").otherwise("Unknown")
    return findings.groupBy(name.alias("severity")).agg(F.count_if(~measured).alias("defects"), F.count_if(measured).alias("measured"))
