"""Findings: normalised fields, content ids, the certainty gate, filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.severity import SEVERITIES, rule_key, severity_rank, unit_confidence

# Statuses of a decision; those that accept a finding; order of categories and evidence for review.
STATUSES = ["CONFIRMED", "DOWNGRADED", "UNSUPPORTED", "UNCERTAIN", "NOT_REVIEWED"]
ACCEPTED = ["CONFIRMED", "DOWNGRADED"]
POLICIES = ["STATIC_AUTHORITATIVE", "CONTEXT_REQUIRED"]
CATEGORY_ORDER = {"Security": 5, "Correctness": 4, "Performance": 3, "Architecture": 2}
EVIDENCE_ORDER = {"strong": 3, "moderate": 2}
SNIPPET_LINES = 20


def ranked(col: Column, order: dict[str, int], default: int = 1) -> Column:
    out = F.lit(default)
    for name, n in order.items():
        out = F.when(col == name, F.lit(n)).otherwise(out)
    return out


def severity_name(col: Column) -> Column:
    """The name as severities are written; null when it is none of them."""
    rank = severity_rank(col)
    out = F.lit(None).cast("string")
    for i, s in enumerate(SEVERITIES):
        out = F.when(rank == len(SEVERITIES) - i, F.lit(s)).otherwise(out)
    return out


def normalise(findings: DataFrame) -> DataFrame:
    """One row a finding with defaults filled in: repeats dropped by id, rule and severity as they are written,
    confidence in 0..1, observation from the title, hypothesis from the reason, policy CONTEXT_REQUIRED, and a
    snippet of at most 20 lines. Null columns keep their default; extra columns stay."""
    rows = findings.dropDuplicates(["id"])
    return rows.withColumns(
        {
            "rule_id": rule_key(F.col("rule_id")),
            "severity": severity_name(F.col("severity")),
            "confidence": unit_confidence(F.col("confidence")),
            "observation": F.coalesce(F.nullif(F.trim("observation"), F.lit("")), F.col("title")),
            "hypothesis": F.coalesce(F.nullif(F.trim("hypothesis"), F.lit("")), F.col("reason")),
            "review_policy": F.when(F.col("review_policy").isin(*POLICIES), F.col("review_policy")).otherwise("CONTEXT_REQUIRED"),
            "code_snippet": first_lines("code_snippet", SNIPPET_LINES),
        }
    )


def first_lines(col: str, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.col(col), "\n"), 1, n), "\n")


def content_id() -> Column:
    """16 hex digits of the SHA-256 over rule, place, title and every step's kind, place and expression, parted by NUL."""
    nul = F.lit("\0")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    steps = F.transform(
        F.coalesce(F.col("steps"), F.array().cast("array<struct<kind:string,file:string,line:int,column:int,expression:string,message:string,related_symbol:string>>")),
        lambda s: F.concat_ws("\0", F.coalesce(s["kind"], F.lit("")), F.coalesce(s["file"], F.lit("")), F.coalesce(s["line"].cast("string"), F.lit("0")), F.coalesce(s["expression"], F.lit(""))),
    )
    head = F.concat_ws("\0", text("rule_id"), text("file"), text("start_line"), text("end_line"), text("title"))
    whole = F.when(F.size(steps) > 0, F.concat(head, nul, F.array_join(steps, "\0"))).otherwise(head)
    return F.substring(F.sha2(whole, 256), 1, 16)


def gate(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with a bounded decision: status, source, final severity and confidence, accepted.

    A wrong policy, severity or confidence makes a candidate UNCERTAIN; an
    authoritative one is CONFIRMED by STATIC. A decision without a status is
    NOT_REVIEWED, as is a candidate without a decision. Any other counts only if
    its status is known, its confidence, where null is 0, lies in 0..1, its
    severity is empty or known and, to accept, it comes from AI with a reason;
    else the candidate is UNCERTAIN with its own severity and confidence. A
    decision can lower but never raise them; an empty severity keeps them.
    decisions: finding_id, status, source, severity, confidence, reason; of
    several for one finding any one counts.
    """
    d = decisions.dropDuplicates(["finding_id"]).select(
        F.col("finding_id").alias("_id"), F.coalesce("status", F.lit("")).alias("_status"), F.col("source").alias("_source"), F.coalesce("severity", F.lit("")).alias("_severity"), F.coalesce("confidence", F.lit(0.0)).alias("_confidence"), F.col("reason").alias("_reason")
    )
    rows = candidates.join(d, candidates["id"] == F.col("_id"), "left")
    own, other = severity_rank(F.col("severity")), severity_rank(F.col("_severity"))
    known = (
        F.col("_status").isin(*STATUSES)
        & F.col("_confidence").between(0.0, 1.0)
        & ((other > 0) | (F.col("_severity") == ""))
        & (~F.col("_status").isin(*ACCEPTED) | ((F.col("_source") == "AI") & (F.coalesce(F.trim("_reason"), F.lit("")) != "")))
    )
    valid = F.coalesce((F.col("_status") == "") | known, F.lit(False))
    good = F.coalesce(F.col("review_policy").isin(*POLICIES) & (own > 0) & F.col("confidence").between(0.0, 1.0), F.lit(False))
    fixed = F.col("review_policy") == "STATIC_AUTHORITATIVE"
    given = F.col("_id").isNotNull()
    status = F.when(~good, "UNCERTAIN").when(fixed, "CONFIRMED").when(~given, "NOT_REVIEWED").when(~valid, "UNCERTAIN").when(F.col("_status") == "", "NOT_REVIEWED").otherwise(F.col("_status"))
    taken = F.coalesce(good & ~fixed & given & valid, F.lit(False))
    return (
        rows.withColumn("status", status)
        .withColumn("source", F.when(good & fixed, "STATIC").when(good & given, F.col("_source")))
        .withColumn("final_severity", F.when(taken & (other > 0) & (other < own), severity_name(F.col("_severity"))).otherwise(F.col("severity")))
        .withColumn("final_confidence", F.when(taken, F.least("confidence", "_confidence")).otherwise(F.col("confidence")))
        .withColumn("accepted", F.col("status").isin(*ACCEPTED))
        .drop("_id", "_status", "_source", "_severity", "_confidence", "_reason")
    )


def presentation_state(contextual: Column, completed: Column, failed: Column, not_reviewed: Column, disabled: Column) -> Column:
    """disabled, unnecessary, complete, partial or unavailable.

    contextual: candidates that need a review; completed: those reviewed, or
    answered from a cache; failed: whether a request failed, a candidate lacked
    context or the review stopped; disabled: whether no review was wanted.
    """
    return (
        F.when(disabled, "disabled")
        .when(contextual == 0, "unnecessary")
        .when((not_reviewed == 0) & ~failed, "complete")
        .when(completed > 0, "partial")
        .when(failed, "unavailable")
        .otherwise("partial")
    )


def presentation_filter(finals: DataFrame, minimum: str | None = None, category: str | None = None) -> DataFrame:
    """Findings of at least the severity and of the category, without regard to case; unknown values are an error."""
    out = finals
    if minimum:
        if minimum.lower() not in [s.lower() for s in SEVERITIES]:
            raise ValueError(f"unknown severity {minimum}")
        out = out.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(minimum)))
    if category:
        if category.lower() not in [*(c.lower() for c in CATEGORY_ORDER), "maintainability"]:
            raise ValueError(f"unknown category {category}")
        out = out.filter(F.lower("category") == category.lower())
    return out


def contract_check(findings: DataFrame, rule: str = "rule_id") -> DataFrame:
    """(rule, broken): rules with a context-required finding that lacks observation or hypothesis; all their findings are dropped."""
    lacks = (F.col("review_policy") == "CONTEXT_REQUIRED") & ((F.coalesce(F.trim("observation"), F.lit("")) == "") | (F.coalesce(F.trim("hypothesis"), F.lit("")) == ""))
    return findings.groupBy(rule).agg(F.count_if(F.coalesce(lacks, F.lit(True))).alias("broken")).filter("broken > 0")


def eligible(mode: str = "smart") -> Column:
    """Whether a candidate is worth a review in the mode smart, all or off."""
    if mode == "off":
        return F.lit(False)
    open_ = F.coalesce(F.col("review_policy"), F.lit("")) != "STATIC_AUTHORITATIVE"
    if mode == "all":
        return open_
    strength = F.lower(F.trim(F.coalesce("evidence_strength", F.lit(""))))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("reason", F.lit(""))))
    # Words that mark a claim as contextual.
    marked = F.lit(False)
    for m in ["lifecycle", "ownership", "may ", "possibly", "complex", "long function", "excessively long", "layer"]:
        marked = marked | text.contains(m)
    flow = F.exists(F.coalesce(F.transform("steps", lambda s: F.lower(s["kind"])), F.array().cast("array<string>")), lambda k: k.isin("source", "propagation", "sink"))
    firm = (strength == "strong") & (F.col("confidence") >= 0.9) & F.coalesce(flow, F.lit(False))
    return open_ & (strength.isin("moderate", "weak") | (F.col("confidence") < 0.85) | F.col("category").isin("Maintainability", "Architecture") | marked | ~firm)


def diverse_order(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `round` and `turn`: one finding of each rule a round, rules in the order of their best finding.

    Within `keys`, usually a repository or scan. Rounds are ranked by rule, and
    a rule's turn is its best finding's rank among the rules' best ones, so no
    window spans all findings of a group.
    """
    order = [
        severity_rank(F.col("severity")).desc(),
        F.col("confidence").desc(),
        ranked(F.col("category"), CATEGORY_ORDER).desc(),
        ranked(F.lower(F.trim("evidence_strength")), EVIDENCE_ORDER).desc(),
    ]
    place = F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")))
    rows = candidates.withColumn("round", F.row_number().over(Window.partitionBy(*keys, "rule_id").orderBy(*order, place, "id")))
    best = rows.filter("round = 1").withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "rule_id")))
    return rows.join(best.select(*keys, "rule_id", "turn"), [*keys, "rule_id"])


def human_order(finals: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """The findings a reader is shown with their place in the rule; advisory rules with more than `most` keep the first `most`."""
    metric = F.coalesce(F.regexp_extract("title", r"\((\d+)[^()]*\)[^()]*$", 1).try_cast("int"), F.lit(0))
    order = [severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), F.desc("metric"), F.asc("file"), F.asc("id")]
    w = Window.partitionBy(*keys, "rule_id")
    rows = finals.withColumn("metric", metric).withColumn("place", F.row_number().over(w.orderBy(*order)))
    return rows.filter((F.col("category") != "Maintainability") | F.col("category").isNull() | (F.col("place") <= most))
