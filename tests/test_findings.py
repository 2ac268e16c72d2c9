from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions.severity import rule_key, severity_rank, unit_confidence
from quarry.operators import findings as ops
from quarry.operators import review, scoring

COLS = "id string, rule_id string, category string, severity string, confidence double"


def scores(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], COLS).withColumn("k", F.lit(1))
    cat = {r.category: r.score for r in scoring.category_scores(df, ["k"]).collect()}
    return cat, scoring.overall_scores(df, ["k"]).collect()[0].overall


def test_published_scores(spark):
    cat, overall = scores(spark, [("A", "Security", "Critical", 1.0), ("B", "Security", "High", 0.5), ("C", "Correctness", "Medium", 0.5), ("D", "Maintainability", "Info", 1.0)])
    assert cat["Security"] == pytest.approx(81) and cat["Correctness"] == pytest.approx(98.5) and overall == pytest.approx(93.925)


def test_many_critical_rules_empty_one_category(spark):
    cat, overall = scores(spark, [(f"R{i}", "Security", "Critical", 2.0) for i in range(8)])
    assert cat["Security"] == 0 and overall == pytest.approx(70.0)


def test_equal_findings_saturate_and_long_runs_are_exact(spark):
    last = 101.0
    for n in (1, 10, 100):
        cat, _ = scores(spark, [("R", "Security", "Low", 0.01)] * n)
        want = 100 - min(12.0, sum(0.01 / i**0.5 for i in range(1, n + 1)))
        assert cat["Security"] == pytest.approx(want, abs=1e-9) and cat["Security"] < last
        last = cat["Security"]


def test_normalised_values(spark):
    df = spark.createDataFrame([(" medium ", float("nan"), " go-1 "), (None, None, ""), ("severe", 7.0, None), ("INFO", -1.0, "a")], "s string, c double, r string")
    got = [tuple(r) for r in df.select(severity_rank(F.col("s")), unit_confidence(F.col("c")), rule_key(F.col("r"))).collect()]
    assert got == [(3, 0.0, "GO-1"), (0, 0.0, None), (0, 1.0, None), (1, 0.0, "A")]


GATE = "id string, severity string, confidence double, review_policy string"
DEC = "finding_id string, status string, source string, severity string, confidence double, reason string"


def test_gate_fails_closed(spark):
    cand = spark.createDataFrame(
        [("auth", "High", 0.9, "STATIC_AUTHORITATIVE"), ("ok", "High", 0.9, "CONTEXT_REQUIRED"), ("raise", "Low", 0.5, "CONTEXT_REQUIRED"), ("nosrc", "High", 0.9, "CONTEXT_REQUIRED"), ("none", "High", 0.9, "CONTEXT_REQUIRED"), ("badsev", "Huge", 0.9, "STATIC_AUTHORITATIVE"), ("nan", "High", 0.9, "CONTEXT_REQUIRED"), ("pol", "High", 0.9, None)],
        GATE,
    )
    dec = spark.createDataFrame(
        [("ok", "DOWNGRADED", "AI", "Low", 0.4, "why"), ("raise", "CONFIRMED", "AI", "Critical", 0.99, "why"), ("nosrc", "CONFIRMED", "STATIC", "High", 0.9, "why"), ("nan", "CONFIRMED", "AI", "High", float("nan"), "why"), ("ok", "DOWNGRADED", "AI", "Low", 0.4, "why"), ("pol", "CONFIRMED", "AI", "High", 0.9, "why")],
        DEC,
    )
    got = {r.id: (r.status, r.final_severity, r.final_confidence, r.accepted) for r in ops.gate(cand, dec).collect()}
    assert got["auth"] == ("CONFIRMED", "High", 0.9, True)
    assert got["ok"] == ("DOWNGRADED", "Low", 0.4, True)
    assert got["raise"] == ("CONFIRMED", "Low", 0.5, True)
    assert got["nosrc"][0] == got["badsev"][0] == got["nan"][0] == got["pol"][0] == "UNCERTAIN"
    assert got["none"][0] == "NOT_REVIEWED" and len(got) == 8


def test_filters_reject_unknown_values(spark):
    df = spark.createDataFrame([("1", "r", "Security", "High", 1.0), ("2", "r", "Security", "Low", 1.0)], COLS)
    assert [r.id for r in ops.presentation_filter(df, "MEDIUM", "security").collect()] == ["1"]
    for bad in ({"minimum": "huge"}, {"category": "style"}):
        with pytest.raises(ValueError):
            ops.presentation_filter(df, **bad)


def test_review_plan_keeps_its_budgets_and_marks_the_rest(spark):
    rows = [(1, f"f{i:03}", f"r{i % 30}", i + 1, 500, i % 10 != 9, True, True) for i in range(600)]
    rows += [(1, "static", "r0", 700, 1, True, False, True), (1, "dull", "r0", 701, 1, True, True, False), (2, "large", "r0", 1, 8_000, True, True, True), (2, "fits", "r0", 2, 7_968, True, True, True)]
    df = spark.createDataFrame(rows, "k int, id string, rule_id string, place int, tokens int, enough boolean, contextual boolean, eligible boolean")
    out = {r.id: r for r in review.plan(df, "k").collect()}
    chosen = [r for r in out.values() if r.batch is not None and r.k == 1]
    assert len(out) == len(rows) and len(chosen) == 30 and max(r.batch for r in chosen) == 6  # five a batch by the output budget, six requests
    assert out["static"].skip == out["dull"].skip == "NOT_ELIGIBLE" and out["f009"].skip == "CONTEXT_INSUFFICIENT" and out["f599"].skip == "CONTEXT_INSUFFICIENT" and out["f598"].skip == "BUDGET_EXHAUSTED"
    assert out["large"].skip == "CONTEXT_INSUFFICIENT" and out["fits"].batch == 1
    assert {r.skip for r in review.plan(df, "k", mode="off").collect()} == {"NOT_ELIGIBLE", "USER_DISABLED"}


def test_review_plan_caps_a_rule_as_not_eligible(spark):
    rows = [(1, f"f{i:03}", "r", i, 10, True) for i in range(30)]
    out = review.plan(spark.createDataFrame(rows, "k int, id string, rule_id string, place int, tokens int, enough boolean"), "k").collect()
    assert sum(r.batch is not None for r in out) == 10 and sum(r.skip == "NOT_ELIGIBLE" for r in out) == 20
    assert review.budgets({"findings": 0, "input": -5, "output": 7}) == review.BUDGET | {"output": 7}


def test_gate_takes_decisions_as_they_are_valid(spark):
    cand = spark.createDataFrame([(x, "CONTEXT_REQUIRED", "High", 0.8) for x in ("known", "rejected", "noseverity", "nostatus", "static", "noreason", "higher", "nan")] + [("fixed", "STATIC_AUTHORITATIVE", "High", 0.8), ("odd", "CONTEXT_REQUIRED", "huge", 0.8)], "id string, review_policy string, severity string, confidence double")
    dec = spark.createDataFrame(
        [("known", "DOWNGRADED", "AI", "Low", 0.5, "r"), ("rejected", "REJECTED", "AI", "Low", 0.5, "r"), ("noseverity", "CONFIRMED", "AI", "", 0.5, "r"), ("nostatus", "", "AI", "Low", 0.5, ""), ("static", "CONFIRMED", "STATIC", "Low", 0.5, "r"), ("noreason", "CONFIRMED", "AI", "Low", 0.5, " "), ("higher", "CONFIRMED", "AI", "Critical", 0.9, "r"), ("nan", "UNSUPPORTED", "AI", "Low", float("nan"), "r")],
        "finding_id string, status string, source string, severity string, confidence double, reason string",
    )
    got = {r.id: (r.status, r.source, r.final_severity, r.final_confidence) for r in ops.gate(cand, dec).collect()}
    assert got == {
        "known": ("DOWNGRADED", "AI", "Low", 0.5), "rejected": ("UNCERTAIN", "AI", "High", 0.8), "noseverity": ("CONFIRMED", "AI", "High", 0.5), "nostatus": ("NOT_REVIEWED", "AI", "Low", 0.5),
        "static": ("UNCERTAIN", "STATIC", "High", 0.8), "noreason": ("UNCERTAIN", "AI", "High", 0.8), "higher": ("CONFIRMED", "AI", "High", 0.8), "nan": ("UNCERTAIN", "AI", "High", 0.8),
        "fixed": ("CONFIRMED", "STATIC", "High", 0.8), "odd": ("UNCERTAIN", None, "huge", 0.8),
    }


def test_presentation_states(spark):
    from pyspark.sql import functions as F

    rows = [(5, 0, False, 5, True), (0, 0, False, 0, False), (5, 5, False, 0, False), (5, 3, False, 2, False), (5, 0, True, 5, False), (5, 0, False, 5, False), (5, 5, True, 0, False)]
    df = spark.createDataFrame(rows, "c int, done int, failed boolean, left int, off boolean")
    got = [r[0] for r in df.select(ops.presentation_state(F.col("c"), F.col("done"), F.col("failed"), F.col("left"), F.col("off"))).collect()]
    assert got == ["disabled", "unnecessary", "complete", "partial", "unavailable", "partial", "partial"]


def test_cited_evidence(spark):
    a = spark.createDataFrame([("1", True, ["x"]), ("2", True, ["x", "made-up"]), ("3", False, ["made-up"]), ("4", True, [])], "id string, decisive boolean, cited array<string>")
    o = spark.createDataFrame([("1", ["x", "y"]), ("2", ["x"])], "id string, offered array<string>")
    assert {r.id: r.accepted for r in review.cited_evidence(a, o).collect()} == {"1": True, "2": False, "3": True, "4": False}


def test_answers_must_name_each_id_once(spark):
    q = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "g string, id string")
    r = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("b", "1")], "g string, id string")
    assert {x.g: x.complete for x in review.match_answers(q, r, "g").collect()} == {"a": True, "b": False, "c": False}
