"""Queries over findings: scores, gates, orders, review selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import findings as ops
from quarry.operators import scoring
from quarry.session import materialize
from quarry.tables import table

# The findings as `normalise` leaves them, in SQL.
NORM = """
norm AS (
 SELECT DISTINCT ON (id) id, scan_id, repo_id, nullif(upper(trim(rule_id)), '') AS rule_id, category,
  CASE lower(trim(severity)) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' WHEN 'info' THEN 'Info' END AS severity,
  CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS sev,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE greatest(0.0, least(1.0, confidence)) END AS confidence,
  evidence_strength, title, reason, coalesce(nullif(trim(observation), ''), title) AS observation, coalesce(nullif(trim(hypothesis), ''), reason) AS hypothesis,
  CASE WHEN review_policy IN ('STATIC_AUTHORITATIVE', 'CONTEXT_REQUIRED') THEN review_policy ELSE 'CONTEXT_REQUIRED' END AS review_policy,
  file, start_line, end_line, steps, call_chain, affected_symbols, code_snippet
 FROM findings)
"""
PENALTY = "CASE severity WHEN 'Critical' THEN 15.0 WHEN 'High' THEN 8.0 WHEN 'Medium' THEN 3.0 WHEN 'Low' THEN 1.0 ELSE 0.0 END"
SCORES = (
    NORM
    + f""",
ranked AS (SELECT repo_id, category, rule_id, CAST({PENALTY} AS DOUBLE) AS w, CAST({PENALTY} AS DOUBLE) * confidence AS c,
  row_number() OVER (PARTITION BY repo_id, category, rule_id ORDER BY CAST({PENALTY} AS DOUBLE) * confidence DESC) AS i FROM norm),
pen AS (SELECT repo_id, category, rule_id, least(sum(c / sqrt(i)), 10 + 2 * max(w)) AS p FROM ranked GROUP BY ALL),
cats(category, share) AS (VALUES ('Security', 0.30), ('Correctness', 0.25), ('Performance', 0.20), ('Architecture', 0.15), ('Maintainability', 0.10)),
cat AS (SELECT r.repo_id, c.category, CAST(c.share AS DOUBLE) AS share, greatest(0.0, 100 - coalesce(sum(p.p), 0.0)) AS score
  FROM (SELECT DISTINCT repo_id FROM norm) r CROSS JOIN cats c LEFT JOIN pen p ON p.repo_id = r.repo_id AND p.category = c.category GROUP BY ALL)
"""
)
# Decisions as a review might record them, derived from each finding's own values.
DECISIONS = """
dec AS (SELECT id AS finding_id, ['CONFIRMED','DOWNGRADED','UNSUPPORTED','UNCERTAIN','MAYBE',''][1 + CAST(length(title) % 6 AS INT)] AS status,
  CASE WHEN length(title) % 3 = 0 THEN 'STATIC' ELSE 'AI' END AS source, CASE WHEN length(title) % 11 = 0 THEN '' WHEN length(title) % 2 = 0 THEN 'Low' ELSE 'High' END AS severity,
  (length(title) % 12) / 10.0 AS confidence, CASE WHEN length(title) % 7 = 0 THEN '' ELSE 'seen' END AS reason
  FROM norm WHERE review_policy = 'CONTEXT_REQUIRED' AND title IS NOT NULL AND length(title) % 4 <> 1)
"""
GATE = (
    NORM
    + ","
    + DECISIONS
    + """,
j AS (SELECT n.*, d.finding_id, d.status AS ds, d.source AS dsrc, d.severity AS dsev, d.confidence AS dc,
  CASE d.severity WHEN 'High' THEN 4 WHEN 'Low' THEN 2 ELSE 0 END AS drank,
  coalesce(d.status = '' OR d.status IN ('CONFIRMED','DOWNGRADED','UNSUPPORTED','UNCERTAIN','NOT_REVIEWED') AND d.confidence BETWEEN 0 AND 1
   AND (d.status NOT IN ('CONFIRMED','DOWNGRADED') OR (d.source = 'AI' AND trim(d.reason) <> '')), false) AS valid
  FROM norm n LEFT JOIN dec d ON n.id = d.finding_id),
g AS (SELECT *, CASE WHEN sev = 0 THEN 'UNCERTAIN' WHEN review_policy = 'STATIC_AUTHORITATIVE' THEN 'CONFIRMED' WHEN finding_id IS NULL THEN 'NOT_REVIEWED' WHEN NOT valid THEN 'UNCERTAIN' WHEN ds = '' THEN 'NOT_REVIEWED' ELSE ds END AS status,
  sev > 0 AND review_policy <> 'STATIC_AUTHORITATIVE' AND finding_id IS NOT NULL AND valid AS taken FROM j),
gated AS (SELECT *, CASE WHEN sev > 0 AND review_policy = 'STATIC_AUTHORITATIVE' THEN 'STATIC' WHEN sev > 0 AND finding_id IS NOT NULL THEN dsrc END AS source,
  CASE WHEN taken AND drank > 0 AND drank < sev THEN dsev ELSE severity END AS final_severity, CASE WHEN taken THEN least(confidence, dc) ELSE confidence END AS final_confidence,
  status IN ('CONFIRMED','DOWNGRADED') AS accepted FROM g)
"""
)


def norm(spark: SparkSession, folder: str) -> DataFrame:
    return ops.normalise(table(spark, folder, "findings"))


def decisions(rows: DataFrame) -> DataFrame:
    n = F.length("title")
    words = F.array(*[F.lit(s) for s in ["CONFIRMED", "DOWNGRADED", "UNSUPPORTED", "UNCERTAIN", "MAYBE", ""]])
    picked = rows.filter((F.col("review_policy") == "CONTEXT_REQUIRED") & F.col("title").isNotNull() & (n % 4 != 1))
    return picked.select(
        F.col("id").alias("finding_id"),
        F.element_at(words, (n % 6 + 1).cast("int")).alias("status"),
        F.when(n % 3 == 0, "STATIC").otherwise("AI").alias("source"),
        F.when(n % 11 == 0, "").when(n % 2 == 0, "Low").otherwise("High").alias("severity"),
        ((n % 12) / 10.0).cast("double").alias("confidence"),
        F.when(n % 7 == 0, "").otherwise("seen").alias("reason"),
    )


def gated(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder)
    return ops.gate(rows, decisions(rows))


def a1_category_score(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.category_scores(norm(spark, folder), ["repo_id"]).select("repo_id", "category", F.round("score", 6).alias("score"))


def a2_overall_score(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.overall_scores(norm(spark, folder), ["repo_id"]).select("repo_id", F.round("overall", 6).alias("overall"))


def a3_scoped_scores(spark: SparkSession, folder: str) -> DataFrame:
    kept = ["repo_id", "category", "rule_id", "severity", "confidence", "final_severity", "final_confidence", "accepted", "review_policy", "status"]
    rows = materialize(gated(spark, folder).select(*kept), "gated")  # gated once, read by both scopes
    finals = rows.filter("accepted").withColumn("severity", F.col("final_severity")).withColumn("confidence", F.col("final_confidence"))
    return scoring.scoped_scores(rows, finals, ["repo_id"]).select("repo_id", "scope", "available", F.round("overall", 6).alias("overall"))


def a5_dominant_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).filter("rule_id is not null")
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(10)


def a6_adjudication_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def a7_severity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.severity_matrix(norm(spark, folder))


def a10_review_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = gated(spark, folder)
    contextual = F.col("review_policy") == "CONTEXT_REQUIRED"
    return rows.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~contextual).alias("authoritative"),
        F.count_if(contextual).alias("contextual"),
        F.count_if(contextual & ops.eligible("smart")).alias("eligible"),
        F.count_if(F.col("status") == "NOT_REVIEWED").alias("not_reviewed"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("withheld"),
    )


def a14_presentation_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of each repository's review; a contextual candidate without a file lacks context."""
    contextual = F.col("review_policy") == "CONTEXT_REQUIRED"
    counts = gated(spark, folder).groupBy("repo_id").agg(
        F.count_if(contextual).alias("contextual"),
        F.count_if(contextual & (F.col("status") == "NOT_REVIEWED")).alias("left"),
        F.count_if(contextual & (F.col("status") != "NOT_REVIEWED") & (F.col("source") == "AI")).alias("completed"),
        F.bool_or(contextual & F.col("file").isNull()).alias("failed"),
    )
    return counts.select("repo_id", ops.presentation_state(F.col("contextual"), F.col("completed"), F.col("failed"), F.col("left"), F.lit(False)).alias("state"))


def e6_contract(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "findings").dropDuplicates(["id"]).withColumn("rule_id", F.upper(F.trim("rule_id")))
    return ops.contract_check(raw)


def e7_finding_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of a repository's findings as places."""
    from pyspark.sql import Window

    rows = norm(spark, folder)
    w = Window.partitionBy("scan_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("rule_id", "file", "start_line", "end_line", "title", "id")])
    return rows.select("scan_id", "id", F.row_number().over(w).cast("bigint").alias("place"))


def f1_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return norm(spark, folder).select("id", "rule_id", "severity", "confidence", "observation", "hypothesis", "review_policy", F.size(F.split("code_snippet", "\n")).cast("bigint").alias("snippet_lines"))


def f2_content_ids(spark: SparkSession, folder: str) -> DataFrame:
    return norm(spark, folder).select("id", ops.content_id().alias("content_id"))


def f4_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).select("id", "status", "source", "final_severity", F.round("final_confidence", 6).alias("final_confidence"), "accepted")


def f8_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ops.presentation_filter(norm(spark, folder), "high", "SECURITY").select("id", "severity", "category")


def v1_eligible(spark: SparkSession, folder: str) -> DataFrame:
    return norm(spark, folder).select("id", F.coalesce(ops.eligible("smart"), F.lit(False)).alias("smart"), F.coalesce(ops.eligible("all"), F.lit(False)).alias("everything"))


def w1_diverse_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).filter("rule_id is not null")
    return ops.diverse_order(rows, ["scan_id"]).select("scan_id", "id", F.col("round").cast("bigint").alias("round"), F.col("turn").cast("bigint").alias("turn"))


def w2_rule_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most max(2, budget / 4) candidates a rule, budget 40."""
    rows = norm(spark, folder).filter("rule_id is not null")
    return ops.diverse_order(rows, ["scan_id"]).filter(F.col("round") <= max(2, 40 // 4)).select("scan_id", "rule_id", "id")


def w3_human_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).filter("rule_id is not null")
    return ops.human_order(rows, ["repo_id"]).select("repo_id", "rule_id", "id", F.col("place").cast("bigint").alias("place"))


def w7_sequence_ids(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    items = table(spark, folder, "evidence_items").select("item_id", "finding_id", "kind").distinct()
    n = F.row_number().over(Window.partitionBy("finding_id", "kind").orderBy("item_id"))
    return items.select("item_id", F.concat_ws(".", "kind", n.cast("string")).alias("evidence_id"))


def _sql_order(keys: str) -> str:
    cat = "CASE category WHEN 'Security' THEN 5 WHEN 'Correctness' THEN 4 WHEN 'Performance' THEN 3 WHEN 'Architecture' THEN 2 ELSE 1 END"
    ev = "CASE lower(trim(evidence_strength)) WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"
    o = f"sev DESC, confidence DESC, {cat} DESC, {ev} DESC"
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, rule_id ORDER BY {o}, coalesce(file, '') || ':' || coalesce(CAST(start_line AS VARCHAR), '0'), id) AS round FROM norm WHERE rule_id IS NOT NULL),
b AS (SELECT {keys}, rule_id, row_number() OVER (PARTITION BY {keys} ORDER BY {o}, rule_id) AS turn FROM r WHERE round = 1)"""


SMART = """review_policy <> 'STATIC_AUTHORITATIVE' AND (lower(trim(coalesce(evidence_strength, ''))) IN ('moderate', 'weak') OR confidence < 0.85 OR coalesce(category IN ('Maintainability', 'Architecture'), false)
 OR regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(reason, ''))), 'lifecycle|ownership|may |possibly|complex|long function|excessively long|layer')
 OR NOT (lower(trim(coalesce(evidence_strength, ''))) = 'strong' AND confidence >= 0.9 AND coalesce(len(list_filter(steps, lambda s: lower(s.kind) IN ('source', 'propagation', 'sink'))) > 0, false)))"""

QUERIES = {f.__name__: f for f in (
    a1_category_score, a2_overall_score, a3_scoped_scores, a5_dominant_rules, a6_adjudication_counts, a7_severity_matrix, a10_review_summary, a14_presentation_state,
    e6_contract, e7_finding_order, f1_normalise, f2_content_ids, f4_gate, f8_filter, v1_eligible, w1_diverse_order, w2_rule_cap, w3_human_order, w7_sequence_ids,
)}

ORACLE = {
    "a1_category_score": f"WITH {SCORES} SELECT repo_id, category, round(score, 6) AS score FROM cat",
    "a2_overall_score": f"WITH {SCORES} SELECT repo_id, round(sum(score * share), 6) AS overall FROM cat GROUP BY repo_id",
    "a3_scoped_scores": f"""WITH {GATE},
fin AS (SELECT repo_id, category, rule_id, final_severity AS severity, final_confidence AS confidence FROM gated WHERE accepted),
r1 AS (SELECT 'S' AS k, repo_id, category, rule_id, CAST({PENALTY} AS DOUBLE) AS w, CAST({PENALTY} AS DOUBLE) * confidence AS c FROM norm
  UNION ALL SELECT 'V', repo_id, category, rule_id, CAST({PENALTY} AS DOUBLE), CAST({PENALTY} AS DOUBLE) * confidence FROM fin),
r2 AS (SELECT *, row_number() OVER (PARTITION BY k, repo_id, category, rule_id ORDER BY c DESC) AS i FROM r1),
pen AS (SELECT k, repo_id, category, rule_id, least(sum(c / sqrt(i)), 10 + 2 * max(w)) AS p FROM r2 GROUP BY ALL),
cats(category, share) AS (VALUES ('Security', 0.30), ('Correctness', 0.25), ('Performance', 0.20), ('Architecture', 0.15), ('Maintainability', 0.10)),
ks(k) AS (VALUES ('S'), ('V')),
cat AS (SELECT ks.k, r.repo_id, c.category, CAST(c.share AS DOUBLE) AS share, greatest(0.0, 100 - coalesce(sum(p.p), 0.0)) AS score
  FROM (SELECT DISTINCT repo_id FROM norm) r CROSS JOIN ks CROSS JOIN cats c LEFT JOIN pen p ON p.repo_id = r.repo_id AND p.category = c.category AND p.k = ks.k GROUP BY ALL),
o AS (SELECT k, repo_id, sum(score * share) AS overall FROM cat GROUP BY ALL),
w AS (SELECT repo_id, bool_or(review_policy <> 'STATIC_AUTHORITATIVE' AND status IN ('UNCERTAIN', 'NOT_REVIEWED', '')) AS open FROM gated GROUP BY repo_id)
SELECT o.repo_id, 'STATIC_RISK' AS scope, true AS available, round(overall, 6) AS overall FROM o WHERE k = 'S'
UNION ALL SELECT o.repo_id, 'VERIFIED_HEALTH', NOT w.open, CASE WHEN NOT w.open THEN round(overall, 6) END FROM o JOIN w ON o.repo_id = w.repo_id WHERE k = 'V'""",
    "a5_dominant_rules": f"WITH {NORM} SELECT rule_id, count(*) AS n FROM norm WHERE rule_id IS NOT NULL GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10",
    "a6_adjudication_counts": f"WITH {GATE} SELECT status, count(*) AS n FROM gated GROUP BY status",
    "a7_severity_matrix": f"WITH {NORM} SELECT coalesce(severity, 'Unknown') AS severity, CAST(count(*) FILTER (WHERE category <> 'Maintainability') AS BIGINT) AS defects, CAST(count(*) FILTER (WHERE category = 'Maintainability') AS BIGINT) AS measured FROM norm GROUP BY 1",
    "a10_review_summary": f"""WITH {GATE} SELECT count(*) AS candidates, count(*) FILTER (WHERE review_policy <> 'CONTEXT_REQUIRED') AS authoritative, count(*) FILTER (WHERE review_policy = 'CONTEXT_REQUIRED') AS contextual,
 count(*) FILTER (WHERE {SMART}) AS eligible, count(*) FILTER (WHERE status = 'NOT_REVIEWED') AS not_reviewed, count(*) FILTER (WHERE status = 'UNCERTAIN') AS uncertain, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS withheld FROM gated""",
    "a14_presentation_state": f"""WITH {GATE}, s AS (SELECT repo_id, count(*) FILTER (WHERE review_policy = 'CONTEXT_REQUIRED') AS wanted, count(*) FILTER (WHERE review_policy = 'CONTEXT_REQUIRED' AND status = 'NOT_REVIEWED') AS lft,
 count(*) FILTER (WHERE review_policy = 'CONTEXT_REQUIRED' AND status <> 'NOT_REVIEWED' AND source = 'AI') AS done, bool_or(review_policy = 'CONTEXT_REQUIRED' AND file IS NULL) AS failed FROM gated GROUP BY repo_id)
SELECT repo_id, CASE WHEN wanted = 0 THEN 'unnecessary' WHEN lft = 0 AND NOT failed THEN 'complete' WHEN done > 0 THEN 'partial' WHEN failed THEN 'unavailable' ELSE 'partial' END AS state FROM s""",
    "e6_contract": """WITH r AS (SELECT DISTINCT ON (id) id, upper(trim(rule_id)) AS rule_id, review_policy, observation, hypothesis FROM findings)
SELECT rule_id, count(*) AS broken FROM r WHERE review_policy = 'CONTEXT_REQUIRED' AND (coalesce(trim(observation), '') = '' OR coalesce(trim(hypothesis), '') = '') GROUP BY rule_id""",
    "e7_finding_order": f"WITH {NORM} SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY rule_id NULLS FIRST, file NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST, title NULLS FIRST, id) AS place FROM norm",
    "f1_normalise": f"WITH {NORM} SELECT id, rule_id, severity, confidence, observation, hypothesis, review_policy, CASE WHEN code_snippet IS NULL THEN NULL ELSE least(20, len(string_split(code_snippet, chr(10)))) END AS snippet_lines FROM norm",
    "f2_content_ids": f"""WITH {NORM}, t AS (SELECT id, concat_ws(chr(0), coalesce(rule_id, ''), coalesce(file, ''), coalesce(CAST(start_line AS VARCHAR), ''), coalesce(CAST(end_line AS VARCHAR), ''), coalesce(title, '')) AS head,
 list_transform(coalesce(steps, []), lambda s: concat_ws(chr(0), coalesce(s.kind, ''), coalesce(s.file, ''), coalesce(CAST(s.line AS VARCHAR), '0'), coalesce(s.expression, ''))) AS st FROM norm)
SELECT id, substr(sha256(CASE WHEN len(st) > 0 THEN head || chr(0) || array_to_string(st, chr(0)) ELSE head END), 1, 16) AS content_id FROM t""",
    "f4_gate": f"WITH {GATE} SELECT id, status, source, final_severity, round(final_confidence, 6) AS final_confidence, accepted FROM gated",
    "f8_filter": f"WITH {NORM} SELECT id, severity, category FROM norm WHERE sev >= 4 AND lower(category) = 'security'",
    "v1_eligible": f"WITH {NORM} SELECT id, {SMART} AS smart, review_policy <> 'STATIC_AUTHORITATIVE' AS everything FROM norm",
    "w1_diverse_order": f"WITH {NORM}, {_sql_order('scan_id')} SELECT scan_id, id, round, turn FROM r JOIN b USING (scan_id, rule_id)",
    "w2_rule_cap": f"WITH {NORM}, {_sql_order('scan_id')} SELECT scan_id, rule_id, id FROM r WHERE round <= 10",
    "w3_human_order": f"""WITH {NORM}, p AS (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY sev DESC, confidence DESC, coalesce(TRY_CAST(regexp_extract(title, '\\((\\d+)[^()]*\\)[^()]*$', 1) AS INT), 0) DESC, file NULLS FIRST, id) AS place FROM norm WHERE rule_id IS NOT NULL)
SELECT repo_id, rule_id, id, place FROM p WHERE category <> 'Maintainability' OR category IS NULL OR place <= 25""",
    "w7_sequence_ids": "SELECT item_id, concat_ws('.', kind, CAST(row_number() OVER (PARTITION BY finding_id, kind ORDER BY item_id) AS VARCHAR)) AS evidence_id FROM (SELECT DISTINCT item_id, finding_id, kind FROM evidence_items)",
}
