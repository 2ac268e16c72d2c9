"""What a reviewer's answers become: decoded, checked against what was asked, and turned into bounded decisions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.severity import severity_rank
from quarry.operators.findings import severity_name

_TRAILING = re.compile(r",(\s*[\]}])")
ANSWER = "id string, relation string, strength string, severity string, confidence double, reason string, recommendation string, evidence_ids array<string>, has_severity boolean, has_confidence boolean, broken string"


def _unfence(text: str) -> str:
    t = (text or "").strip()
    if not t:
        raise ValueError("no review content")
    if not t.startswith("```"):
        return t
    head, nl, rest = t[3:].partition("\n")
    if not nl or not rest.endswith("```") or head.strip().lower() not in ("", "json"):
        raise ValueError("malformed or unsupported fence")
    return rest[:-3].strip()


def decode(text: str, asked: list[str]) -> list[dict]:
    """The answers in the order asked, from an array, {"assessments": [...]} or, for one finding, a single object.

    A code fence around it and commas before a closing bracket are passed over.
    ValueError unless each id asked for is answered exactly once and no other is.
    """
    value = json.loads(_TRAILING.sub(r"\1", _unfence(text)))
    if isinstance(value, dict):
        rows = value["assessments"] if isinstance(value.get("assessments"), list) else [value] if len(asked) == 1 else None
        if rows is None:
            raise ValueError(f"one object for {len(asked)} findings")
    else:
        rows = value
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows) or len(rows) != len(asked):
        raise ValueError("the number of answers is not that of the findings")
    by: dict[str, dict] = {}
    for r in rows:
        key = r.get("id")
        if not isinstance(key, str) or not key or key in by:
            raise ValueError("an id is empty or repeated")
        by[key] = r
    if set(by) != set(asked):
        raise ValueError("an id is missing")
    return [by[a] for a in asked]


def answers(replies: DataFrame, key: str, content: str, asked: str) -> DataFrame:
    """(key, answer columns): one row for each id asked for; `broken` tells why a whole reply cannot be used.

    asked: array of ids, as requests are small by their budget. Null replies are broken.
    """
    kind = replies.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, (text, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    found = [(r, None) for r in decode(text, ids or [])]
                except (ValueError, RecursionError) as e:
                    found = [({"id": x}, str(e) or "unreadable") for x in ids or []]
                for r, broken in found:
                    text_ = lambda k: r[k] if isinstance(r.get(k), str) else None  # noqa: B023, E731
                    number = r.get("confidence")
                    cited = r.get("evidence_ids")
                    take.append(i)
                    rows.append((r["id"], text_("evidence_relation"), text_("claim_strength"), text_("severity"), float(number) if isinstance(number, int | float) and not isinstance(number, bool) else None, text_("reason"), text_("recommendation"), [x for x in cited if isinstance(x, str)] if isinstance(cited, list) else [], "severity" in r, "confidence" in r, broken))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 11
            types = [pa.string()] * 4 + [pa.float64()] + [pa.string()] * 2 + [pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(x.split(" ")[0] for x in ANSWER.split(", "))])

    return replies.select(key, content, asked).mapInArrow(read, f"`{key}` {kind}, {ANSWER}")


def status_of(relation: Column, strength: Column) -> Column:
    """CONFIRMED, DOWNGRADED, UNSUPPORTED or UNCERTAIN; null where relation and strength do not go together."""
    r, s = F.upper(F.trim(F.coalesce(relation, F.lit("")))), F.upper(F.trim(F.coalesce(strength, F.lit(""))))
    return (
        F.when((r == "SUPPORTS") & (s == "UNCHANGED"), "CONFIRMED")
        .when((r == "SUPPORTS") & (s == "LOWER"), "DOWNGRADED")
        .when((r == "CONTRADICTS") & (s == ""), "UNSUPPORTED")
        .when((r == "INSUFFICIENT") & (s == ""), "UNCERTAIN")
    )


def decide(candidates: DataFrame, given: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """(finding_id, status, source, severity, confidence, reason, recommendation, evidence_ids, malformed): decisions as `findings.gate` takes them.

    candidates: id, severity, confidence. given: the columns of `ANSWER`.
    offered: id, offered array of evidence ids; without it citations are not
    checked. Malformed is an answer whose relation and strength do not go
    together, whose severity is unknown, whose confidence lies outside 0..1,
    that says more or less than its relation allows, lacks a reason, claims
    UNCHANGED but lowers or LOWER but does not, or is decisive without citing,
    or citing what was not offered; it becomes UNCERTAIN with the candidate's
    own severity and confidence. No answer raises either.
    """
    own = candidates.select(F.col("id").alias("finding_id"), F.col("severity").alias("_sev"), F.col("confidence").alias("_conf"))
    rows = given.withColumnRenamed("id", "finding_id").join(own, "finding_id")
    status = status_of(F.col("relation"), F.col("strength"))
    supports = F.coalesce(status.isin("CONFIRMED", "DOWNGRADED"), F.lit(False))
    named = F.coalesce(F.trim("severity"), F.lit("")) != ""
    sev, bound = severity_rank(F.col("severity")), severity_rank(F.col("_sev"))
    conf = F.when(supports, F.coalesce("confidence", F.lit(0.0))).otherwise(F.lit(0.0))
    lowered = (named & (sev < bound)) | (conf < F.col("_conf"))
    why = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(named & (sev == 0), "unknown severity")
        .when(status.isNull(), "relation and strength do not go together")
        .when(~F.coalesce(F.coalesce("confidence", F.lit(0.0)).between(0.0, 1.0), F.lit(False)), "confidence must be between 0 and 1")
        .when(~supports & (F.col("has_severity") | F.col("has_confidence")), "severity and confidence belong to SUPPORTS only")
        .when(supports & ~(F.col("has_severity") & F.col("has_confidence")), "SUPPORTS needs severity and confidence")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "the reason is missing")
        .when((status == "CONFIRMED") & lowered, "UNCHANGED conflicts with a lower severity or confidence")
        .when((status == "DOWNGRADED") & ~lowered, "LOWER needs a lower severity or confidence")
    )
    cited = F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    if offered is not None:
        rows = rows.join(offered.select(F.col("id").alias("finding_id"), "offered"), "finding_id", "left")
        have = F.coalesce("offered", F.array().cast("array<string>"))
        decisive = F.coalesce(status.isin("CONFIRMED", "DOWNGRADED", "UNSUPPORTED"), F.lit(False))
        bad = decisive & ((F.size(F.array_except(cited, have)) > 0) | (F.size(F.array_intersect(cited, have)) == 0))
        why, cited = F.coalesce(why, F.when(bad, "a decisive answer must cite offered evidence only")), F.array_intersect(cited, have)
    rows = rows.withColumn("malformed", why)
    good = F.col("malformed").isNull()
    kept = F.when(named & (sev < bound), severity_name(F.col("severity"))).otherwise(F.col("_sev"))
    return rows.select(
        "finding_id", F.when(good, status).otherwise("UNCERTAIN").alias("status"), F.lit("AI").alias("source"), F.when(good, kept).otherwise(F.col("_sev")).alias("severity"), F.when(good, F.least(conf, F.col("_conf"))).otherwise(F.col("_conf")).alias("confidence"),
        F.when(good, F.col("reason")).otherwise(F.concat(F.lit("Malformed answer: "), F.col("malformed"), F.lit("."))).alias("reason"), F.when(good, F.col("recommendation")).otherwise("").alias("recommendation"), F.when(good, cited).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), "malformed",
    )


def cache_key(columns: list[str]) -> Column:
    """SHA-256 over the redacted context and what the answer depends on, parted by NUL."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) with the answer of the cache, null where there is none or an invalid one; of several the last stored counts.

    cache: key, answer, valid, stored_at.
    """
    last = cache.filter("key is not null and valid").groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return requests.join(last, "key", "left")


def store(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh answers: well-formed ones only, one a key, the later one."""
    rows = cache.unionByName(fresh.filter("key is not null and valid"))
    return rows.groupBy("key").agg(F.max_by(F.struct("answer", "valid", "stored_at"), "stored_at").alias("r")).select("key", "r.*")
