"""Review planning under budgets, and what becomes of the answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import CREDENTIAL_VALUE, CREDENTIALS

# Budgets of a scan's review, the size of a batch, and the estimate's constants.
BUDGET = {"findings": 40, "requests": 6, "input": 60_000, "output": 16_000}
BATCH_INPUT, BATCH_OUTPUT = 8_000, 2_048
BATCH_OVERHEAD, OUT_BASE, OUT_EACH = 32, 64, 384


class _Budget:
    """What a scan has selected so far."""

    def __init__(self, budget: dict[str, int], capped: bool) -> None:
        self.budget, self.cap = budget, max(2, budget["findings"] // 4) if capped else None
        self.batch = self.count = self.used_in = self.used_out = self.chosen = 0
        self.size = BATCH_OVERHEAD
        self.rules: dict[str, int] = {}

    def take(self, rule: str, tokens: int, enough: bool) -> int | str:
        """The number of the candidate's batch, or why it is skipped."""
        budget = self.budget
        if self.cap is not None and self.rules.get(rule, 0) >= self.cap:
            return "NOT_ELIGIBLE"
        if self.chosen >= budget["findings"]:
            return "BUDGET_EXHAUSTED"
        batch_in, batch_out = min(BATCH_INPUT, budget["input"]), min(BATCH_OUTPUT, budget["output"])
        if not enough or BATCH_OVERHEAD + tokens > batch_in or OUT_BASE + OUT_EACH > batch_out:
            return "CONTEXT_INSUFFICIENT"
        fresh = self.count == 0 or self.size + tokens > batch_in or OUT_BASE + OUT_EACH * (self.count + 1) > batch_out
        cost_in = tokens + (BATCH_OVERHEAD if fresh else 0)
        cost_out = OUT_EACH + (OUT_BASE if fresh else 0)
        if (fresh and self.batch + (self.count > 0) >= budget["requests"]) or self.used_in + cost_in > budget["input"] or self.used_out + cost_out > budget["output"]:
            return "BUDGET_EXHAUSTED"
        if fresh:
            self.batch += self.count > 0
            self.size, self.count = BATCH_OVERHEAD + tokens, 1
        else:
            self.size, self.count = self.size + tokens, self.count + 1
        self.used_in, self.used_out, self.chosen = self.used_in + cost_in, self.used_out + cost_out, self.chosen + 1
        self.rules[rule] = self.rules.get(rule, 0) + 1
        return self.batch + 1


def budgets(given: dict[str, int] | None = None) -> dict[str, int]:
    """The budgets of a review; a missing or non-positive one is the default."""
    return {k: (given or {}).get(k, 0) if (given or {}).get(k, 0) > 0 else v for k, v in BUDGET.items()}


def plan(ordered: DataFrame, key: str, budget: dict[str, int] | None = None, mode: str = "smart") -> DataFrame:
    """(key, id, batch, skip): greedy selection of candidates in order under four budgets.

    ordered: key, id, place, rule_id, tokens, enough, and, where some are not to
    be reviewed, contextual and eligible. Skipped are, in this order, candidates
    that need no review or are not eligible (NOT_ELIGIBLE; USER_DISABLED in mode
    off), those over their rule's share in mode smart (NOT_ELIGIBLE), over the
    number of findings (BUDGET_EXHAUSTED), without enough context or too large
    for a batch (CONTEXT_INSUFFICIENT), or over another budget
    (BUDGET_EXHAUSTED); the others get the number of their batch. The candidates
    of a scan stream by in order, with one scan's state at a time, so neither a
    large scan nor many small ones are held.
    """
    kind, limits = ordered.schema[key].dataType.simpleString(), budgets(budget)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in ordered.columns else F.lit(True)
    rows = ordered.select(key, "id", F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.col("tokens").cast("bigint").alias("tokens"), F.coalesce("enough", F.lit(False)).alias("enough"), flag("contextual").alias("contextual"), flag("eligible").alias("eligible"), "place")
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "place", "id")

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, state = object(), _Budget(limits, mode == "smart")
        for part in parts:
            out: list[int | str] = []
            for k, rule, tokens, enough, contextual, fit in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if k != scan:
                    scan, state = k, _Budget(limits, mode == "smart")
                if not contextual:
                    out.append("NOT_ELIGIBLE")
                elif mode == "off":
                    out.append("USER_DISABLED")
                else:
                    out.append(state.take(rule, tokens or 0, enough) if fit else "NOT_ELIGIBLE")
            batch, skip = [x if type(x) is int else None for x in out], [x if type(x) is str else None for x in out]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(batch, pa.int32()), pa.array(skip, pa.string())], names=[key, "id", "batch", "skip"])

    return sorted_rows.mapInArrow(choose, f"`{key}` {kind}, id string, batch int, skip string")


def match_answers(requests: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """(group, complete): whether the answers name exactly the requested ids, each once."""
    asked = requests.groupBy(group).agg(F.sort_array(F.collect_set("id")).alias("asked"))
    given = answers.groupBy(group).agg(F.sort_array(F.collect_list("id")).alias("given"))
    return asked.join(given, group, "left").select(group, F.coalesce(F.col("asked") == F.col("given"), F.lit(False)).alias("complete"))


def cited_evidence(answers: DataFrame, offered: DataFrame) -> DataFrame:
    """Answers with `valid_ids`, the cited ids that were offered, and `accepted`: a decisive verdict cites at least one and none invented.

    answers: id, decisive, cited array. offered: id, offered array.
    """
    rows = answers.join(offered, "id", "left")
    have = F.coalesce("offered", F.array().cast("array<string>"))
    valid = F.array_intersect("cited", have)
    invented = F.size(F.array_except("cited", have)) > 0
    return rows.withColumn("valid_ids", valid).withColumn("accepted", ~F.col("decisive") | ((F.size(valid) > 0) & ~invented)).drop("offered")


def redact_batches(items: DataFrame, group: str, key: str, texts: list[str]) -> DataFrame:
    """The items with the credentials of their texts replaced by `<REDACTED_SECRET_n>`, equal ones of a batch by the same mark.

    Numbers go by first appearance in the order of `key` and of `texts`. A
    batch is one request, small by its budget, and is read in one piece. Null
    texts stay null.
    """
    patterns = [re.compile(CREDENTIAL_VALUE), *map(re.compile, CREDENTIALS)]

    def clean(batch: pd.DataFrame) -> pd.DataFrame:
        marks: dict[str, str] = {}
        mark = lambda secret: marks.setdefault(secret, f"<REDACTED_SECRET_{len(marks) + 1}>")
        out = batch.sort_values(key, kind="stable").copy()
        for i in out.index:
            for c in texts:
                text = out.at[i, c]
                if isinstance(text, str):
                    text = patterns[0].sub(lambda m: m[1] + mark(m[2]) + m[3], text)
                    for p in patterns[1:]:
                        text = p.sub(lambda m: m[0] if m[0] in marks.values() else mark(m[0]), text)
                    out.at[i, c] = text
        return out

    return items.groupBy(group).applyInPandas(clean, items.schema)
