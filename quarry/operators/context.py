"""What a reviewer is shown beside a finding: evidence from facts, traces, graph, lines and comments, within limits.

Evidence of all findings is one table of items; limits are ranks and running sums
in windows over it, so no packet is assembled before it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import excerpt
from quarry.session import materialize

# The kind of evidence a kind of fact is shown as, any other is a symbol; how long a kind is kept; limits of a packet.
EVIDENCE_KINDS = {
    "guard": "guard", "sanitizer": "guard", "propagation": "provenance", "source": "provenance", "sink": "provenance", "return": "provenance",
    "resource_acquire": "lifecycle", "resource_release": "lifecycle", "concurrency_operation": "lifecycle",
}
CRITICAL, SUPPORTING, GENERIC = 3, 2, 1
RETENTION = {"primary": CRITICAL, "guard": CRITICAL, "provenance": CRITICAL, "lifecycle": CRITICAL, "comment": CRITICAL, "enclosing": SUPPORTING}
LIMITS = {"lines": 120, "primary_lines": 12, "symbols": 12, "callers": 4, "callees": 4, "depth": 2, "steps": 12, "items": 32, "tokens": 32 * 1024}
ITEM = ["finding_id", "kind", "file", "start_line", "end_line", "symbol", "content", "fact_id", "required", "retention", "section", "place"]


def evidence_kind(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EVIDENCE_KINDS.items() for x in kv])[kind], F.lit("symbol"))


def _items(rows: DataFrame, section: int, kind: Column, content: Column, required: Column, place: Column, retention: Column | None = None, symbol: Column | None = None, fact: Column | None = None, at: tuple[Column, Column] | None = None) -> DataFrame:
    usual = F.coalesce(F.create_map(*[F.lit(x) for kv in RETENTION.items() for x in kv])[kind], F.lit(GENERIC))
    start, end = at or (F.col("start_line"), F.col("end_line"))
    none = F.lit(None).cast("string")
    return rows.select(
        "finding_id", kind.alias("kind"), "file", start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), (symbol if symbol is not None else none).alias("symbol"), content.alias("content"), (fact if fact is not None else none).alias("fact_id"), required.alias("required"), F.coalesce(retention, usual).alias("retention") if retention is not None else usual.alias("retention"), F.lit(section).alias("section"), place.cast("bigint").alias("place")
    )


def innermost_function(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """findings with `fn`: name, fn_start, fn_end of the function around their line that starts last."""
    spans = functions.select("file", F.col("name").alias("fn"), F.col("start_line").alias("fn_start"), F.col("end_line").alias("fn_end"))
    met = findings.select("finding_id", "file", F.col("start_line").alias("_l")).join(spans, "file").filter((F.col("fn_start") <= F.col("_l")) & ((F.col("fn_end") == 0) | (F.col("_l") <= F.col("fn_end"))))
    best = met.groupBy("finding_id").agg(F.min_by(F.struct("fn", "fn_start", "fn_end"), F.struct(-F.col("fn_start"), "fn")).alias("f"))
    return findings.join(best.select("finding_id", "f.*"), "finding_id", "left")


def evidence(findings: DataFrame, files: DataFrame, facts: DataFrame, functions: DataFrame, traces: DataFrame, callers: DataFrame, callees: DataFrame, nodes: DataFrame, ecosystems: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """All evidence items of the findings, before the packet's own limits.

    findings: finding_id, rule_id, file, start_line, end_line, steps, symbols.
    files: file, content. facts: as `semantic_facts` gives them. functions: file,
    name, start_line, end_line. traces: source_id, sink_id, path. callers,
    callees: file, fn, node, name, kind, start_line, end_line, rank. nodes: file,
    name, kind, start_line, end_line. ecosystems: file, ecosystem. Findings
    without a place, or whose file or line is not there, have no items.
    """
    lim = LIMITS | (limits or {})
    f = findings.filter("file is not null and start_line > 0").select("finding_id", "rule_id", "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "steps", "symbols")
    seen = f.join(files.filter("content is not null and content <> ''").select("file", "content"), "file").filter(F.col("start_line") <= F.size(F.split("content", "\n")))
    seen = materialize(innermost_function(seen, functions), "findings")
    true, false = F.lit(True), F.lit(False)
    head = F.least(F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)), F.lit(lim["primary_lines"]))
    primary = _items(seen, 0, F.lit("primary"), excerpt(F.col("content"), F.col("start_line"), F.col("end_line"), lim["primary_lines"]), true, F.lit(0))

    s = F.col("s")
    steps = seen.select("finding_id", "file", F.posexplode("steps").alias("n", "s"))
    kinds = {"iteration": "lifecycle", "post_use": "lifecycle", "architecture_import": "primary", "architecture_basis": "provenance"}
    told = steps.filter(F.col("s.kind").isin(*kinds)).withColumn("file", s["file"])
    given = _items(told, 1, F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[s["kind"]], F.coalesce(F.nullif(s["expression"], F.lit("")), s["message"]), true, F.col("n"), F.lit(CRITICAL), at=(s["line"], s["line"]))

    around = seen.filter("fn is not null").withColumn("take", F.least(F.col("fn_end") - F.col("fn_start") + 1, F.lit(lim["lines"]) - head).cast("int")).filter("take > 0")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("fn_start"), F.col("take")), "\n")
    enclosing = _items(around, 2, F.lit("enclosing"), body, false, F.lit(0), symbol=F.col("fn"), at=(F.col("fn_start"), F.col("fn_end")))

    facts_ = facts.filter("kind not in ('function', 'import', 'symbol')").select("file", "id", F.col("kind").alias("fact_kind"), F.col("function").alias("fact_function"), F.coalesce(F.nullif("expression", F.lit("")), F.col("operation")).alias("shown"), F.col("start_line").alias("l"), F.col("end_line").alias("e"), F.col("start_column").alias("c"), "inputs", "outputs", "metadata", "expression")
    near = lambda by: (F.col("l") >= F.col("start_line") - by) & (F.col("l") <= F.col("end_line") + by)
    spoken = F.exists(F.coalesce(F.transform("steps", lambda x: x["expression"]), F.array().cast("array<string>")), lambda x: (x != "") & (x == F.col("expression")))
    own = seen.drop("content").join(facts_, "file").filter(F.col("fn").isNull() | (F.col("fact_function") == "") | (F.col("fact_function") == F.col("fn")))
    needed = F.coalesce(near(1) | spoken, false)
    bound = F.try_element_at("metadata", F.lit("loop_bound"))
    extra = F.when(F.coalesce(bound, F.lit("")) != "", F.concat_ws("\n", F.concat("shown", F.lit("\nloop_bound="), bound), F.when(F.coalesce(F.try_element_at("metadata", F.lit("loop_expression")), F.lit("")) != "", F.concat(F.lit("loop_expression="), F.try_element_at("metadata", F.lit("loop_expression")))))).otherwise(F.col("shown"))
    from_facts = _items(own, 4, evidence_kind(F.col("fact_kind")), extra, needed, F.col("l") * 4096 + F.col("c"), F.when(needed, F.lit(CRITICAL)), F.col("fact_function"), F.col("id"), (F.col("l"), F.col("e")))

    by_id = facts_.select(F.col("id").alias("member"), F.col("shown"), "l", "e", "fact_function", "inputs", "outputs", "expression", F.col("file").alias("at_file"))
    chain = traces.select("source_id", "sink_id", F.posexplode(F.concat(F.array("source_id"), "path", F.array("sink_id"))).alias("n", "member"), (F.size("path") + 1).alias("last"))
    sinks = facts_.select(F.col("id").alias("sink_id"), "file", F.col("fact_function").alias("sink_function"))
    met = seen.drop("content").join(sinks, "file").filter(F.col("fn").isNull() | (F.col("sink_function") == "") | (F.col("sink_function") == F.col("fn"))).join(chain, "sink_id").join(by_id, "member")
    touches = F.coalesce((near(2) & (F.col("at_file") == F.col("file"))) | spoken | F.arrays_overlap(F.concat("inputs", "outputs"), "symbols"), false)
    related = met.groupBy("finding_id", "source_id", "sink_id").agg(F.bool_or(touches).alias("r")).filter("r").select("finding_id", "source_id", "sink_id")
    hops = met.join(related, ["finding_id", "source_id", "sink_id"])
    once = Window.partitionBy("finding_id", "member").orderBy("source_id", "sink_id", "n")
    hops = hops.withColumn("k", F.row_number().over(once)).filter("k = 1").withColumn("k", F.row_number().over(Window.partitionBy("finding_id").orderBy("sink_id", "source_id", "n"))).filter(F.col("k") <= lim["steps"])
    role = F.when(F.col("n") == 0, "source: ").when(F.col("n") == F.col("last"), "sink: ").otherwise("propagation: ")
    flow = _items(hops, 3, F.lit("provenance"), F.concat(F.lit("dataflow "), role, F.col("shown")), true, F.col("k"), symbol=F.col("fact_function"), fact=F.col("member"), at=(F.col("l"), F.col("e")))

    def relation(rows: DataFrame, kind: str, section: int, most: int) -> DataFrame:
        met = seen.filter("fn is not null").select("finding_id", "file", "fn").join(rows.filter(F.col("rank") <= most), ["file", "fn"])
        return _items(met, section, F.lit(kind), F.concat_ws(" ", F.col("kind"), F.col("name")), false, F.col("rank"), symbol=F.col("name"))

    wanted = seen.select("finding_id", F.explode(F.array_distinct("symbols")).alias("name"))
    defined = wanted.join(nodes, "name").withColumn("k", F.row_number().over(Window.partitionBy("finding_id").orderBy("file", "start_line", "name", "kind"))).filter(F.col("k") <= lim["symbols"])
    symbols = _items(defined, 7, F.lit("symbol"), F.concat(F.col("kind"), F.lit(" definition")), false, F.col("k"), symbol=F.col("name"))

    first = F.greatest(F.col("start_line") - 3, F.lit(1))
    lines = seen.select("finding_id", "file", first.alias("first"), F.posexplode(F.slice(F.split("content", "\n"), first, (F.col("start_line") + 2 - first).cast("int"))).alias("n", "line"))
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    notes = lines.filter(text.startswith("//") | text.startswith("#") | F.lower(text).contains("nolint"))
    comments = _items(notes, 8, F.lit("comment"), text, true, F.col("n"), at=(F.col("first") + F.col("n"), F.col("first") + F.col("n")))
    used = _items(seen.select("finding_id", "file", "start_line", "end_line").join(ecosystems, "file"), 9, F.lit("ecosystem"), F.col("ecosystem"), false, F.lit(0))
    parts = [primary, given, enclosing, flow, from_facts, relation(callers, "caller", 5, lim["callers"]), relation(callees, "callee", 6, lim["callees"]), symbols, comments, used]
    return reduce(DataFrame.unionByName, parts).filter("content <> ''")


def packets(findings: DataFrame, items: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(finding_id, evidence, items, tokens, truncated, sufficiency): each finding's evidence within the limits of a packet.

    Evidence is given up by least retention first, of equal retention what is not
    required, then what comes first; the primary one last. Ids are the kind and
    its number in the order of sections, places and contents. A finding without
    primary evidence, or that loses required evidence, is INSUFFICIENT; one that
    loses other evidence, or has no enclosing function, INCOMPLETE.
    """
    lim = LIMITS | (limits or {})
    order = Window.partitionBy("finding_id", "kind").orderBy("section", "place", "content", "fact_id")
    rows = items.withColumn("id", F.concat_ws(".", "kind", F.row_number().over(order).cast("string")))
    size = F.octet_length("content") + F.octet_length("id") + 40
    keep = Window.partitionBy("finding_id").orderBy(F.when(F.col("kind") == "primary", 0).otherwise(1), F.desc("retention"), F.desc("required"), F.desc("section"), F.desc("place"), "id")
    rows = rows.withColumns({"k": F.row_number().over(keep), "bytes": F.sum(size).over(keep.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("kept", (F.col("k") <= lim["items"]) & ((F.col("bytes") + 3) / 4 <= lim["tokens"]))
    each = F.struct("section", "place", "id", "kind", "file", "start_line", "end_line", "symbol", "content", "fact_id", "required")
    grouped = rows.groupBy("finding_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), each))).alias("evidence"), F.max(F.when(F.col("kept"), F.col("bytes"))).alias("bytes"), F.bool_or(~F.col("kept")).alias("truncated"), F.bool_or(~F.col("kept") & F.col("required")).alias("lost"), F.bool_or(F.col("kind") == "primary").alias("has_primary"), F.bool_or(F.col("kind") == "enclosing").alias("has_function")
    )
    missing = findings.select("finding_id", F.exists(F.coalesce(F.transform("steps", lambda x: x["kind"]), F.array().cast("array<string>")), lambda k: k.isin("architecture_policy_missing", "hypothesis_evidence_missing")).alias("premise"))
    out = missing.join(grouped, "finding_id", "left")
    no = F.lit(False)
    state = F.when(~F.coalesce("has_primary", no) | F.coalesce("lost", no) | F.coalesce("premise", no), "INSUFFICIENT").when(F.coalesce("truncated", no) | ~F.coalesce("has_function", no), "INCOMPLETE").otherwise("SUFFICIENT")
    return out.select("finding_id", "evidence", F.coalesce(F.size("evidence"), F.lit(0)).alias("items"), F.floor((F.coalesce("bytes", F.lit(0)) + 3) / 4).alias("tokens"), F.coalesce("truncated", no).alias("truncated"), state.alias("sufficiency"))


def minimised(items: DataFrame, budget: int) -> DataFrame:
    """Evidence items (finding_id, id, kind, content, required, retention) within `budget` tokens, the last resort shrinking what remains by quarters."""
    size = F.octet_length("content") + F.octet_length("id") + 40
    keep = Window.partitionBy("finding_id").orderBy(F.when(F.col("kind") == "primary", 0).otherwise(1), F.desc("retention"), F.desc("required"), F.desc("id"))
    rows = items.withColumns({"k": F.row_number().over(keep), "bytes": F.sum(size).over(keep.rowsBetween(Window.unboundedPreceding, 0))}).filter((F.col("k") == 1) | ((F.col("bytes") + 3) / 4 <= budget))
    room = F.greatest(F.lit(4 * budget) - F.octet_length("id") - 40, F.lit(32))
    quarters = F.ceil(F.log(room / F.octet_length("content")) / F.log(F.lit(0.75)))
    short = F.floor(F.octet_length("content") * F.pow(F.lit(0.75), F.greatest(quarters, F.lit(0)))).cast("int")
    return rows.withColumn("content", F.when((F.col("k") == 1) & ((F.col("bytes") + 3) / 4 > budget), F.substring(F.col("content"), F.lit(1), F.greatest(short, F.lit(24)))).otherwise(F.col("content"))).drop("k", "bytes")
