"""Queries over the semantic facts of source files and the rules on them.

SQL cannot parse source files, so these have none; fixtures for each language
and rule stand in `tests/test_rules.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract.facts import semantic_facts
from quarry.extract.structure import records
from quarry.functions.text import classify_language, ecosystem
from quarry.operators import context, graph, rules, taint
from quarry.session import materialize
from quarry.tables import table


def source_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all files, each delivered file once, with the repository as `repo`; files are told apart by repository and path."""
    files = table(spark, folder, "files").dropDuplicates(["file_id"]).withColumn("language", classify_language(F.col("rel_path"), F.col("content")))
    files = files.withColumn("whole", F.concat_ws(":", F.col("file_id").cast("string"), "path"))
    return semantic_facts(files, path="whole").join(files.select("file_id", F.col("repo_id").cast("string").alias("repo")), "file_id")


def written_facts(spark: SparkSession, folder: str) -> DataFrame:
    """`source_facts` read once and written, for plans that look at them more than once."""
    return materialize(source_facts(spark, folder), "facts")


def x8_facts(spark: SparkSession, folder: str) -> DataFrame:
    return source_facts(spark, folder).filter("kind not in ('function', 'import', 'symbol')").select("file_id", "id", "kind", "operation", "function", "start_line", "start_column", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"))


def i2_fact_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of each file's facts as places: line, column, id."""
    from pyspark.sql import Window

    rows = source_facts(spark, folder).filter("kind not in ('function', 'import', 'symbol')")
    return rows.select("file_id", "id", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "start_column", "id")).alias("place"))


def d2_source_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces over the facts of source files, calls followed within each repository."""
    facts = written_facts(spark, folder)
    functions = facts.filter("kind = 'function'").select("repo", "file", F.col("operation").alias("name"), F.col("arguments").alias("parameters"), "start_line")
    return taint.graded(taint.traces(facts.filter("kind not in ('function', 'import', 'symbol')"), functions)).select("source_id", "sink_id", "steps", "interprocedural", "confidence", "strength")


def e3_ecosystems(spark: SparkSession, folder: str) -> DataFrame:
    """What each repository uses, from the imports as the extractors read them."""
    imports = source_facts(spark, folder).filter("kind = 'import'").select("repo", F.col("operation").alias("path"))
    return rules.ecosystems(imports)


def e4_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the whole catalogue over all files."""
    found = rules.run(written_facts(spark, folder))
    return found.select("repo", "rule_id", "category", "severity", "title", "file", "start_line", "end_line", "confidence", "strength", F.array_join("call_chain", " > ").alias("call_chain"), F.size("steps").alias("steps"))


def _graph(spark: SparkSession, folder: str, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and resolved calls of all files; ids begin with the file's id."""
    facts = written_facts(spark, folder) if facts is None else facts
    named = lambda kind: facts.filter(F.col("kind") == kind)
    files = facts.select("file").distinct()
    functions = named("function").select("file", F.col("operation").alias("name"), "receiver", "start_line", "end_line")
    kept = table(spark, folder, "files").dropDuplicates(["file_id"]).withColumn("language", classify_language(F.col("rel_path"), F.col("content")))
    types = records(kept).filter("kind = 'type'").join(kept.select("file_id", F.concat_ws(":", F.col("file_id").cast("string"), "path").alias("file")), "file_id").select("file", "name", "start_line", "end_line")
    imports = named("import").select("file", F.col("operation").alias("path"), F.col("expression").alias("alias"))
    symbols = named("symbol").select("file", F.col("operation").alias("name"), F.col("expression").alias("kind"))
    nodes, edges = graph.build(files, functions, types, imports, symbols)
    fn = functions.select(F.concat_ws(":", "file", F.when(F.col("receiver") == "", F.col("name")).otherwise(F.concat_ws(".", "receiver", "name"))).alias("node_id"), "file", "name", F.nullif("receiver", F.lit("")).alias("receiver"))
    calls = named("call").select(F.col("id").alias("call_id"), "file", F.when(F.col("receiver") == "", F.col("function")).otherwise(F.concat_ws(".", "receiver", "function")).alias("caller"), F.element_at(F.split("operation", r"\\.|::"), -1).alias("callee"), F.lit(None).cast("string").alias("receiver"))
    return nodes, edges, graph.resolve_calls(calls, fn)


def g2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the code graph: files, functions, methods, types, imports, symbols."""
    return _graph(spark, folder)[0]


def g3_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Contains, Imports and Calls edges; parallel ones stay."""
    _, edges, calls = _graph(spark, folder)
    return edges.unionByName(calls.select(F.lit("Calls").alias("kind"), F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")))


def q3_methods(spark: SparkSession, folder: str) -> DataFrame:
    return graph.of_kind(_graph(spark, folder)[0], "Method")


def q5_stats(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges, calls = _graph(spark, folder)
    return graph.stats(nodes, edges.unionByName(calls.select(F.lit("Calls").alias("kind"), F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))))


def c1_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of the findings of the catalogue over all files."""
    facts = written_facts(spark, folder)
    shared = rules.Context(facts)
    found = rules.run(shared).withColumn("finding_id", F.substring(F.sha2(F.concat_ws("\0", "rule_id", "file", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "title", "snippet"), 256), 1, 16)).dropDuplicates(["finding_id"])
    found = materialize(found.select("finding_id", "rule_id", "file", "start_line", "end_line", "steps", "symbols"), "findings")
    files = table(spark, folder, "files").dropDuplicates(["file_id"]).select(F.concat_ws(":", F.col("file_id").cast("string"), "path").alias("file"), "content")
    functions = facts.filter("kind = 'function'").select("repo", "file", F.col("operation").alias("name"), F.col("arguments").alias("parameters"), "start_line", "end_line")
    nodes, _, calls = _graph(spark, folder, facts)
    nodes, calls = materialize(nodes, "nodes"), materialize(calls, "calls")
    place = nodes.filter("kind in ('Function', 'Method')").select(F.col("id").alias("node"), "name", "kind", "file", "start_line", "end_line")
    e = calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    wanted = found.select("file").distinct().join(place, "file").select(F.col("node").alias("start"), "file", F.col("name").alias("fn"))

    def related(reverse: bool) -> DataFrame:
        met = graph.relations(e, wanted.select("start"), context.LIMITS["depth"], context.LIMITS["callers"], reverse)
        return met.join(wanted, "start").select("file", "fn", "node", "rank").join(place.drop("file"), "node")

    traces = shared.traces().select("source_id", "sink_id", "path")
    known = facts.filter("kind = 'import'").select("file", ecosystem(F.col("operation")).alias("ecosystem")).filter("ecosystem is not null").distinct()
    items = context.evidence(found, files, facts, functions, traces, related(True), related(False), nodes.select("file", "name", "kind", "start_line", "end_line"), known)
    return context.packets(found, items).select("finding_id", "items", "tokens", "truncated", "sufficiency", F.array_join(F.transform("evidence", lambda x: x["id"]), ",").alias("evidence_ids"))


def e8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The registered rules, active or not."""
    return spark.createDataFrame([(r.id, r.category, r.severity, r.pattern, ",".join(r.requires), r.policy) for r in rules.RULES], "rule_id string, category string, severity string, pattern string, requires string, review_policy string")


QUERIES = {f.__name__: f for f in (x8_facts, i2_fact_order, d2_source_traces, e3_ecosystems, e4_findings, g2_nodes, g3_edges, q3_methods, q5_stats, c1_packets, e8_rules)}
ORACLE: dict[str, str] = {}
