"""Queries over facts and the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, lifecycle, taint
from quarry.plans.bridge import EDGES, FACTS, call_edges, facts
from quarry.tables import table


def p1_rule_fact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of a kind and operation as findings of a rule."""
    rows = facts(spark, folder).filter("kind = 'resource_acquire' and operation = 'r1'")
    return rows.select("id", F.lit("RES-ONE").alias("rule_id"), "file", "line", F.lit(0.85).alias("confidence"), F.lit("strong").alias("strength"))


def r5_unreleased(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.unreleased(facts(spark, folder)).select("id", "file", "function", "line", "output")


def r6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.leaks(facts(spark, folder)).select("id", "file", "function", "line", "output")


def r7_unchecked_iteration(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.unchecked_iteration(facts(spark, folder)).select("id", "file", "function", "line")


def r10_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.complexity(facts(spark, folder), ["propagation", "sink"], 10, 20)


def r16_undisturbed(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.undisturbed(facts(spark, folder), "resource_acquire", "propagation", "sink")


def r4_taint_by_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Traces into the sinks of one symbol, graded."""
    f = facts(spark, folder)
    sinks = f.filter("kind = 'sink' and input = 'v1'").select(F.col("id").alias("sink_id"))
    return taint.graded(taint.traces(f)).join(sinks, "sink_id", "left_semi").select("source_id", "sink_id", "confidence", "strength")


def r14_untraced_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Sinks that no trace reaches, as findings of low confidence."""
    f = facts(spark, folder)
    reached = taint.traces(f).select(F.col("sink_id").alias("id")).distinct()
    return f.filter("kind = 'sink'").join(reached, "id", "left_anti").select("id", F.lit("Info").alias("severity"), F.lit(0.5).alias("confidence"))


def d1_traces(spark: SparkSession, folder: str) -> DataFrame:
    return taint.traces(facts(spark, folder)).select("source_id", "sink_id", F.col("steps").cast("bigint").alias("steps"))


def d9_as_of(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder)
    versions = f.filter("output is not null").select("file", "function", F.col("output").alias("symbol"), "line", F.col("id").alias("value"))
    reads = f.filter("kind = 'sink'").select("id", "file", "function", F.col("input").alias("symbol"), "line")
    return lifecycle.as_of(versions, reads).select("id", "version_line", "value")


def d8_unambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Items resolved by the part's name, where one part alone, else one of the order's supplier, bears it."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    calls = table(spark, folder, "part").select(F.col("p_partkey").alias("call_id"), F.col("p_name").alias("callee"), F.col("p_brand").alias("file"))
    return taint.resolve(calls, parts)


def i1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("function").alias("functions"))


def q1_reach(spark: SparkSession, folder: str) -> DataFrame:
    """What every function that calls another reaches within three calls."""
    return graph.reach_dense(call_edges(spark, folder), 3).select("start", "node", F.col("distance").cast("bigint").alias("distance"))


def q2_called_by(spark: SparkSession, folder: str) -> DataFrame:
    e = call_edges(spark, folder)
    return graph.called_by(e, e.select(F.col("dst").alias("node")))


def q4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Simple paths of up to eleven nodes between the ends of every chain, in the graph of its scan."""
    f = table(spark, folder, "findings").dropDuplicates(["id"]).filter(F.size("call_chain") > 2)
    ends = f.select("scan_id", F.element_at("call_chain", 1).alias("src"), F.element_at("call_chain", -1).alias("dst")).filter("src is not null and dst is not null")
    return graph.simple_paths(call_edges(spark, folder, ["scan_id"]), ends, keys=["scan_id"]).select("scan_id", "src", "dst", F.array_join("path", ">").alias("path"))


def q5_most_called(spark: SparkSession, folder: str) -> DataFrame:
    return graph.most_called(call_edges(spark, folder))


def a11_graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = call_edges(spark, folder)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return e.agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("sites")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes")))


def g7_edge_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "findings").dropDuplicates(["id"]).filter(F.size("call_chain") > 1).select("scan_id", "id", "file", "start_line")
    order = [F.col(c).asc_nulls_first() for c in ("file", "start_line", "id")]
    return graph.edge_ids(rows, "scan_id", order).select("scan_id", "id", "edge_id")


def q7_enclosing(spark: SparkSession, folder: str) -> DataFrame:
    """For each line of a function the innermost of the spans around it; spans are runs of 40 and of 100 lines."""
    f = facts(spark, folder)
    points = f.filter("kind = 'sink'").select("id", F.col("function").alias("file"), "line")
    outer = f.groupBy(F.col("function").alias("file"), F.floor((F.col("line") - 1) / 40).alias("n")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    inner = f.groupBy(F.col("function").alias("file"), F.floor((F.col("line") - 1) / 10).alias("n")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    name = lambda p: F.concat(F.lit(p), F.col("n").cast("string")).alias("name")
    spans = outer.select("file", name("outer"), "start_line", "end_line").unionByName(inner.select("file", name("inner"), "start_line", "end_line"))
    return lifecycle.innermost(spans, points).select("id", "name")


_FLOW = FACTS + """,
kl AS (SELECT function, output AS symbol, line FROM facts WHERE kind = 'propagation' AND input IS NULL AND output IS NOT NULL),
fl AS (SELECT w.id AS from_id, r.id, r.kind FROM facts w JOIN facts r ON r.function = w.function AND r.input = w.output AND r.line >= w.line AND r.id <> w.id AND r.kind IN ('propagation', 'sink')
  WHERE w.kind IN ('source', 'propagation') AND NOT EXISTS (SELECT 1 FROM kl WHERE kl.function = w.function AND kl.symbol = w.output AND kl.line > w.line AND kl.line <= r.line)),
tr(source_id, pos, kind, steps) AS (
  SELECT s.id, f.id, f.kind, 0 FROM facts s JOIN fl f ON f.from_id = s.id WHERE s.kind = 'source'
  UNION SELECT t.source_id, f.id, f.kind, t.steps + 1 FROM tr t JOIN fl f ON f.from_id = t.pos WHERE t.kind = 'propagation' AND t.steps < 16),
traces AS (SELECT source_id, pos AS sink_id, min(steps) AS steps FROM tr WHERE kind = 'sink' GROUP BY ALL)
"""  # fmt: skip
_OPEN = """a AS (SELECT * FROM facts f WHERE kind = 'resource_acquire' AND NOT EXISTS (SELECT 1 FROM facts r WHERE r.kind = 'resource_release' AND r.file = f.file AND r.function = f.function AND r.operation = f.operation AND r.input = f.output AND r.line > f.line))"""

QUERIES = {f.__name__: f for f in (
    r5_unreleased, r6_leaks, r7_unchecked_iteration, r10_complexity, r16_undisturbed, r4_taint_by_sink, r14_untraced_sinks, d1_traces, d9_as_of, d8_unambiguous, i1_kinds,
    q1_reach, q2_called_by, q4_paths, q5_most_called, a11_graph_stats, g7_edge_ids, q7_enclosing,
)} | {"r1_fact_match": p1_rule_fact_match}

ORACLE = {
    "r1_fact_match": f"WITH {FACTS} SELECT id, 'RES-ONE' AS rule_id, file, line, CAST(0.85 AS DOUBLE) AS confidence, 'strong' AS strength FROM facts WHERE kind = 'resource_acquire' AND operation = 'r1'",
    "r5_unreleased": f"WITH {FACTS}, {_OPEN} SELECT id, file, function, line, output FROM a",
    "r6_leaks": f"WITH {FACTS}, {_OPEN} SELECT id, file, function, line, output FROM a WHERE NOT EXISTS (SELECT 1 FROM facts p WHERE p.kind = 'propagation' AND p.file = a.file AND p.function = a.function AND p.input = a.output AND p.line > a.line)",
    "r7_unchecked_iteration": f"""WITH {FACTS}, m AS (SELECT f.id, f.file, f.function, f.line, f.output, max(p.line) AS read FROM facts f JOIN facts p ON p.kind = 'propagation' AND p.function = f.function AND p.input = f.output AND p.line > f.line WHERE f.kind = 'resource_acquire' GROUP BY ALL)
SELECT id, file, function, line FROM m WHERE NOT EXISTS (SELECT 1 FROM facts r WHERE r.kind = 'resource_release' AND r.function = m.function AND r.input = m.output AND r.line > m.read)""",
    "r10_complexity": f"WITH {FACTS} SELECT file, function, count(*) + 1 AS complexity, max(line) AS line, CASE WHEN count(*) + 1 > 20 THEN 'High' ELSE 'Medium' END AS severity FROM facts WHERE kind IN ('propagation', 'sink') GROUP BY file, function HAVING count(*) + 1 > 10",
    "r16_undisturbed": f"""WITH {FACTS}, s AS (SELECT p.id AS second_id, p.file, p.function, p.line, (SELECT a.id FROM facts a WHERE a.kind = 'resource_acquire' AND a.function = p.function AND a.line < p.line ORDER BY a.line DESC LIMIT 1) AS first_id FROM facts p WHERE p.kind = 'propagation')
SELECT first_id, second_id, s.file, s.function FROM s JOIN facts a ON a.id = s.first_id WHERE NOT EXISTS (SELECT 1 FROM facts k WHERE k.kind = 'sink' AND k.function = s.function AND k.line > a.line AND k.line < s.line)""",
    "r4_taint_by_sink": f"WITH RECURSIVE {_FLOW} SELECT source_id, sink_id, CASE WHEN steps = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence, 'strong' AS strength FROM traces WHERE sink_id IN (SELECT id FROM facts WHERE kind = 'sink' AND input = 'v1')",
    "r14_untraced_sinks": f"WITH RECURSIVE {_FLOW} SELECT id, 'Info' AS severity, CAST(0.5 AS DOUBLE) AS confidence FROM facts WHERE kind = 'sink' AND id NOT IN (SELECT sink_id FROM traces)",
    "d1_traces": f"WITH RECURSIVE {_FLOW} SELECT source_id, sink_id, CAST(steps AS BIGINT) AS steps FROM traces",
    "d9_as_of": f"WITH {FACTS} SELECT r.id, v.line AS version_line, v.id AS value FROM (SELECT * FROM facts WHERE kind = 'sink') r ASOF JOIN (SELECT * FROM facts WHERE output IS NOT NULL) v ON r.function = v.function AND r.input = v.output AND r.line >= v.line",
    "d8_unambiguous": """WITH p AS (SELECT p_partkey AS node_id, list_extract(string_split(trim(p_name), '.'), -1) AS name, p_name, p_brand AS file FROM part),
g AS (SELECT p_name AS name, min(node_id) AS g FROM p GROUP BY p_name HAVING count(*) = 1), l AS (SELECT p_name AS name, file, min(node_id) AS l FROM p GROUP BY p_name, file HAVING count(*) = 1)
SELECT p.node_id AS call_id, coalesce(g.g, l.l) AS node_id FROM p LEFT JOIN g USING (name) LEFT JOIN l ON l.name = p.name AND l.file = p.file WHERE coalesce(g.g, l.l) IS NOT NULL""",
    "i1_kinds": f"WITH {FACTS} SELECT kind, count(*) AS n, count(DISTINCT function) AS functions FROM facts GROUP BY kind",
    "q1_reach": f"""WITH RECURSIVE {EDGES}, top AS (SELECT DISTINCT src AS start FROM edges),
r(start, node, distance) AS (SELECT start, dst, 1 FROM top JOIN edges ON src = start UNION SELECT r.start, e.dst, r.distance + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.distance < 3)
SELECT start, node, CAST(min(distance) AS BIGINT) AS distance FROM r WHERE node <> start GROUP BY ALL""",
    "q2_called_by": f"WITH {EDGES} SELECT DISTINCT dst AS node, src AS caller FROM edges",
    "q4_paths": """WITH RECURSIVE fd AS (SELECT DISTINCT ON (id) id, scan_id, call_chain FROM findings),
pr AS (SELECT scan_id, unnest(list_zip(call_chain[1:len(call_chain)-1], call_chain[2:len(call_chain)])) AS p FROM fd WHERE len(call_chain) > 1),
edges AS (SELECT DISTINCT scan_id, p[1] AS src, p[2] AS dst FROM pr WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL),
pairs AS (SELECT DISTINCT scan_id, call_chain[1] AS src, call_chain[-1] AS dst FROM fd WHERE len(call_chain) > 2 AND call_chain[1] IS NOT NULL AND call_chain[-1] IS NOT NULL AND scan_id IS NOT NULL),
g(scan_id, src, dst, path) AS (SELECT scan_id, src, dst, [src] FROM pairs WHERE src <> dst UNION ALL SELECT g.scan_id, g.src, g.dst, list_append(g.path, e.dst) FROM g JOIN edges e ON e.scan_id = g.scan_id AND e.src = g.path[-1] WHERE g.path[-1] <> g.dst AND NOT list_contains(g.path, e.dst) AND len(g.path) < 11)
SELECT scan_id, src, dst, array_to_string(path, '>') AS path FROM g WHERE path[-1] = dst AND len(path) > 1""",
    "q5_most_called": f"WITH {EDGES} SELECT dst AS node, CAST(sum(n) AS BIGINT) AS sites FROM edges GROUP BY dst ORDER BY sites DESC, dst LIMIT 10",
    "a11_graph_stats": f"WITH {EDGES} SELECT count(*) AS edges, CAST(sum(n) AS BIGINT) AS sites, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes FROM edges",
    "g7_edge_ids": "SELECT scan_id, id, 'e' || row_number() OVER (PARTITION BY scan_id ORDER BY file NULLS FIRST, start_line NULLS FIRST, id) AS edge_id FROM (SELECT DISTINCT ON (id) scan_id, id, file, start_line, call_chain FROM findings) WHERE len(call_chain) > 1",
    "q7_enclosing": f"""WITH {FACTS}, sp AS (SELECT function AS file, 'outer' || CAST(floor((line - 1) / 40) AS BIGINT) AS name, min(line) AS s, max(line) AS e FROM facts GROUP BY ALL UNION ALL SELECT function, 'inner' || CAST(floor((line - 1) / 10) AS BIGINT), min(line), max(line) FROM facts GROUP BY ALL),
m AS (SELECT f.id, sp.name, row_number() OVER (PARTITION BY f.id ORDER BY sp.s DESC, sp.e, sp.name) AS n FROM facts f JOIN sp ON sp.file = f.function AND sp.s <= f.line AND f.line <= sp.e WHERE f.kind = 'sink') SELECT id, name FROM m WHERE n = 1""",
}
