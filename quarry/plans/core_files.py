"""Queries over source files, text and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.extract.imports import PATTERNS, imports, lines_unified
from quarry.functions import text as T
from quarry.operators import context, findings as fops, legacy, reports, review
from quarry.plans.bridge import FACTS, facts
from quarry.plans.core_findings import NORM, norm
from quarry.sources import discovery
from quarry.tables import table

# Every query that judges files reads each delivered file once.
FILES = "fi AS (SELECT DISTINCT ON (file_id) * FROM files)"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").dropDuplicates(["file_id"])


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).withColumn("language", T.classify_language(F.col("rel_path"), F.col("content")))


def s2_skip_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.discover(files(spark, folder)).select("file_id", F.col("found_language").alias("language"), "skip_reason")


def s9_discovery_stats(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.discovery_stats(discovery.discover(files(spark, folder)), ["repo_id"])


#: An example of the patterns a repository might carry.
IGNORE = [("", 1, "*.pb.go"), ("", 2, "/lib/**/"), ("", 3, "!lib/ticket/"), ("src", 1, "[a-c]*/"), ("", 4, "# note"), ("", 5, "tools/*_window.py")]


def s3_ignored(spark: SparkSession, folder: str) -> DataFrame:
    """Files that the example's ignore patterns leave out."""
    ignored = discovery.ignore_filter(IGNORE)
    return files(spark, folder).select("file_id", "rel_path").filter(ignored("rel_path")).select("file_id")


def t1_language(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("file_id", "language")


def x5_imports(spark: SparkSession, folder: str) -> DataFrame:
    return imports(_found(spark, folder))


def g4_import_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = imports(_found(spark, folder), keys=("file_id", "rel_path"))
    return rows.select(F.concat_ws(":", F.lit("import"), "rel_path", "import_path").alias("node_id"), F.lit("Import").alias("kind"), F.col("import_path").alias("name"), "file_id")


def g6_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes keyed by path within a repository: the last delivered file wins."""
    from quarry.operators.graph import upsert

    rows = files(spark, folder).select(F.concat_ws(":", F.col("repo_id").cast("string"), "rel_path").alias("node_id"), "file_id", "language")
    return upsert(rows, "node_id", "file_id")


#: Ecosystems of the given files, in the shape of the built-in table.
OWN_ECOSYSTEMS = [("go-fmt", "fmt", ""), ("go-log", "log", ""), ("python-logging", "logging", "logging."), ("dotnet", "System", "System."), ("rust-std", "std", "std::")]


def i4_ecosystems(spark: SparkSession, folder: str) -> DataFrame:
    rows = imports(_found(spark, folder), keys=("repo_id",)).withColumn("ecosystem", T.ecosystem(F.col("import_path"), [*T.ECOSYSTEMS, *OWN_ECOSYSTEMS]))
    return rows.filter("ecosystem is not null").select("repo_id", "ecosystem").distinct()


def i6_document_ecosystems(spark: SparkSession, folder: str) -> DataFrame:
    """The ecosystems of each file, sorted; files without any give no row."""
    rows = imports(_found(spark, folder)).withColumn("ecosystem", T.ecosystem(F.col("import_path"), [*T.ECOSYSTEMS, *OWN_ECOSYSTEMS])).filter("ecosystem is not null")
    return rows.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("ecosystem")), ",").alias("ecosystems"))


def e3_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories in which a rule is active that needs logging and formatting together."""
    rows = imports(_found(spark, folder), keys=("repo_id",)).filter(F.col("import_path").isin("fmt", "log"))
    return rows.groupBy("repo_id").agg(F.count_distinct("import_path").alias("n")).filter("n = 2").select("repo_id")


def r18_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a presentation folder that import a data layer; the first keyword of each side counts."""
    rows = imports(_found(spark, folder), keys=("file_id", "rel_path"))
    rows = rows.withColumn("source_keyword", T.first_keyword(F.concat(F.lit("/"), F.col("rel_path")), T.UPPER_LAYER)).withColumn("import_keyword", T.first_keyword(F.concat(F.lit("/"), F.replace("import_path", F.lit("."), F.lit("/"))), T.DATA_LAYER))
    return rows.filter("source_keyword is not null and import_keyword is not null").select("file_id", "import_path", "source_keyword", "import_keyword")


def t2_fact_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).select("id", F.explode("steps").alias("s"))
    key = F.concat_ws("\0", *[F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("")) for c in ("kind", "expression", "file", "line", "column")])
    return rows.select("id", F.substring(F.sha2(key, 256), 1, 24).alias("fact_id")).distinct()


def t3_selectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).select("id", F.posexplode("steps").alias("n", "s"))
    e = F.col("s.expression")
    return rows.select("id", F.col("n").cast("bigint").alias("n"), T.last_selector(F.regexp_replace(e, r"\(.*$", "")).alias("selector"), T.parameterized(e).alias("parameterized"))


def t8_modes(spark: SparkSession, folder: str) -> DataFrame:
    lit = F.concat(F.lit("0"), F.conv((F.col("p_partkey") % 512).cast("string"), 10, 8))
    return table(spark, folder, "part").select("p_partkey", lit.alias("literal"), T.mode_bits(lit).alias("bits"), T.other_writable(lit).alias("other_writable"))


def t9_limit_lines(spark: SparkSession, folder: str) -> DataFrame:
    return norm(spark, folder).select("id", T.limit_lines(F.col("code_snippet"), 3).alias("snippet"))


def t10_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select("file_id", T.excerpt(F.col("content"), F.lit(3), F.lit(9), 5).alias("excerpt"))


def t12_tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", T.tokens_flat(t).alias("flat"), T.tokens_by_class(t).alias("by_class"))


def t14_redact(spark: SparkSession, folder: str) -> DataFrame:
    rows = norm(spark, folder).select("id", T.redact(F.col("code_snippet")).alias("snippet"))
    return rows.filter(F.col("snippet").contains("<REDACTED_SECRET>"))


def t16_levels(spark: SparkSession, folder: str) -> DataFrame:
    return norm(spark, folder).groupBy(T.report_level(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def k2_report_rules(spark: SparkSession, folder: str) -> DataFrame:
    return reports.report_rules(norm(spark, folder), ["scan_id"])


def k2_results(spark: SparkSession, folder: str) -> DataFrame:
    return reports.report_results(norm(spark, folder), ["scan_id"]).select("scan_id", "id", F.col("place").cast("bigint").alias("place"), F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


def v2_review_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of a scan with its batch or why it is skipped; one without a file lacks context."""
    rows = norm(spark, folder).withColumn("rule_id", F.coalesce("rule_id", F.lit("")))
    rows = rows.withColumn("contextual", F.col("review_policy") == "CONTEXT_REQUIRED").withColumn("eligible", F.coalesce(fops.eligible("smart"), F.lit(False)))
    order = fops.diverse_order(rows, ["scan_id"])
    w = Window.partitionBy("scan_id").orderBy(F.desc("eligible"), "round", "turn", "id")
    sized = order.select("scan_id", "id", "rule_id", F.row_number().over(w).alias("place"), T.tokens_flat(F.coalesce("code_snippet", F.lit(""))).cast("int").alias("tokens"), F.col("file").isNotNull().alias("enough"), "contextual", "eligible")
    return review.plan(sized, "scan_id")


def v10_cited(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose listed evidence is checked against the items they were offered."""
    items = table(spark, folder, "evidence_items").dropDuplicates(["item_id"])
    offered = items.groupBy(F.col("finding_id").alias("id")).agg(F.collect_set("id").alias("offered"))
    answers = norm(spark, folder).filter(F.col("review_policy") == "CONTEXT_REQUIRED").select("id", (F.col("severity") == "High").alias("decisive"), F.array(F.lit("primary.1"), F.lit("comment.2")).alias("cited")).filter("decisive is not null")
    out = review.cited_evidence(answers, offered)
    return out.select("id", F.array_join(F.sort_array("valid_ids"), ",").alias("valid_ids"), "accepted")


def c7_evidence_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by the kind of evidence they are shown as."""
    rows = facts(spark, folder).select("kind", context.evidence_kind(F.col("kind")).alias("evidence"))
    return rows.groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("facts"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    f = _found(spark, folder).filter("language = 'Go'")
    return f.select("file_id", F.posexplode(F.split(lines_unified(F.col("content")), "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("bigint"))


def l3_function_length(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of Go files and their length in lines, from one `func` to the next or the end; above 12 lines."""
    rows = _lines(spark, folder)
    starts = rows.filter(F.col("line").rlike(r"^func ")).select("file_id", "n", F.regexp_extract("line", r"^func (?:\([^)]*\) )?(\w+)", 1).alias("name"))
    ends = rows.groupBy("file_id").agg(F.max("n").alias("last"))
    nxt = F.lead("n").over(Window.partitionBy("file_id").orderBy("n"))
    return starts.withColumn("next", nxt).join(ends, "file_id").select("file_id", "name", "n", (F.coalesce(F.col("next"), F.col("last") + 1) - F.col("n")).alias("length")).filter("length > 12")


def l4_token_complexity(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_extract_all("line", F.lit(r"(\bif\b|\bfor\b|\bcase\b|&&|\|\|)"), F.lit(1))
    return _lines(spark, folder).groupBy("file_id").agg((F.sum(F.size(words)) + 1).alias("complexity")).filter("complexity > 10")


def l5_loop_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a Go file's loops that call a logger: the brace depth of loops, summed over the lines before, is positive."""
    rows = legacy.in_loops(_lines(spark, folder))
    return rows.filter(F.col("inside") & F.col("plain").rlike(r"\blog\.\w+\(")).select("file_id", "n", F.col("depth").cast("bigint").alias("depth"))


def l6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return legacy.leaks(_lines(spark, folder))


def l1_ignored_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).filter(legacy.ignored_error(F.col("line"))).select("file_id", "n")


def l2_nil_dereference(spark: SparkSession, folder: str) -> DataFrame:
    return legacy.nil_dereference(_lines(spark, folder))


def l7_sql_text(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).filter(legacy.sql_by_concatenation(F.col("line"))).select("file_id", "n")


_EXT = "CASE WHEN lower(regexp_extract(rel_path, '[^/]*$')) LIKE '%.%' THEN lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) ELSE '' END"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(s) for s in ss)}) THEN '{lang}'" for lang, ss in T.LANGUAGES.items()) + " ELSE '' END"
_TEXT = "replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FL = f"{FILES}, fl AS (SELECT * EXCLUDE (language), {_LANG} AS language FROM fi)"
_IMP = (
    f"{_FL}, im AS (SELECT DISTINCT file_id, repo_id, rel_path, trim(p) AS import_path FROM (SELECT file_id, repo_id, rel_path, unnest(CASE language "
    + " ".join(f"WHEN '{lang}' THEN regexp_extract_all({_TEXT}, '{p.replace(chr(39), chr(39) * 2)}', 1)" for lang, p in PATTERNS.items())
    + " ELSE [] END) AS p FROM fl) WHERE trim(p) <> '')"
)
_SKIP = f"""sk AS (SELECT file_id, repo_id, language, CASE WHEN len(list_intersect(string_split(rel_path, '/')[1:len(string_split(rel_path, '/')) - 1], [{', '.join(repr(d) for d in discovery.SKIP_DIRS)}])) > 0 THEN 'pruned'
 WHEN regexp_extract(rel_path, '[^/]*$') = '.gitignore' THEN 'ignore_file' WHEN rel_path LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' WHEN coalesce(size, 0) > 512000 THEN 'size' WHEN language = '' THEN 'unclassified' END AS skip_reason FROM fl)"""
_LN = f"""{_FL}, ln AS (SELECT file_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS n, unnest(ls) AS line FROM (SELECT file_id, string_split({_TEXT}, chr(10)) AS ls FROM fl WHERE language = 'Go' AND content IS NOT NULL))"""
_KW = lambda col, ks: "CASE " + " ".join(f"WHEN contains({col}, '{k}') THEN '{k}'" for k in ks) + " END"
_LEVEL = "CASE WHEN lower(trim({0})) IN ('critical', 'high') THEN 'error' WHEN lower(trim({0})) = 'medium' THEN 'warning' ELSE 'note' END"
_ECO = "CASE " + " ".join("WHEN " + " OR ".join([f"import_path = '{e}'"] * bool(e) + [f"starts_with(import_path, '{p}')"] * bool(p)) + f" THEN '{n}'" for n, e, p in [*T.ECOSYSTEMS, *OWN_ECOSYSTEMS]) + " END"

QUERIES = {f.__name__: f for f in (
    s2_skip_reasons, s9_discovery_stats, s3_ignored, t1_language, x5_imports, g4_import_nodes, g6_upsert, i4_ecosystems, i6_document_ecosystems, e3_gate, r18_layers,
    t2_fact_ids, t3_selectors, t8_modes, t9_limit_lines, t10_excerpt, t12_tokens, t14_redact, t16_levels, k2_report_rules, k2_results, v2_review_plan, v10_cited, c7_evidence_kinds,
    l1_ignored_errors, l2_nil_dereference, l3_function_length, l4_token_complexity, l5_loop_calls, l6_leaks, l7_sql_text,
)}

ORACLE = {
    "s2_skip_reasons": f"WITH {_FL}, {_SKIP} SELECT file_id, language, skip_reason FROM sk",
    "s9_discovery_stats": f"WITH {_FL}, {_SKIP} SELECT repo_id, count(*) FILTER (WHERE skip_reason IS NULL) AS total, count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped, count(*) FILTER (WHERE skip_reason = 'size') AS by_size, count(*) FILTER (WHERE skip_reason = 'ignored') AS by_ignore, count(*) FILTER (WHERE skip_reason = 'test') AS by_test FROM sk WHERE coalesce(skip_reason, '') <> 'pruned' GROUP BY repo_id",
    "t1_language": f"WITH {_FL} SELECT file_id, language FROM fl",
    "x5_imports": f"WITH {_IMP} SELECT file_id, import_path FROM im",
    "g4_import_nodes": f"WITH {_IMP} SELECT 'import:' || rel_path || ':' || import_path AS node_id, 'Import' AS kind, import_path AS name, file_id FROM im",
    "g6_upsert": f"WITH {FILES} SELECT node_id, file_id, language FROM (SELECT repo_id || ':' || rel_path AS node_id, file_id, language, row_number() OVER (PARTITION BY repo_id || ':' || rel_path ORDER BY file_id DESC) AS n FROM fi) WHERE n = 1",
    "i4_ecosystems": f"WITH {_IMP} SELECT DISTINCT repo_id, {_ECO} AS ecosystem FROM im WHERE {_ECO} IS NOT NULL",
    "i6_document_ecosystems": f"WITH {_IMP} SELECT file_id, array_to_string(list_sort(list(DISTINCT {_ECO})), ',') AS ecosystems FROM im WHERE {_ECO} IS NOT NULL GROUP BY file_id",
    "e3_gate": f"WITH {_IMP} SELECT repo_id FROM im WHERE import_path IN ('fmt', 'log') GROUP BY repo_id HAVING count(DISTINCT import_path) = 2",
    "r18_layers": f"""WITH {_IMP}, k AS (SELECT file_id, import_path, {_KW("'/' || rel_path", T.UPPER_LAYER)} AS source_keyword, {_KW("'/' || replace(import_path, '.', '/')", T.DATA_LAYER)} AS import_keyword FROM im)
SELECT * FROM k WHERE source_keyword IS NOT NULL AND import_keyword IS NOT NULL""",
    "t2_fact_ids": f"""WITH {NORM}, s AS (SELECT id, unnest(steps) AS s FROM norm) SELECT DISTINCT id, substr(sha256(concat_ws(chr(0), coalesce(s.kind, ''), coalesce(s.expression, ''), coalesce(s.file, ''), coalesce(CAST(s.line AS VARCHAR), ''), coalesce(CAST(s."column" AS VARCHAR), ''))), 1, 24) AS fact_id FROM s""",
    "t3_selectors": f"""WITH {NORM}, s AS (SELECT id, CAST(unnest(range(0, len(steps))) AS BIGINT) AS n, unnest(steps) AS s FROM norm WHERE len(steps) > 0) SELECT id, n, list_extract(string_split(trim(regexp_replace(s.expression, '\\(.*$', '')), '.'), -1) AS selector, contains(s.expression, '?') OR regexp_matches(s.expression, '\\$[1-9]') AS parameterized FROM s""",
    "t8_modes": "WITH d AS (SELECT p_partkey, p_partkey % 512 AS m FROM part) SELECT p_partkey, '0' || CASE WHEN m >= 64 THEN (m // 64)::VARCHAR || ((m // 8) % 8)::VARCHAR || (m % 8)::VARCHAR WHEN m >= 8 THEN (m // 8)::VARCHAR || (m % 8)::VARCHAR ELSE m::VARCHAR END AS literal, m AS bits, (m & 2) <> 0 AS other_writable FROM d",
    "t9_limit_lines": f"WITH {NORM}, l AS (SELECT id, string_split(array_to_string(string_split(code_snippet, chr(10))[1:20], chr(10)), chr(10)) AS ls, array_to_string(string_split(code_snippet, chr(10))[1:20], chr(10)) AS s FROM norm) SELECT id, CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:3], chr(10)) || chr(10) || '…<TRUNCATED>' ELSE s END AS snippet FROM l",
    "t10_excerpt": f"WITH {FILES} SELECT file_id, array_to_string(string_split(content, chr(10))[3:7], chr(10)) AS excerpt FROM fi",
    "t12_tokens": """SELECT doc_id, CAST(floor((strlen(text) + 3) / 4) + 64 AS BIGINT) AS flat, CAST(least(strlen(text), greatest(CAST(ceil(strlen(text) / 2.0) AS BIGINT), 2 * length(regexp_replace(text, '[A-Za-z0-9]|[^\\x00-\\x7F]', '', 'g')) + (strlen(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))))) AS BIGINT) AS by_class FROM documents""",
    "t16_levels": f"WITH {NORM} SELECT {_LEVEL.format('severity')} AS level, count(*) AS n FROM norm GROUP BY 1",
    "k2_report_rules": f"WITH {NORM} SELECT scan_id, rule_id, arg_min(struct_pack(t := title), id).t AS title, {_LEVEL.format('arg_min(struct_pack(s := severity), id).s')} AS level FROM norm WHERE rule_id IS NOT NULL GROUP BY scan_id, rule_id",
    "k2_results": f"WITH {NORM} SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY rule_id NULLS FIRST, file NULLS FIRST, id) AS place, {_LEVEL.format('severity')} AS level, file AS uri FROM norm",
    "v10_cited": f"""WITH {NORM}, o AS (SELECT finding_id AS id, list(DISTINCT id) AS offered FROM (SELECT DISTINCT ON (item_id) * FROM evidence_items) GROUP BY finding_id),
a AS (SELECT n.id, severity = 'High' AS decisive, list_filter(['comment.2', 'primary.1'], lambda c: list_contains(coalesce(o.offered, []), c)) AS v FROM norm n LEFT JOIN o ON n.id = o.id WHERE review_policy = 'CONTEXT_REQUIRED' AND severity IS NOT NULL)
SELECT id, array_to_string(v, ',') AS valid_ids, NOT decisive OR len(v) = 2 AS accepted FROM a""",
    "c7_evidence_kinds": f"WITH {FACTS} SELECT kind, CASE WHEN kind IN ('propagation', 'source', 'sink') THEN 'provenance' WHEN kind IN ('resource_acquire', 'resource_release') THEN 'lifecycle' ELSE 'symbol' END AS evidence, count(*) AS facts FROM facts GROUP BY ALL",
    "l1_ignored_errors": f"WITH {_LN} SELECT file_id, n FROM ln WHERE regexp_matches(line, '(^|[,\\s])_\\s*:?=\\s*([\\w.]+)\\(') AND NOT regexp_matches(line, '{legacy.SAFE}')",
    "l2_nil_dereference": f"""WITH {_LN}, v AS (SELECT *, nullif(regexp_extract(line, '^\\s*(\\w+),\\s*err\\s*:?=', 1), '') AS v FROM ln),
u AS (SELECT a.file_id, a.n, a.v, min(b.n) FILTER (WHERE regexp_matches(b.line, '\\b' || a.v || '\\.')) AS used, min(b.n) FILTER (WHERE contains(b.line, 'err != nil') OR contains(b.line, 'err == nil')) AS checked FROM v a JOIN ln b ON b.file_id = a.file_id AND b.n > a.n AND b.n <= a.n + 4 WHERE a.v IS NOT NULL GROUP BY ALL)
SELECT file_id, n, v AS symbol FROM u WHERE used IS NOT NULL AND (checked IS NULL OR used < checked)""",
    "l3_function_length": f"""WITH {_LN}, s AS (SELECT file_id, n, regexp_extract(line, '^func (?:\\([^)]*\\) )?(\\w+)', 1) AS name, lead(n) OVER (PARTITION BY file_id ORDER BY n) AS nx FROM ln WHERE regexp_matches(line, '^func ')), e AS (SELECT file_id, max(n) AS last FROM ln GROUP BY file_id)
SELECT s.file_id, name, n, coalesce(nx, last + 1) - n AS length FROM s JOIN e USING (file_id) WHERE coalesce(nx, last + 1) - n > 12""",
    "l4_token_complexity": f"WITH {_LN} SELECT file_id, CAST(sum(len(regexp_extract_all(line, '(\\bif\\b|\\bfor\\b|\\bcase\\b|&&|\\|\\|)', 1))) + 1 AS BIGINT) AS complexity FROM ln GROUP BY file_id HAVING sum(len(regexp_extract_all(line, '(\\bif\\b|\\bfor\\b|\\bcase\\b|&&|\\|\\|)', 1))) + 1 > 10",
    "l5_loop_calls": f"""WITH {_LN}, p AS (SELECT file_id, n, regexp_replace(line, '"[^"]*"|''[^'']*''|`[^`]*`|//.*$', '', 'g') AS plain FROM ln),
d AS (SELECT *, coalesce(CAST(sum(length(regexp_replace(plain, '[^{{]', '', 'g')) - length(regexp_replace(plain, '[^}}]', '', 'g'))) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS depth FROM p),
l AS (SELECT *, last_value(CASE WHEN regexp_matches(plain, '^\\s*for\\b.*\\{{\\s*$') THEN depth END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM d)
SELECT file_id, n, depth FROM l WHERE lp IS NOT NULL AND depth > lp AND regexp_matches(plain, '\\blog\\.\\w+\\(')""",
    "l6_leaks": f"""WITH {_LN}, p AS (SELECT file_id, n, regexp_replace(line, '"[^"]*"|''[^'']*''|`[^`]*`|//.*$', '', 'g') AS plain FROM ln),
d AS (SELECT *, coalesce(CAST(sum(length(regexp_replace(plain, '[^{{]', '', 'g')) - length(regexp_replace(plain, '[^}}]', '', 'g'))) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS depth FROM p),
l AS (SELECT *, last_value(CASE WHEN regexp_matches(plain, '^\\s*for\\b.*\\{{\\s*$') THEN depth END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM d),
m AS (SELECT file_id, n, plain, regexp_extract(plain, '(\\w+)\\s*:?=\\s*context\\.With(Cancel|Timeout|Deadline)\\w*\\(', 1) AS name FROM p)
SELECT file_id, n, 'timer' AS leak FROM l WHERE coalesce(depth > lp, false) AND regexp_matches(plain, '\\btime\\.After\\(')
UNION ALL SELECT file_id, n, 'goroutine' FROM l WHERE coalesce(depth > lp, false) AND regexp_matches(plain, '\\bgo\\s+(func|[\\w.]+\\s*\\()')
UNION ALL SELECT file_id, n, 'context' FROM m WHERE name NOT IN ('', '_') AND NOT EXISTS (SELECT 1 FROM p WHERE p.file_id = m.file_id AND list_contains(regexp_extract_all(p.plain, '(\\w+)\\(\\)', 1), m.name))""",
    "l7_sql_text": f"WITH {_LN} SELECT file_id, n FROM ln WHERE regexp_matches(line, '{legacy.FORMATTED}') OR regexp_matches(line, '{legacy.JOINED}') AND NOT regexp_matches(line, '{legacy.PLACEHOLDER}')",
}
