"""The rule engine: a catalogue of rules over facts and traces, run as one plan.

Rules of one pattern are rows of a small table that the facts or traces are
joined with, so a pattern costs one pass however many rules it has. "Later in
the same function" never pairs facts: the last matching fact of each place and
symbol decides, found by an aggregate and joined by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import DATA_LAYER, UPPER_LAYER, ecosystem, first_keyword, other_writable
from quarry.operators import taint
from quarry.session import materialize

PLACE = ["file", "function"]
STEP = "struct<kind:string,file:string,line:int,column:int,expression:string,message:string,related_symbol:string>"
COLUMNS = ["repo", "rule_id", "category", "severity", "title", "file", "start_line", "end_line", "snippet", "symbols", "call_chain", "confidence", "strength", "steps", "observation", "hypothesis", "review_policy"]


@dataclass(frozen=True)
class Rule:
    """A rule: what it is called and weighs, which pattern it follows and with what, and what must be in the repository."""

    id: str
    category: str
    severity: str
    pattern: str
    title: str
    args: tuple = ()
    requires: tuple[str, ...] = ()
    confidence: float = 0.85
    strength: str = "strong"
    policy: str = "CONTEXT_REQUIRED"


SQL = ("sql.raw", "sql.exec", "gorm.where.dynamic", "database/sql.*")
COMMAND, REDIRECT, FILE = ("command.exec",), ("http.redirect",), ("file.open", "file.read", "file.write")
_SEC, _COR = "Security", "Correctness"

# The catalogue. Pattern arguments: fact (kind, operation); flow (frameworks, sinks); origin (source operation, sinks);
# sink (operation); lifecycle (acquired, releases); iteration (acquired, step, error); hash (operation).
RULES: tuple[Rule, ...] = (
    Rule("ARC-001", "Architecture", "Medium", "layer", "Presentation code uses the data layer directly", confidence=0.70, strength="moderate"),
    Rule("GO-COR-001", _COR, "Medium", "fact", "An error result is ignored", ("guard", "error.ignored")),
    Rule("GO-COR-002", _COR, "High", "fact", "A type assertion is not checked", ("guard", "type_assertion.unchecked")),
    Rule("GO-COR-003", _COR, "Medium", "iteration", "Rows are read without a look at their error", ("database.rows", "Next", "Err"), ("database/sql",), 0.80, "moderate"),
    Rule("GO-COR-004", _COR, "Medium", "iteration", "A scanner is read without a look at its error", ("scanner", "Scan", "Err"), (), 0.80, "moderate"),
    Rule("GO-COR-005", _COR, "High", "lifecycle", "A transaction is neither committed nor rolled back", ("database.transaction", "commit", "rollback"), ("database/sql",), 0.70, "moderate"),
    Rule("GO-RES-001", _COR, "Medium", "lifecycle", "A response body is not closed", ("http.response.body", "close"), ("net/http",), 0.70, "moderate"),
    Rule("GO-RES-002", _COR, "Medium", "lifecycle", "Rows are not closed", ("database.rows", "close"), ("database/sql",), 0.70, "moderate"),
    Rule("GO-RES-003", _COR, "Medium", "lifecycle", "A file is not closed", ("file", "close"), ("filesystem",), 0.70, "moderate"),
    Rule("GO-RES-004", _COR, "Medium", "lifecycle", "A ticker is not stopped", ("ticker", "stop"), (), 0.70, "moderate"),
    Rule("GO-RES-005", _COR, "Medium", "lifecycle", "A context's cancel function is not called", ("context.cancel", "context.cancel"), (), 0.70, "moderate"),
    Rule("GO-CON-001", "Performance", "Medium", "goroutine", "Goroutines are started in a loop"),
    Rule("GO-CON-002", "Performance", "Low", "fact", "A deferred call stands in a loop", ("concurrency_operation", "defer.in_loop")),
    Rule("GO-CON-003", _COR, "High", "fact", "A wait group grows inside the goroutine it waits for", ("concurrency_operation", "waitgroup.add_in_goroutine")),
    Rule("GO-CON-004", _COR, "Medium", "lifecycle", "A mutex is not unlocked", ("mutex", "unlock"), (), 0.70, "moderate"),
    Rule("GO-SEC-002", _SEC, "Medium", "hash", "MD5 protects something secret", ("crypto.weak.md5",), (), 0.80, "moderate"),
    Rule("GO-SEC-003", _SEC, "Medium", "hash", "SHA-1 protects something secret", ("crypto.weak.sha1",), (), 0.80, "moderate"),
    Rule("GO-SEC-004", _SEC, "High", "fact", "Certificates are not verified", ("crypto_operation", "tls.insecure_skip_verify")),
    Rule("GO-SEC-005", _SEC, "Medium", "mode", "A file may be written by everyone", (), ("filesystem",), 0.95),
    Rule("GO-MNT-001", "Maintainability", "Medium", "length", "A function is long", (), (), 1.0, "strong", "STATIC_AUTHORITATIVE"),
    Rule("GO-MNT-002", "Maintainability", "Medium", "complexity", "A function takes many decisions", (), (), 1.0, "strong", "STATIC_AUTHORITATIVE"),
    Rule("GO-PER-001", "Performance", "Low", "costly", "A costly call stands in a loop"),
    Rule("GO-SQL-SEC-001", _SEC, "High", "flow", "A request reaches SQL", (("net/http",), SQL), ("database/sql",)),
    Rule("GO-CMD-SEC-001", _SEC, "High", "flow", "A request reaches a command", (("net/http",), COMMAND), ("os/exec",)),
    Rule("GO-CMD-SEC-002", _SEC, "Medium", "origin", "An environment variable reaches a command", ("environment", COMMAND), ("os/exec", "filesystem")),
    Rule("GO-HTTP-SEC-001", _SEC, "Medium", "flow", "A request reaches a redirect", (("net/http",), REDIRECT), ("net/http",)),
    Rule("GO-FS-SEC-001", _SEC, "High", "flow", "A request reaches a path", (("net/http", "gin", "fiber"), FILE), ("filesystem",)),
    Rule("GIN-SEC-001", _SEC, "High", "flow", "A request reaches SQL", (("gin",), SQL), ("gin",)),
    Rule("GIN-SEC-002", _SEC, "High", "flow", "A request reaches a command", (("gin",), COMMAND), ("gin", "os/exec")),
    Rule("GIN-SEC-003", _SEC, "Medium", "flow", "A request reaches a redirect", (("gin",), REDIRECT), ("gin",)),
    Rule("FIBER-SEC-001", _SEC, "High", "flow", "A request reaches SQL", (("fiber",), SQL), ("fiber",)),
    Rule("FIBER-SEC-002", _SEC, "High", "flow", "A request reaches a command", (("fiber",), COMMAND), ("fiber", "os/exec")),
    Rule("FIBER-SEC-003", _SEC, "Medium", "flow", "A request reaches a redirect", (("fiber",), REDIRECT), ("fiber",)),
    Rule("GORM-SEC-001", _SEC, "High", "gorm_sql", "GORM receives SQL that is built", (), ("gorm",)),
    Rule("GORM-SEC-002", _SEC, "High", "fact", "GORM may change whole tables", ("database_operation", "gorm.allow_global_update"), ("gorm",)),
    Rule("GORM-SEC-003", _SEC, "High", "fact", "GORM deletes for good", ("database_operation", "gorm.unscoped.delete"), ("gorm",)),
    Rule("GORM-COR-001", _COR, "Medium", "gorm_error", "A GORM result's error is not looked at", (), ("gorm",), 0.80, "moderate"),
    Rule("GORM-COR-002", _COR, "High", "lifecycle", "A GORM transaction is neither committed nor rolled back", ("gorm.transaction", "commit", "rollback"), ("gorm",), 0.70, "moderate"),
    Rule("PY-SEC-001", _SEC, "High", "fact", "eval of what is no literal", ("sink", "python.builtin.eval"), (), 0.95),
    Rule("PY-SEC-002", _SEC, "High", "fact", "exec of what is no literal", ("sink", "python.builtin.exec"), (), 0.95),
    Rule("PY-COR-001", _COR, "Medium", "fact", "A default argument can change", ("guard", "python.mutable_default"), (), 0.95),
    Rule("PY-CMD-SEC-001", _SEC, "High", "sink", "A request reaches a shell", ("python.shell.command",)),
    Rule("PY-SQL-SEC-001", _SEC, "High", "sink", "A request reaches SQL", ("python.sql.dynamic",)),
    Rule("PY-FS-SEC-001", _SEC, "High", "sink", "A request reaches a path", ("python.filesystem.path",)),
    Rule("PY-DESER-SEC-001", _SEC, "High", "sink", "A request is unpickled", ("python.deserialize.unsafe",)),
    Rule("PY-ML-SEC-001", _SEC, "High", "sink", "A request names a model that is unpickled", ("python.torch.load.unsafe",)),
    Rule("PY-TLS-SEC-001", _SEC, "Medium", "fact", "Certificates are not verified", ("guard", "python.tls.verify_disabled"), (), 0.95),
    Rule("PY-CV-COR-001", _COR, "Medium", "image", "An image is used that may not have been read", (), (), 0.90),
    Rule("PY-CV-RES-001", _COR, "Medium", "capture", "A capture is not released", (), (), 0.80, "moderate"),
    Rule("CSHARP-COR-001", _COR, "Medium", "fact", "An async method gives nothing to wait for", ("guard", "csharp.async_void"), (), 0.90),
    Rule("CSHARP-SEC-001", _SEC, "High", "fact", "Raw SQL is built", ("sink", "csharp.ef.raw_sql.dynamic"), (), 0.90),
    Rule("CSHARP-ASYNC-001", _COR, "Medium", "fact", "An async method blocks on a task", ("guard", "csharp.task.blocking"), (), 0.90),
    Rule("CSHARP-CMD-SEC-001", _SEC, "High", "sink", "A request reaches a shell", ("csharp.shell.command",)),
    Rule("CSHARP-FS-SEC-001", _SEC, "High", "sink", "A request reaches a path", ("csharp.filesystem.path",)),
    Rule("CSHARP-SSRF-SEC-001", _SEC, "High", "sink", "A request chooses an outbound address", ("csharp.http.outbound_url",)),
    Rule("CSHARP-TLS-SEC-001", _SEC, "High", "fact", "Certificates are not verified", ("guard", "csharp.tls.validation_bypass"), (), 0.90),
    Rule("RUST-COR-001", _COR, "Low", "fact", "An unsafe block", ("control", "rust.unsafe_block"), (), 0.75, "moderate"),
    Rule("RUST-ASYNC-001", _COR, "Medium", "fact", "An async function sleeps its thread", ("guard", "rust.async.blocking_sleep"), (), 0.90),
    Rule("RUST-SQL-SEC-001", _SEC, "High", "sink", "A request reaches SQL", ("rust.sql.dynamic",)),
    Rule("RUST-CMD-SEC-001", _SEC, "High", "sink", "A request reaches a shell", ("rust.shell.command",)),
    Rule("RUST-FS-SEC-001", _SEC, "High", "sink", "A request reaches a path", ("rust.filesystem.path",)),
    Rule("RUST-SSRF-SEC-001", _SEC, "High", "sink", "A request chooses an outbound address", ("rust.http.outbound_url",)),
    Rule("RUST-TLS-SEC-001", _SEC, "High", "fact", "Certificates are not verified", ("guard", "rust.tls.invalid_certs"), (), 0.90),
)
# Limits of length and decisions, costly calls, what makes a hash's context sensitive, GORM's terminal methods.
LONG, COMPLEX = (100, 200), (10, 20)
COSTLY = ("regexp.Compile", "regexp.MustCompile", "json.Marshal", "json.Unmarshal", "time.After", "make")
SENSITIVE = "password|passwd|credential|secret|signature|authenticate|authentication"
TERMINAL = ("exec", "first", "find", "take", "last", "scan", "create", "save", "delete", "updates")


def register(rules: Sequence[Rule]) -> dict[str, Rule]:
    """Rules by id; an empty or repeated id and an unknown pattern are errors."""
    out: dict[str, Rule] = {}
    for r in rules:
        if r is None or not r.id or r.id in out or r.pattern not in PATTERNS:
            raise ValueError(f"rule {getattr(r, 'id', r)!r} is empty, repeated or of no known pattern")
        out[r.id] = r
    return out


class Context:
    """What rules look at: facts with their repository, traces with their facts, ecosystems."""

    def __init__(self, facts: DataFrame) -> None:
        self.spark: SparkSession = facts.sparkSession
        facts = facts if "repo" in facts.columns else facts.withColumn("repo", F.lit(""))
        self.all = materialize(facts.withColumn("at", F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column"))), "facts")
        self.facts = self.all.filter("kind not in ('function', 'import', 'symbol')")
        self.functions = self.all.filter("kind = 'function'").select("repo", "file", F.col("operation").alias("name"), F.col("arguments").alias("parameters"), "start_line", "end_line", F.col("expression").alias("head"), "receiver")
        self.imports = self.all.filter("kind = 'import'").select("repo", "file", F.col("operation").alias("path"))
        self._traces: DataFrame | None = None

    def kind(self, *kinds: str) -> DataFrame:
        return self.facts.filter(F.col("kind").isin(*kinds))

    def table(self, rules: Sequence[Rule], names: str, rows: Sequence[tuple]) -> DataFrame:
        """Rules' own columns with their arguments, one row each; a table of the catalogue's size."""
        own = [(r.id, r.category, r.severity, r.title, r.confidence, r.strength, r.policy, *a) for r, *a in rows]
        return F.broadcast(self.spark.createDataFrame(own, f"rule_id string, category string, severity string, title string, confidence double, strength string, review_policy string, {names}"))

    def traces(self) -> DataFrame:
        """repo, source, sink (structs of facts), steps between them, confidence, strength."""
        if self._traces is None:
            found = taint.graded(taint.traces(self.facts, self.functions))
            known = self.facts.select("id", F.struct("id", "operation", *PLACE, "expression", "start_line", "start_column", "end_line", "inputs", "outputs", "metadata").alias("f"))
            between = found.select("source_id", "sink_id", F.posexplode("path").alias("n", "id")).join(known, "id").groupBy("source_id", "sink_id").agg(F.array_sort(F.collect_list(F.struct("n", "f.file", "f.start_line", "f.start_column", "f.expression", "f.function"))).alias("between"))
            src, snk = known.select(F.col("id").alias("source_id"), F.col("f").alias("source")), self.facts.select("repo", F.col("id").alias("sink_id")).join(known.select(F.col("id").alias("sink_id"), F.col("f").alias("sink")), "sink_id")
            self._traces = materialize(found.join(src, "source_id").join(snk, "sink_id").join(between, ["source_id", "sink_id"], "left"), "traces")
        return self._traces


def _step(kind: Column, f: Callable[[str], Column], message: Column) -> Column:
    return F.struct(kind.alias("kind"), f("file").alias("file"), f("start_line").alias("line"), f("start_column").alias("column"), f("expression").alias("expression"), message.alias("message"), f("function").alias("related_symbol"))


def _fact_findings(rows: DataFrame, observation: Column | None = None, hypothesis: Column | None = None, more: Column | None = None) -> DataFrame:
    """Findings at facts joined with their rule."""
    seen = observation if observation is not None else F.concat(F.lit("The source holds the operation "), F.col("operation"), F.lit(" here."))
    may = hypothesis if hypothesis is not None else F.col("title")
    steps = F.array(_step(F.lit("evidence"), F.col, F.col("title")))
    if more is not None:
        steps = F.concat(steps, more)
    return rows.select(
        "repo", "rule_id", "category", "severity", "title", "file", "start_line", "end_line", F.col("expression").alias("snippet"), F.array_distinct(F.concat("outputs", "inputs")).alias("symbols"), F.array().cast("array<string>").alias("call_chain"), "confidence", "strength", steps.cast(f"array<{STEP}>").alias("steps"), seen.alias("observation"), may.alias("hypothesis"), "review_policy"
    )


def _trace_findings(rows: DataFrame) -> DataFrame:
    part = lambda side: lambda c: F.col(f"{side}.{c}")
    none = F.array().cast(f"array<{STEP}>")
    between = F.coalesce(F.transform("between", lambda x: F.struct(F.lit("propagation").alias("kind"), x["file"].alias("file"), x["start_line"].alias("line"), x["start_column"].alias("column"), x["expression"].alias("expression"), F.lit("The value goes on through this expression.").alias("message"), x["function"].alias("related_symbol"))), none)
    steps = F.concat(F.array(_step(F.lit("source"), part("source"), F.lit("Outside input comes in here."))).cast(f"array<{STEP}>"), between.cast(f"array<{STEP}>"), F.array(_step(F.lit("sink"), part("sink"), F.lit("It reaches this operation."))).cast(f"array<{STEP}>"))
    chain = F.concat(F.array(F.col("source.expression")), F.coalesce(F.transform("between", lambda x: x["expression"]), F.array().cast("array<string>")), F.array(F.col("sink.expression")))
    return rows.select(
        "repo", "rule_id", "category", "severity", "title", F.col("sink.file").alias("file"), F.col("sink.start_line").alias("start_line"), F.col("sink.end_line").alias("end_line"), F.col("sink.expression").alias("snippet"), F.array_distinct(F.concat("source.outputs", "sink.inputs")).alias("symbols"), chain.alias("call_chain"), F.col("trace_confidence").alias("confidence"), F.col("trace_strength").alias("strength"), steps.alias("steps"),
        F.lit("A bounded trace connects the source with the sink.").alias("observation"), F.lit("The outside input may steer the operation without a sufficient control between.").alias("hypothesis"), "review_policy",
    )


def _traced(c: Context) -> DataFrame:
    return c.traces().withColumnsRenamed({"confidence": "trace_confidence", "strength": "trace_strength"})


def _is_sink(op: Column, wanted: Column) -> Column:
    return F.array_contains(wanted, op) | (F.array_contains(wanted, "database/sql.*") & op.startswith("database/sql."))


def _last(rows: DataFrame, symbol: Column, *keys: str) -> DataFrame:
    """The place of the last of the rows for each function, symbol and key."""
    return rows.withColumn("symbol", symbol).filter("symbol is not null").groupBy(*PLACE, "symbol", *keys).agg(F.max("at").alias("last"))


def fact(c: Context, rules: Sequence[Rule]) -> DataFrame:
    return _fact_findings(c.facts.join(c.table(rules, "kind string, operation string", [(r, *r.args) for r in rules]), ["kind", "operation"]))


def flow(c: Context, rules: Sequence[Rule]) -> DataFrame:
    t = c.table(rules, "frameworks array<string>, sinks array<string>", [(r, list(r.args[0]), list(r.args[1])) for r in rules]).select("*", F.explode("frameworks").alias("framework"))
    rows = _traced(c).withColumn("framework", F.try_element_at("source.metadata", F.lit("framework"))).join(t, "framework")
    return _trace_findings(rows.filter(_is_sink(F.col("sink.operation"), F.col("sinks"))))


def origin(c: Context, rules: Sequence[Rule]) -> DataFrame:
    t = c.table(rules, "origin string, sinks array<string>", [(r, r.args[0], list(r.args[1])) for r in rules])
    rows = _traced(c).withColumn("origin", F.col("source.operation")).join(t, "origin")
    return _trace_findings(rows.filter(_is_sink(F.col("sink.operation"), F.col("sinks"))))


def sink(c: Context, rules: Sequence[Rule]) -> DataFrame:
    rows = _traced(c).withColumn("reached", F.col("sink.operation")).join(c.table(rules, "reached string", [(r, r.args[0]) for r in rules]), "reached")
    return _trace_findings(rows)


def _escaping(c: Context, acquired: DataFrame) -> DataFrame:
    """Ids of acquisitions whose resource is later returned, passed to another call, or stored in a field that some release names."""
    later = lambda last: acquired.join(last, [*PLACE, "symbol"]).filter(F.col("at") <= F.col("last")).select("id")
    inputs = lambda kind: c.kind(kind).withColumn("symbol", F.explode("inputs"))
    returned = _last(inputs("return"), F.col("symbol"))
    passed = _last(inputs("call").filter(~F.col("operation").startswith(F.concat("symbol", F.lit(".")))), F.col("symbol"))
    left = F.trim(F.substring_index("expression", "=", 1))
    stored = inputs("propagation").withColumn("left", F.regexp_replace(left, r"\s*:$", "")).filter(F.col("left").contains("."))
    released = c.kind("resource_release").select("repo", F.explode("inputs").alias("name")).distinct()
    stored = stored.select("repo", *PLACE, "symbol", "at", F.explode(F.array("left", F.element_at(F.split("left", r"\."), -1))).alias("name")).join(released, ["repo", "name"], "left_semi")
    return reduce(DataFrame.unionByName, [later(returned), later(passed), later(_last(stored, F.col("symbol")))]).distinct()


def lifecycle(c: Context, rules: Sequence[Rule]) -> DataFrame:
    t = c.table(rules, "operation string, releases array<string>", [(r, r.args[0], list(r.args[1:])) for r in rules])
    resource = F.when(F.col("operation") == "context.cancel", F.element_at("outputs", -1)).otherwise(F.element_at("outputs", 1))
    acquired = c.kind("resource_acquire").filter(F.size("outputs") > 0).join(t, "operation").withColumn("symbol", resource)
    ways = acquired.select("id", "rule_id", *PLACE, "symbol", "at", F.explode("releases").alias("release"))
    done = _last(c.kind("resource_release").withColumn("s", F.explode("inputs")), F.col("s"), "operation").withColumnRenamed("operation", "release")
    closed = ways.join(done, [*PLACE, "symbol", "release"]).filter(F.col("at") <= F.col("last")).select("id")
    called = c.kind("call").groupBy(*PLACE, F.lower("operation").alias("name")).agg(F.max("at").alias("last"))
    names = ways.withColumn("name", F.lower(F.when(F.col("release") == "context.cancel", F.col("symbol")).otherwise(F.concat_ws(".", "symbol", "release"))))
    closed = closed.unionByName(names.join(called, [*PLACE, "name"]).filter(F.col("at") <= F.col("last")).select("id"))
    left = acquired.join(closed.distinct(), "id", "left_anti")
    return _fact_findings(left.join(_escaping(c, left), "id", "left_anti"), F.lit("The resource is acquired, and no later release of it is visible in the function."))


def iteration(c: Context, rules: Sequence[Rule]) -> DataFrame:
    t = c.table(rules, "operation string, step string, error string", [(r, *r.args) for r in rules])
    acquired = c.kind("resource_acquire").filter(F.size("outputs") > 0).join(t, "operation").withColumn("symbol", F.element_at("outputs", 1))
    calls = c.kind("call").select(*PLACE, F.col("operation").alias("name"), "at", "start_line", "end_line", "start_column", "expression")
    last = calls.groupBy(*PLACE, "name").agg(F.max(F.struct("at", "start_line", "end_line", "start_column", "expression")).alias("it"))
    read = acquired.withColumn("name", F.concat_ws(".", "symbol", "step")).join(last, [*PLACE, "name"]).filter(F.col("at") <= F.col("it.at"))
    read = read.join(_escaping(c, acquired), "id", "left_anti")
    loops = c.kind("control").filter("operation = 'for'").select(*PLACE, F.col("start_line").alias("from"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("loop_end"))
    inner = read.select("id", "rule_id", *PLACE, "it").join(loops, PLACE).filter((F.col("from") <= F.col("it.start_line")) & (F.col("loop_end.line") >= F.col("it.end_line")))
    inner = inner.groupBy("id", "rule_id").agg(F.min_by("loop_end", F.struct("loop_end.line", -F.col("from"))).alias("loop_end"))
    asked = calls.groupBy(*PLACE, F.col("name").alias("check")).agg(F.max("at").alias("checked"))
    rows = read.join(inner, ["id", "rule_id"], "left").withColumn("check", F.concat_ws(".", "symbol", "error")).join(asked, [*PLACE, "check"], "left")
    bad = rows.filter(F.col("loop_end").isNull() | F.col("checked").isNull() | (F.col("checked") < F.col("loop_end")))
    more = F.array(F.struct(F.lit("iteration").alias("kind"), F.col("file"), F.col("it.start_line").alias("line"), F.col("it.start_column").alias("column"), F.col("it.expression").alias("expression"), F.lit("It is read here.").alias("message"), F.col("function").alias("related_symbol"))).cast(f"array<{STEP}>")
    return _fact_findings(bad, F.lit("It is read in a loop, and no later look at its error is visible in the function."), more=more)


def goroutine(c: Context, rules: Sequence[Rule]) -> DataFrame:
    rows = c.kind("concurrency_operation").filter("operation = 'goroutine.loop'").join(c.table(rules, "n int", [(r, 0) for r in rules]))
    finite = F.coalesce(F.try_element_at("metadata", F.lit("loop_bound")) == "finite_collection", F.lit(False))
    rows = rows.withColumn("confidence", F.when(finite, F.lit(0.75)).otherwise(F.lit(0.85))).withColumn("strength", F.when(finite, "moderate").otherwise("strong"))
    return _fact_findings(rows, F.when(finite, "One goroutine is started for each element.").otherwise("The loop has no bound that is known beforehand."))


def hash_(c: Context, rules: Sequence[Rule]) -> DataFrame:
    rows = c.kind("crypto_operation").join(c.table(rules, "operation string", [(r, r.args[0]) for r in rules]), "operation")
    rows = rows.filter(F.lower(F.concat_ws(" ", "function", "expression", F.array_join("inputs", " "))).rlike(SENSITIVE))
    plain = F.replace("expression", F.lit(" "), F.lit(""))
    prefix = c.kind("propagation").filter(plain.contains("[:5]") & plain.contains("[5:]")).select(*PLACE, F.lit("crypto.weak.sha1").alias("operation")).distinct()
    return _fact_findings(rows.join(prefix, [*PLACE, "operation"], "left_anti"))


def mode(c: Context, rules: Sequence[Rule]) -> DataFrame:
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    rows = c.kind("file_operation").withColumn("m", F.try_element_at(F.split(get("arguments"), "\x1f"), get("mode_index").try_cast("int") + 1))
    return _fact_findings(rows.filter(other_writable(F.col("m"))).join(c.table(rules, "n int", [(r, 0) for r in rules])))


def _measured(rows: DataFrame, n: Column, limits: tuple[int, int], title: Column) -> DataFrame:
    rows = rows.filter(n > limits[0]).withColumn("severity", F.when(n > limits[1], "High").otherwise("Medium")).withColumn("title", title)
    return _fact_findings(rows)


def length(c: Context, rules: Sequence[Rule]) -> DataFrame:
    n = F.col("end_line") - F.col("start_line") + 1
    rows = c.all.filter("kind = 'function'").join(c.table(rules, "n int", [(r, 0) for r in rules]))
    return _measured(rows, n, LONG, F.concat(F.col("title"), F.lit(" ("), n.cast("string"), F.lit(" lines)")))


def complexity(c: Context, rules: Sequence[Rule]) -> DataFrame:
    go = c.kind("control").filter(F.col("file").endswith(".go"))
    per = go.groupBy("repo", *PLACE).agg((F.count(F.lit(1)) + 1).alias("n"), F.max_by(F.struct("expression", "start_line", "start_column", "end_line", "operation", "inputs", "outputs"), F.col("at")).alias("x"))
    rows = per.select("repo", *PLACE, "n", "x.*").join(c.table(rules, "k int", [(r, 0) for r in rules]))
    return _measured(rows, F.col("n"), COMPLEX, F.concat(F.col("title"), F.lit(" ("), F.col("n").cast("string"), F.lit(" decisions)")))


def costly(c: Context, rules: Sequence[Rule]) -> DataFrame:
    rows = c.kind("call").filter(F.col("operation").isin(*COSTLY) & (F.try_element_at("metadata", F.lit("in_loop")) == "true") & F.col("file").endswith(".go"))
    return _fact_findings(rows.join(c.table(rules, "n int", [(r, 0) for r in rules])))


def gorm_sql(c: Context, rules: Sequence[Rule]) -> DataFrame:
    t = c.table(rules, "n int", [(r, 0) for r in rules])
    wanted = F.array(*[F.lit(x) for x in SQL])
    traced = _traced(c).filter(_is_sink(F.col("sink.operation"), wanted) & (F.try_element_at("sink.metadata", F.lit("database")) == "gorm"))
    own = traced.filter(~F.coalesce(F.try_element_at("source.metadata", F.lit("framework")).isin("gin", "fiber"), F.lit(False))).join(t)
    open_ = c.kind("sink").filter(_is_sink(F.col("operation"), wanted) & (F.try_element_at("metadata", F.lit("database")) == "gorm")).join(traced.select(F.col("sink_id").alias("id")).distinct(), "id", "left_anti")
    open_ = open_.join(t).withColumns({"severity": F.lit("Info"), "confidence": F.lit(0.50), "strength": F.lit("heuristic")})
    return _trace_findings(own).unionByName(_fact_findings(open_, F.lit("GORM receives SQL that is built; no outside input is shown to reach it.")))


def gorm_error(c: Context, rules: Sequence[Rule]) -> DataFrame:
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    method = F.lower(F.element_at(F.split("operation", r"\."), -1))
    ops = c.kind("database_operation").filter((get("database") == "gorm") & (get("error_checked_inline") != "true")).withColumn("method", method).filter(F.col("method").isin(*TERMINAL))
    results = c.kind("propagation").filter((get("database") == "gorm") & (F.size("outputs") == 1)).withColumn("method", method)
    first = results.groupBy(*PLACE, "start_line", "method").agg(F.min_by(F.element_at("outputs", 1), F.struct("at", "id")).alias("result"))
    checked = c.kind("guard").filter("operation = 'gorm.error.checked'").select(*PLACE, F.explode("inputs").alias("result")).distinct()
    rows = ops.join(first, [*PLACE, "start_line", "method"], "left").join(checked, [*PLACE, "result"], "left_anti")
    return _fact_findings(rows.join(c.table(rules, "n int", [(r, 0) for r in rules])))


def image(c: Context, rules: Sequence[Rule]) -> DataFrame:
    """The last reading before a use decides whether a look at the image lies between: an earlier one would be at least as well guarded."""
    read = c.kind("call").filter("operation = 'python.opencv.imread' and size(outputs) > 0").select(*PLACE, F.element_at("outputs", 1).alias("symbol"), "at", F.lit(0).alias("side"))
    looks = c.kind("guard").filter("operation = 'python.opencv.image_checked'").select(*PLACE, F.explode("inputs").alias("symbol"), "at", F.lit(1).alias("side"))
    uses = c.kind("guard").filter("operation = 'python.opencv.image_consumer'").withColumn("symbol", F.explode("inputs")).withColumn("side", F.lit(2))
    w = Window.partitionBy(*PLACE, "symbol").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = uses.unionByName(read, allowMissingColumns=True).unionByName(looks, allowMissingColumns=True)
    both = both.withColumn("read", F.max(F.when(F.col("side") == 0, F.col("at"))).over(w)).withColumn("look", F.max(F.when(F.col("side") == 1, F.col("at"))).over(w))
    rows = both.filter((F.col("side") == 2) & F.col("read").isNotNull() & (F.col("look").isNull() | (F.col("look") < F.col("read"))))
    return _fact_findings(rows.join(c.table(rules, "n int", [(r, 0) for r in rules])))


def capture(c: Context, rules: Sequence[Rule]) -> DataFrame:
    acquired = c.kind("resource_acquire").filter("operation = 'python.opencv.capture' and size(outputs) > 0").withColumn("symbol", F.element_at("outputs", 1))
    gone = _last(c.kind("resource_release", "return").withColumn("s", F.explode("inputs")), F.col("s"))
    rows = acquired.join(gone, [*PLACE, "symbol"], "left").filter(F.col("last").isNull() | (F.col("last") < F.col("at")))
    return _fact_findings(rows.join(c.table(rules, "n int", [(r, 0) for r in rules])))


def layer(c: Context, rules: Sequence[Rule]) -> DataFrame:
    rows = c.all.filter("kind = 'import'").withColumn("upper", first_keyword(F.col("file"), UPPER_LAYER)).withColumn("lower", first_keyword(F.concat(F.lit("/"), F.col("operation")), DATA_LAYER))
    rows = rows.filter("upper is not null and lower is not null").withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "start_column": F.lit(1), "expression": F.col("operation")})
    return _fact_findings(rows.join(c.table(rules, "n int", [(r, 0) for r in rules])))


PATTERNS = {"fact": fact, "flow": flow, "origin": origin, "sink": sink, "lifecycle": lifecycle, "iteration": iteration, "goroutine": goroutine, "hash": hash_, "mode": mode, "length": length, "complexity": complexity, "costly": costly, "gorm_sql": gorm_sql, "gorm_error": gorm_error, "image": image, "capture": capture, "layer": layer}


def ecosystems(imports: DataFrame) -> DataFrame:
    """(repo, ecosystem): what each repository uses."""
    return imports.select("repo", ecosystem(F.col("path")).alias("ecosystem")).filter("ecosystem is not null").distinct()


def run(facts: DataFrame | Context, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of all rules over the facts of `semantic_facts`, with `repo` where there are several repositories, or a context of them.

    A rule is active in a repository that uses all ecosystems it requires. A
    context-required rule with a finding that lacks observation or hypothesis
    gives none. Facts without a place give no finding.
    """
    known = register(rules)
    c = facts if isinstance(facts, Context) else Context(facts)
    by: dict[str, list[Rule]] = {}
    for r in known.values():
        by.setdefault(r.pattern, []).append(r)
    found = reduce(DataFrame.unionByName, [PATTERNS[p](c, rs).select(*COLUMNS) for p, rs in by.items()])
    needs = [(r.id, e, len(r.requires)) for r in known.values() for e in r.requires]
    if needs:
        n = F.broadcast(c.spark.createDataFrame(needs, "rule_id string, ecosystem string, needed int"))
        active = ecosystems(c.imports).join(n, "ecosystem").groupBy("repo", "rule_id").agg(F.count(F.lit(1)).alias("have"), F.first("needed").alias("needed")).filter("have = needed").select("repo", "rule_id")
        gated = F.col("rule_id").isin(*{x[0] for x in needs})
        found = found.filter(~gated).unionByName(found.filter(gated).join(active, ["repo", "rule_id"], "left_semi").select(*COLUMNS))
    return found
