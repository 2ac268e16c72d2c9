"""Bounded taint propagation from sources to sinks.

A source taints its outputs from its line on. A propagation, a sink or a call
that reads a tainted symbol at or after that line continues the trace, until a
kill, a write of the symbol without inputs that is not conditional, or a
sanitizer of the symbol lies in between. A write with clean inputs leaves the
older taint. Whether a taint is killed does not depend on the source, so each
write knows beforehand how far it reaches, and rounds of joins find the facts a
source taints: of several tainted writes of a symbol that reach equally far only
the first goes on, so no pairs of writes and reads are formed in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

# Limits and the confidence and strength of a trace.
MAX_STEPS, MAX_CALL_DEPTH = 16, 2
DIRECT, LOCAL, INTERPROCEDURAL = (0.95, "strong"), (0.90, "strong"), (0.80, "moderate")

PLACE = ["file", "function"]
_SYMBOLS = "array<string>"


def wide(facts: DataFrame) -> DataFrame:
    """Facts with all columns that traces need: one `input` and `output` become arrays, absent columns are empty."""
    have, out = set(facts.columns), facts
    if "start_line" not in have:
        out = out.withColumn("start_line", F.col("line"))
    if "start_column" not in have:
        out = out.withColumn("start_column", F.lit(0))
    for one, many in (("input", "inputs"), ("output", "outputs")):
        if many not in have:
            out = out.withColumn(many, F.when(F.col(one).isNotNull(), F.array(one)).otherwise(F.array().cast(_SYMBOLS)))
    for name, kind in (("arguments", _SYMBOLS), ("argument_inputs", "array<array<string>>"), ("metadata", "map<string,string>"), ("operation", "string")):
        if name not in have:
            out = out.withColumn(name, F.lit(None).cast(kind))
    empty = F.array().cast(_SYMBOLS)
    repo = F.col("repo").cast("string") if "repo" in have else F.lit("")
    return out.select(
        repo.alias("repo"), "id", "kind", "operation", *PLACE, F.col("start_line").cast("int").alias("line"), F.coalesce(F.col("start_column").cast("int"), F.lit(0)).alias("column"), F.coalesce("inputs", empty).alias("inputs"), F.coalesce("outputs", empty).alias("outputs"), "arguments", "argument_inputs", "metadata"
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit(name)) == "true", F.lit(False))


def _node(col: str) -> Column:
    return F.concat(F.lit("f:"), F.col(col).cast("string"))


def resolve(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, node_id): the function of a call's last selector, unique everywhere, else unique in the caller's file; else none.

    calls: call_id, callee, file. functions: node_id, name, file. Where both have
    `repo`, everywhere means the caller's repository.
    """
    keys = ["repo", "name"] if "repo" in calls.columns and "repo" in functions.columns else ["name"]
    everywhere = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("g")).filter("n = 1").select(*keys, "g")
    here = functions.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("l")).filter("n = 1").select("name", "file", "l")
    rows = calls.withColumn("name", F.element_at(F.split(F.trim("callee"), r"\."), -1)).join(everywhere, keys, "left").join(here, ["name", "file"], "left")
    return rows.select("call_id", F.coalesce("g", "l").alias("node_id")).filter("node_id is not null")


def return_dependencies(flows: DataFrame, params: DataFrame, returns: DataFrame, depth: int) -> DataFrame:
    """(function, position): parameters that flow, in any order of lines, to a return within `depth` moves.

    flows: function, src, dst symbols. params: function, symbol, position. returns: function, symbol.
    """
    at = params.select("function", "position", F.col("symbol").alias("at")).distinct()
    seen = at
    for _ in range(depth):
        new = at.join(flows, (at["function"] == flows["function"]) & (at["at"] == flows["src"])).select(at["function"], "position", F.col("dst").alias("at")).distinct().join(seen, ["function", "position", "at"], "left_anti")
        seen, at = seen.unionByName(new), new
    return seen.join(returns.select("function", F.col("symbol").alias("at")), ["function", "at"], "left_semi").select("function", "position").distinct()


def positional_inputs() -> Column:
    """The symbols of each argument: as listed by position, else each argument's text, else one input each."""
    one = lambda c: F.transform(c, lambda x: F.array(F.trim(x)))
    return F.when(F.size("argument_inputs") > 0, F.transform("argument_inputs", lambda x: F.coalesce(x, F.array().cast(_SYMBOLS)))).when(F.size("arguments") > 0, one("arguments")).otherwise(one("inputs"))


def _arguments(facts: DataFrame) -> DataFrame:
    """(id, file, function, line, operation, position, symbol) of the arguments before the first one without symbols."""
    rows = facts.filter(~_flag("external_import") & F.col("operation").isNotNull()).withColumn("args", positional_inputs())
    gap = F.array_position(F.transform("args", lambda x: F.size(x) == 0), True)
    rows = rows.select("id", *PLACE, "line", "operation", gap.alias("gap"), F.posexplode("args").alias("position", "symbols")).filter((F.col("gap") == 0) | (F.col("position") < F.col("gap") - 1))
    return rows.select("id", *PLACE, "line", "operation", "position", F.explode("symbols").alias("symbol")).filter("symbol is not null")


def _reaching(writes: DataFrame, facts: DataFrame) -> DataFrame:
    """writes (node, file, function, symbol, line, column) with `until`, the first line from which the taint is gone, or null."""
    kills = facts.filter((F.col("kind") == "propagation") & (F.size("inputs") == 0) & ~_flag("conditional"))
    stops = kills.select(*PLACE, F.explode("outputs").alias("symbol"), "line", "column", F.lit("kill").alias("stop")).unionByName(
        facts.filter("kind = 'sanitizer'").select(*PLACE, F.explode("outputs").alias("symbol"), "line", "column", F.lit("clean").alias("stop"))
    )
    both = writes.withColumn("stop", F.lit(None).cast("string")).unionByName(stops.withColumn("node", F.lit(None).cast("string")))
    own = Window.partitionBy(*PLACE, "symbol")
    after = own.orderBy("line", "column", F.col("stop").isNull()).rowsBetween(1, Window.unboundedFollowing)
    here = own.orderBy("line").rangeBetween(0, Window.unboundedFollowing)
    killed = F.min(F.when(F.col("stop") == "kill", F.col("line"))).over(after)
    cleaned = F.min(F.when(F.col("stop") == "clean", F.col("line"))).over(here)
    return both.withColumn("until", F.least(killed, cleaned)).filter("node is not null").drop("stop")


def traces(facts: DataFrame, functions: DataFrame | None = None, max_steps: int = MAX_STEPS, max_depth: int = MAX_CALL_DEPTH, cut_every: int = 1) -> DataFrame:
    """(source_id, sink_id, steps, interprocedural, path): for each source and sink it reaches the fewest propagations between them, in order.

    facts: as `wide` takes them; ids of any type. functions: file, name,
    parameters, start_line; without them calls are not followed. A call passes a
    tainted argument to the callee's parameter; a propagation through a function
    of the tree only taints its outputs if the parameter reaches a return. Both
    are interprocedural and one level deeper, at most `max_depth` levels. At most
    `max_steps` propagations are followed. Of equally short traces the one with
    fewer levels counts, then the one of the smaller ids. Null symbols, places
    and kinds lead nowhere.
    """
    id_type = facts.schema["id"].dataType
    f = materialize(wide(facts).filter("kind is not null and line is not null"), "facts")
    prop = f.filter("kind = 'propagation'")
    writes = f.filter("kind in ('source', 'propagation')").select(_node("id").alias("node"), *PLACE, F.explode("outputs").alias("symbol"), "line", "column").filter("symbol is not null")
    reads = f.filter("kind in ('propagation', 'sink')").select(_node("id").alias("next"), "kind", *PLACE, F.explode("inputs").alias("symbol"), "line").filter("symbol is not null").withColumn("deeper", F.lit(0))
    if functions is not None:
        fn = functions.select((F.col("repo").cast("string") if "repo" in functions.columns else F.lit("")).alias("repo"), "file", "name", F.coalesce("parameters", F.array().cast(_SYMBOLS)).alias("parameters"), F.col("start_line").cast("int").alias("start_line"))
        fn = fn.withColumn("node_id", F.concat_ws("\0", "file", "name", F.col("start_line").cast("string"))).dropDuplicates(["node_id"])
        fn = materialize(fn, "functions")
        params = fn.select("node_id", "file", F.col("name").alias("function"), "start_line", F.posexplode("parameters").alias("position", "symbol"))
        called = resolve(f.filter(F.col("kind").isin("call", "propagation") & ~_flag("external_import")).select("repo", F.col("id").alias("call_id"), "kind", "file", F.col("operation").alias("callee")), fn.select("repo", "node_id", "file", "name"))
        called = materialize(called.select(F.col("call_id").alias("id"), "node_id"), "calls")
        entry = F.concat(F.lit("e:"), F.col("node_id"), F.lit("\0"), F.col("position").cast("string"))
        entries = params.select(entry.alias("node"), "file", "function", "symbol", F.col("start_line").alias("line"), F.lit(0).alias("column"))
        writes = writes.unionByName(entries)
        into = _arguments(f.filter("kind = 'call'")).join(called, "id").join(params.select("node_id", "position").distinct(), ["node_id", "position"])
        reads_in = into.select(entry.alias("next"), F.lit("propagation").alias("kind"), *PLACE, "symbol", "line", F.lit(1).alias("deeper"))
        own = F.concat_ws("\0", "file", "function")
        flows = prop.select(own.alias("function"), F.explode("inputs").alias("src"), "outputs").select("function", "src", F.explode("outputs").alias("dst")).distinct()
        returns = f.filter("kind = 'return'").select(own.alias("function"), F.explode("inputs").alias("symbol")).distinct()
        deps = return_dependencies(flows, params.select(F.concat_ws("\0", "file", "function").alias("function"), "symbol", "position"), returns, 4)
        deps = materialize(deps, "returns").join(fn.select(F.concat_ws("\0", "file", "name").alias("function"), "node_id"), "function").select("node_id", "position")
        local = prop.join(called, "id", "left_semi").select("id")
        back = _arguments(prop).join(called, "id").join(deps, ["node_id", "position"], "left_semi")
        reads_back = back.select(_node("id").alias("next"), F.lit("propagation").alias("kind"), *PLACE, "symbol", "line", F.lit(1).alias("deeper"))
        reads = reads.join(local.select(_node("id").alias("next")), "next", "left_anti").unionByName(reads_in).unionByName(reads_back)
    writes = materialize(_reaching(writes, f), "writes")
    reads = materialize(reads.distinct().withColumnRenamed("line", "read"), "reads")

    front = f.filter("kind = 'source'").select(_node("id").alias("source"), _node("id").alias("at"), F.lit(0).alias("depth"), F.array().cast(_SYMBOLS).alias("path"))
    seen = front.select("source", "at", "depth")
    done = front.select("source", "at", F.lit(0).alias("steps"), "depth", "path").limit(0)
    for step in range(max_steps + 1):
        state = front.join(writes, F.col("at") == F.col("node")).groupBy("source", *PLACE, "symbol", "until", "depth").agg(F.min(F.struct("line", "path", "at")).alias("w"))
        hit = state.join(reads, [*PLACE, "symbol"]).filter((F.col("w.line") <= F.col("read")) & (F.col("until").isNull() | (F.col("read") < F.col("until"))) & (F.col("next") != F.col("w.at")))
        hit = hit.select("source", F.col("next").alias("at"), "kind", (F.col("depth") + F.col("deeper")).alias("depth"), F.col("w.path").alias("path")).filter(F.col("depth") <= max_depth)
        hit = hit.groupBy("source", "at", "kind").agg(F.min(F.struct("depth", "path")).alias("b"))
        hit = hit.select("source", "at", "kind", F.col("b.depth").alias("depth"), F.col("b.path").alias("path"))
        old = seen.groupBy("source", "at").agg(F.min("depth").alias("before"))
        hit = hit.join(old, ["source", "at"], "left").filter("before is null or depth < before").drop("before")
        if step % cut_every == cut_every - 1:
            hit = materialize(hit, "taint")
            if hit.isEmpty():
                break
        sinks = hit.filter("kind = 'sink'").select("source", "at", F.lit(step).alias("steps"), "depth", "path")
        done = done.unionByName(sinks)
        seen = seen.unionByName(hit.select("source", "at", "depth"))
        # The entry of a callee is no propagation of its own: it adds a level, not a step that is shown.
        front = hit.filter("kind = 'propagation'").select("source", "at", "depth", F.when(F.col("at").startswith("f:"), F.concat("path", F.array("at"))).otherwise(F.col("path")).alias("path"))
    best = done.groupBy("source", "at").agg(F.min(F.struct("steps", "depth", "path")).alias("b"))
    back_id = lambda c: F.substring(c, 3, 1 << 30).cast(id_type)
    return best.select(back_id(F.col("source")).alias("source_id"), back_id(F.col("at")).alias("sink_id"), F.col("b.steps").alias("steps"), (F.col("b.depth") > 0).alias("interprocedural"), F.transform("b.path", back_id).alias("path"))


def graded(found: DataFrame) -> DataFrame:
    """Traces with their confidence and strength."""
    crossed = F.col("interprocedural") if "interprocedural" in found.columns else F.lit(False)
    conf = F.when(crossed, F.lit(INTERPROCEDURAL[0])).when(F.col("steps") == 0, F.lit(DIRECT[0])).otherwise(F.lit(LOCAL[0]))
    return found.withColumn("confidence", conf).withColumn("strength", F.when(crossed, INTERPROCEDURAL[1]).otherwise(DIRECT[1]))
