"""Code graph: nodes, edges, call resolution and bounded queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

#: Most edges and nodes of a graph that one Python worker holds; an edge takes 8 bytes while it is read and 4 afterwards.
BIT_EDGES, BIT_NODES = 16_000_000, 1_000_000
#: Bits that the levels of one group of starts may take together.
BITS = 1 << 30


def canonical(col: Column) -> Column:
    """A receiver's type without parentheses, its last word, without leading stars."""
    return F.regexp_replace(F.element_at(F.split(F.trim(F.regexp_replace(col, "[()]", "")), r"\s+"), -1), r"^\*+", "")


def upsert(nodes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by sequence number."""
    return nodes.groupBy(key).agg(F.max_by(F.struct(*nodes.columns), F.col(seq)).alias("_r")).select("_r.*")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call edges (call_id, caller_id, callee_id), only where exactly one caller and one callee fit.

    calls: call_id, file, caller, callee, receiver. functions: node_id, file,
    name, receiver (null for plain functions). A call with a receiver fits a
    method of that canonical name anywhere, one without a plain function of its
    file. Names that fit several nodes are dropped before the joins.
    """
    own = functions.withColumn("canonical", F.when(F.col("receiver").isNull(), F.col("name")).otherwise(F.concat_ws(".", canonical(F.col("receiver")), "name")))
    one = lambda df, keys: df.groupBy(*keys).agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("node_id")).filter("n = 1").drop("n")
    callers = one(own, ["file", "canonical"]).withColumnsRenamed({"canonical": "caller", "node_id": "caller_id"})
    methods = one(own.filter("receiver is not null"), ["canonical"]).withColumnsRenamed({"canonical": "target", "node_id": "m_id"})
    plain = one(own.filter("receiver is null"), ["file", "name"]).withColumnsRenamed({"name": "callee", "node_id": "p_id"})
    rows = calls.join(callers, ["file", "caller"]).withColumn("target", F.when(F.col("receiver").isNotNull(), F.concat_ws(".", canonical(F.col("receiver")), "callee")))
    rows = rows.join(methods, "target", "left").join(plain, ["file", "callee"], "left")
    callee = F.when(F.col("receiver").isNotNull(), F.col("m_id")).otherwise(F.col("p_id"))
    return rows.select("call_id", "caller_id", callee.alias("callee_id")).filter("callee_id is not null")


def reach(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, distance): nodes at distance 1..depth from each start, each once at its least distance, the start left out.

    edges: src, dst. starts: start. A round joins the last round's new nodes
    and drops nodes already seen, so cycles end and parallel edges cost nothing.
    Lineage is cut by a written table every second round.
    """
    e = edges.select(F.col("dst" if reverse else "src").alias("node"), F.col("src" if reverse else "dst").alias("next")).filter("node is not null and next is not null").distinct()
    front = starts.select("start").distinct().withColumn("node", F.col("start"))
    seen: DataFrame | None = None
    for d in range(1, depth + 1):
        new = front.join(e, "node").select("start", F.col("next").alias("node")).filter("node <> start").distinct()
        if seen is not None:
            new = new.join(seen, ["start", "node"], "left_anti")
        new = new.withColumn("distance", F.lit(d))
        if d % 2 == 0 and d < depth:
            new = materialize(new, "reach")
        front = new.select("start", "node")
        seen = new if seen is None else seen.unionByName(new)
    return seen if seen is not None else starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).limit(0)


def reach_dense(edges: DataFrame, depth: int) -> DataFrame:
    """As `reach` from every node that has an edge, for graphs with many more walks than pairs of nodes.

    Joins make a row of every walk. Where that is more than sending the whole
    graph to each of a few groups of starts, a group keeps a bit for each of its
    starts at every node instead, and an edge passes on all of them at once; no
    pair is shuffled. Graphs of few walks, or too large for a worker, are joined.
    """
    kind = edges.schema["src"].dataType.simpleString()
    e = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    joined = lambda: reach(e, e.select(F.col("src").alias("start")), depth)
    n_edges = e.count()
    if not 0 < depth < 256 or n_edges > BIT_EDGES:
        return joined()
    nodes = materialize(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    if nodes.count() > BIT_NODES:
        return joined()
    lists = e.join(nodes.select(F.col("node").alias("src"), "id"), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("to")), "dst").groupBy("id").agg(F.collect_list("to").alias("next"))
    whole = nodes.join(lists, "id", "left").select("id", "node", F.coalesce("next", F.array().cast("array<bigint>")).alias("next"))
    whole = materialize(whole, "graph")
    n_nodes, n_starts = whole.agg(F.count(F.lit(1)), F.count_if(F.size("next") > 0)).first()
    groups = _groups(n_nodes, n_starts, depth, e.sparkSession.sparkContext.defaultParallelism)
    if _walks(whole, depth) <= groups * (n_nodes + n_edges):
        return joined()
    sent = whole.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, "group")
    return sent.mapInArrow(_in_bits(depth, groups), f"start {kind}, node {kind}, distance int")


def _groups(nodes: int, starts: int, depth: int, parallelism: int) -> int:
    """Groups of at least 64 starts whose levels stay within BITS, two for each core where there are so many."""
    each = max(64, BITS // (depth + 2) // max(1, nodes) // 64 * 64)
    return max(1, -(-starts // each), min(-(-starts // 64), 2 * parallelism))


def _walks(whole: DataFrame, depth: int) -> float:
    """Walks of 1..depth edges: the rows that joins would make, if no pair were met twice."""
    now = whole.select("next", F.lit(1.0).alias("walks"))
    sums: DataFrame | None = None
    for d in range(depth):
        one = now.agg(F.sum(F.col("walks") * F.size("next")).alias("walks"))
        sums = one if sums is None else sums.union(one)
        if d + 1 < depth:
            at = now.select(F.explode("next").alias("id"), "walks").groupBy("id").agg(F.sum("walks").alias("walks"))
            now = whole.join(at, "id").select("next", "walks")
    return sums.agg(F.sum("walks")).first()[0] or 0.0


def _in_bits(depth: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition with the whole graph (id, node, next, group): what each start of the group reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, sizes, nexts, group = [], [], [], [], 0
        for b in batches:
            if b.num_rows:
                group = b.column("group")[0].as_py()
                names.append(b.column("node"))
                ids.append(b.column("id").to_numpy())
                sizes.append(np.asarray(b.column("next").value_lengths()))
                nexts.append(b.column("next").flatten().to_numpy())
        if not ids:
            return
        names, ids, sizes = pa.chunked_array(names).combine_chunks(), np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(ids)
        ids = ids[order]
        for i, x in enumerate(nexts):
            nexts[i] = order[np.searchsorted(ids, x)].astype(np.int32)
        nexts, ends = np.concatenate(nexts), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        mine = order[sizes[order] > 0][group::groups]  # in the order of ids, which is the same in every group
        if not len(mine):
            return
        n, bit = len(ids), np.arange(len(mine))
        front = np.zeros((n, -(-len(mine) // 64)), np.uint64)
        front.view(np.uint8)[mine, bit >> 3] = 128 >> (bit & 7)
        seen, levels = front.copy(), []
        for _ in range(depth):
            new = np.zeros_like(front)
            for u in np.flatnonzero(front.any(axis=1)):
                new[nexts[ends[u] : ends[u + 1]]] |= front[u]
            new &= ~seen
            if not new.any():
                break
            seen |= new
            levels.append(new.view(np.uint8))
            front = new
        own = names.take(pa.array(mine))
        for k in range(-(-len(mine) // 8)):
            for low in range(0, n, 16384):
                dist = sum(np.unpackbits(x[low : low + 16384, k]) * np.uint8(d) for d, x in enumerate(levels, 1))
                if np.any(dist):
                    dist = np.ascontiguousarray(dist.reshape(-1, 8).T)
                    s, v = np.nonzero(dist)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(s + 8 * k)), names.take(pa.array(v + low)), pa.array(dist[s, v].astype(np.int32))], ["start", "node", "distance"])

    return run


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 11, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, src, dst, path): all simple paths of 2..most nodes between given pairs; a path stops at its target.

    keys: columns of both sides that tell graphs apart, usually the scan. Only
    nodes that still reach the target in the steps left are walked to, so no
    path is grown that cannot end there.
    """
    keys = list(keys)
    e = materialize(edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "edges")
    open_ = pairs.filter("src <> dst").select(*keys, "src", "dst").distinct()
    left = _to_target(e, open_.select(*keys, "dst").distinct(), keys, most - 1)
    open_ = open_.withColumn("node", F.col("src")).withColumn("path", F.array("src"))
    out: DataFrame | None = None
    for step in range(1, most):
        grown = open_.join(e, [*keys, "node"]).filter(~F.array_contains("path", F.col("next")))
        ends = left.filter(F.col("steps") <= most - 1 - step).select(*keys, "dst", F.col("node").alias("next"))
        grown = grown.join(ends, [*keys, "dst", "next"]).select(*keys, "src", "dst", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        grown = materialize(grown, "paths")
        if grown.isEmpty():
            break
        done = grown.filter(F.col("node") == F.col("dst")).select(*keys, "src", "dst", "path")
        out = done if out is None else out.unionByName(done)
        open_ = grown.filter(F.col("node") != F.col("dst"))
    return out if out is not None else pairs.select(*keys, "src", "dst", F.array("src").alias("path")).limit(0)


def _to_target(e: DataFrame, targets: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, dst, node, steps): the fewest steps from each node to each target, up to `depth`; the target itself takes none."""
    front = targets.withColumn("node", F.col("dst")).withColumn("steps", F.lit(0))
    seen = front
    back = e.select(*keys, F.col("next").alias("node"), F.col("node").alias("before")).distinct()
    for d in range(1, depth + 1):
        new = front.join(back, [*keys, "node"]).select(*keys, "dst", F.col("before").alias("node")).distinct().join(seen, [*keys, "dst", "node"], "left_anti").withColumn("steps", F.lit(d))
        new = materialize(new, "targets")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen


def called_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct direct callers (node, caller) of the given nodes."""
    return edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst").select(F.col("dst").alias("node"), F.col("src").alias("caller")).distinct()


def most_called(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes with most call sites; ties by name."""
    return edges.groupBy("dst").agg(F.sum("n").alias("sites")).orderBy(F.desc("sites"), "dst").limit(n).select(F.col("dst").alias("node"), "sites")


def edge_ids(edges: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Deterministic ids e1, e2, ... within a repository, by the order of its call sites."""
    return edges.withColumn("edge_id", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("string")))


def build(files: DataFrame, functions: DataFrame, types: DataFrame, imports: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a code graph, without its call edges.

    files: file. functions: file, name, receiver, start_line, end_line. types:
    file, name, start_line, end_line. imports: file, path, alias. symbols: file,
    name, kind. A node's id is the file, `file:name` or `file:Receiver.name`,
    `import:file:path` or `Kind:file:name`; of several nodes of one id the one
    added last stays, in the order given here, and all edges stay. Null files
    and names give none.
    """
    none = F.lit(None).cast("string")
    span = lambda df: (F.col("start_line").cast("int"), F.col("end_line").cast("int")) if "start_line" in df.columns else (F.lit(None).cast("int"), F.lit(None).cast("int"))

    def rows(df: DataFrame, seq: int, node: Column, kind: Column, name: Column, edge: str | None) -> DataFrame:
        a, b = span(df)
        return df.filter("file is not null").select(F.lit(seq).alias("seq"), node.alias("id"), kind.alias("kind"), name.alias("name"), "file", a.alias("start_line"), b.alias("end_line"), (F.lit(edge) if edge else none).alias("edge"))

    own = F.when(F.coalesce("receiver", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", canonical(F.col("receiver")), "name"))
    parts = [
        rows(files, 0, F.col("file"), F.lit("File"), F.col("file"), None),
        rows(functions.filter("name is not null"), 1, F.concat_ws(":", "file", own), F.when(F.coalesce("receiver", F.lit("")) == "", "Function").otherwise("Method"), F.col("name"), "Contains"),
        rows(types.filter("name is not null"), 2, F.concat_ws(":", "file", "name"), F.lit("Type"), F.col("name"), "Contains"),
        rows(imports.filter("path is not null"), 3, F.concat_ws(":", F.lit("import"), "file", "path"), F.lit("Import"), F.when(F.coalesce("alias", F.lit("")).isin("") | (F.col("alias") == F.col("path")), F.col("path")).otherwise(F.concat_ws(":", "alias", "path")), "Imports"),
        rows(symbols.filter("name is not null and kind not in ('Function', 'Type', 'File')"), 4, F.concat_ws(":", "kind", "file", "name"), F.col("kind"), F.col("name"), "Contains"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    nodes = every.groupBy("id").agg(F.max_by(F.struct("kind", "name", "file", "start_line", "end_line"), F.struct("seq", F.coalesce("start_line", F.lit(0)))).alias("n")).select("id", "n.*")
    edges = every.filter("edge is not null").select(F.col("edge").alias("kind"), F.col("file").alias("src"), F.col("id").alias("dst"))
    return nodes, edges


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of one kind, by id."""
    return nodes.filter(F.col("kind") == kind)


def relations(edges: DataFrame, starts: DataFrame, depth: int, most: int, reverse: bool = False) -> DataFrame:
    """(start, node, rank): at most `most` nodes within `depth` calls of each start, nearer ones first, of equally near ones by id."""
    near = reach(edges, starts, depth, reverse)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("distance", "node"))).filter(F.col("rank") <= most).select("start", "node", "rank")


def find_symbols(nodes: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(key, node...) of the nodes named, in the order file, line, name, id; at most `most` for each key. names: key, name."""
    met = nodes.join(names.distinct(), "name")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("file", "start_line", "name", "id"))).filter(F.col("rank") <= most)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, functions with methods, types, files."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind").isin("Function", "Method")).alias("functions"), F.count_if(F.col("kind") == "Type").alias("types"), F.count_if(F.col("kind") == "File").alias("files"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def ordered_calls(calls: DataFrame, group: list[str], start: Column | int = 0) -> DataFrame:
    """Call edges with ids e<N> in the order file, line, caller's receiver, caller, callee's receiver, callee; N goes on after `start`."""
    keys = [F.col(c).asc_nulls_first() for c in ("file", "line", "caller_receiver", "caller", "callee_receiver", "callee")]
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*keys)) + start
    return calls.withColumn("edge_id", F.concat(F.lit("e"), n.cast("string")))
