from __future__ import annotations

import random

from quarry.operators import graph, lifecycle, taint
from quarry.operators.legacy import nil_dereference

SCHEMA = "id bigint, kind string, operation string, file string, function string, line int, input string, output string"


def random_facts(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["source", "sink", "propagation", "resource_acquire", "resource_release"])
        s = lambda p: rng.choice(["a", "b", "c", None]) if rng.random() < p else None
        rows.append((i, kind, rng.choice(["o1", "o2"]), "f", f"fn{i % 4}", i, s(0.8) if kind in ("sink", "propagation", "resource_release") else None, s(0.9) if kind in ("source", "propagation", "resource_acquire") else None))
    return rows


def brute_traces(rows, most):
    """By the definition: a source's taint of a symbol lasts until a write of it without an input."""
    out = {}
    kills = [w for w in rows if w[1] == "propagation" and w[6] is None and w[7]]
    for src in (r for r in rows if r[1] == "source" and r[7]):
        steps, front = {}, [(src, 0)]
        while front:
            nxt = []
            for w, n in front:
                for r in rows:
                    if r[1] in ("sink", "propagation") and r[0] != w[0] and r[4] == w[4] and r[6] and r[6] == w[7] and r[5] >= w[5] and not any(k[4] == w[4] and k[7] == w[7] and w[5] < k[5] <= r[5] for k in kills) and r[0] not in steps:
                        steps[r[0]] = n
                        if r[1] == "propagation" and n < most:
                            nxt.append((r, n + 1))
            front = nxt
        out |= {(src[0], r[0]): steps[r[0]] for r in rows if r[1] == "sink" and r[0] in steps}
    return out


def test_traces_against_a_walk_in_order(spark):
    for seed in (1, 2):
        rows = random_facts(seed)
        found = taint.traces(spark.createDataFrame(rows, SCHEMA), max_steps=3).collect()
        got = {(r.source_id, r.sink_id): r.steps for r in found}
        assert got == brute_traces(rows, 3) and got
        assert all(len(r.path) == r.steps for r in found)


def test_kill_overwrite_and_order(spark):
    f = lambda *rows: spark.createDataFrame([(i, k, "", "f", "g", n, a, b) for i, (k, n, a, b) in enumerate(rows)], SCHEMA)
    steps = lambda df: [(r.source_id, r.sink_id, r.steps) for r in taint.traces(df).collect()]
    assert steps(f(("source", 1, None, "x"), ("sink", 2, "x", None))) == [(0, 1, 0)]
    assert steps(f(("source", 1, None, "x"), ("propagation", 2, "x", "y"), ("sink", 3, "y", None))) == [(0, 2, 1)]
    assert steps(f(("sink", 1, "x", None), ("source", 2, None, "x"))) == []
    assert steps(f(("source", 1, None, "x"), ("propagation", 2, None, "x"), ("sink", 3, "x", None))) == []
    assert steps(f(("source", 1, None, "x"), ("sink", 2, "x", None), ("propagation", 3, None, "x"))) == [(0, 1, 0)]
    assert steps(f(("source", 1, None, "x"), ("propagation", 2, "clean", "x"), ("sink", 3, "x", None))) == [(0, 2, 0)]  # a clean input leaves the older taint
    assert steps(f(("source", 1, None, "x"), ("sanitizer", 2, "x", "x"), ("sink", 3, "x", None))) == []
    assert steps(f(("source", 1, None, "x"), ("sink", 2, "x", None), ("sanitizer", 3, "x", "x"))) == [(0, 1, 0)]
    assert taint.traces(f(("source", 1, None, "x")).limit(0)).count() == 0


def test_lifecycles_against_brute_force(spark):
    rows = random_facts(5)
    df = spark.createDataFrame(rows, SCHEMA)
    acq = [r for r in rows if r[1] == "resource_acquire"]
    open_ = {a[0] for a in acq if not any(r[1] == "resource_release" and r[2] == a[2] and r[4] == a[4] and r[6] is not None and r[6] == a[7] and r[5] > a[5] for r in rows)}
    assert {r.id for r in lifecycle.unreleased(df).collect()} == open_
    gone = {a[0] for a in acq if any(r[1] == "propagation" and r[4] == a[4] and r[6] is not None and r[6] == a[7] and r[5] > a[5] for r in rows)}
    assert {r.id for r in lifecycle.leaks(df).collect()} == open_ - gone


def test_as_of_takes_the_newest_version(spark):
    v = spark.createDataFrame([("f", "g", "x", 1, 10), ("f", "g", "x", 5, 20), ("f", "g", "y", 1, 30)], "file string, function string, symbol string, line int, value bigint")
    r = spark.createDataFrame([(1, "f", "g", "x", 4), (2, "f", "g", "x", 5), (3, "f", "g", "x", 0), (4, "f", "h", "x", 9)], "id bigint, file string, function string, symbol string, line int")
    assert {(x.id, x.value) for x in lifecycle.as_of(v, r).collect()} == {(1, 10), (2, 20)}


def test_calls_resolve_only_when_unambiguous(spark):
    fn = spark.createDataFrame([("a:run", "a", "run", None), ("a:T.run", "a", "run", "*T"), ("b:T2.go", "b", "go", "(t *T2)"), ("c:T2.go", "c", "go", "T2"), ("a:main", "a", "main", None)], "node_id string, file string, name string, receiver string")
    calls = spark.createDataFrame([(1, "a", "main", "run", None), (2, "a", "main", "run", "T"), (3, "a", "main", "go", "T2"), (4, "b", "main", "run", None), (5, "a", "main", "gone", None)], "call_id int, file string, caller string, callee string, receiver string")
    assert {(r.call_id, r.callee_id) for r in graph.resolve_calls(calls, fn).collect()} == {(1, "a:run"), (2, "a:T.run")}


def test_reach_with_cycles_and_parallel_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "a")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.distance) for r in graph.reach(e, s, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node, r.distance) for r in graph.reach(e, s, 2, reverse=True).collect()} == {("c", 1), ("b", 2)}


def test_paths_are_simple_and_stop_at_the_target(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c")], "src string, dst string")
    p = spark.createDataFrame([("a", "c"), ("a", "a")], "src string, dst string")
    assert {tuple(r.path) for r in graph.simple_paths(e, p).collect()} == {("a", "c"), ("a", "b", "c")}


def test_return_dependencies(spark):
    flows = spark.createDataFrame([("f", "p0", "x"), ("f", "x", "y"), ("f", "p1", "z")], "function string, src string, dst string")
    params = spark.createDataFrame([("f", "p0", 0), ("f", "p1", 1)], "function string, symbol string, position int")
    rets = spark.createDataFrame([("f", "y")], "function string, symbol string")
    assert [(r.function, r.position) for r in taint.return_dependencies(flows, params, rets, 4).collect()] == [("f", 0)]


def test_value_used_before_its_error_is_checked(spark):
    lines = ["v, err := load()", "v.Close()", "if err != nil {", "w, err := load()", "if err != nil {", "w.Close()"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id int, n int, line string")
    assert [(r.n, r.symbol) for r in nil_dereference(df).collect()] == [(0, "v")]


WIDE = "id string, kind string, operation string, file string, function string, start_line int, start_column int, inputs array<string>, outputs array<string>, arguments array<string>, argument_inputs array<array<string>>, metadata map<string,string>"


def fact(i, kind, fn, line, ins=(), outs=(), op="", file="f", args=None, by=None, meta=None):
    return (i, kind, op, file, fn, line, 1, list(ins), list(outs), args, by, meta)


def run(spark, rows, functions=(), **kw):
    fn = spark.createDataFrame([(f[0], f[1], list(f[2]), f[3]) for f in functions], "file string, name string, parameters array<string>, start_line int")
    found = taint.traces(spark.createDataFrame(rows, WIDE), fn, **kw).collect()
    return {(r.source_id, r.sink_id, r.interprocedural, tuple(r.path)) for r in found}


def test_taint_passes_into_callees_and_back(spark):
    src, sink = fact("ab01", "source", "m", 1, outs=["id"]), fact("cd02", "sink", "g", 15, ["p"])
    g = ("f", "g", ["p"], 10)
    call = lambda **kw: fact("c", "call", "m", 2, ["id"], op="pkg.g", **kw)
    want = {("ab01", "cd02", True, ())}
    assert run(spark, [src, sink, call(by=[["id"]])], [g]) == want
    assert run(spark, [src, sink, call(by=[["id"]])], [g], max_depth=0) == set()
    assert run(spark, [src, sink, call(args=["lit", " id "])], [("f", "g", ["q", "p"], 10)]) == want  # positions from the arguments' text
    assert run(spark, [src, sink, call(by=[[], ["id"]])], [("f", "g", ["q", "p"], 10)]) == set()  # stops at the first argument without symbols
    assert run(spark, [src, sink, call(by=[["id"]], meta={"external_import": "true"})], [g]) == set()
    assert run(spark, [src, sink, call(by=[["id"]])], [g, ("h", "g", ["p"], 1), ("f", "g", ["p"], 40)]) == set()  # ambiguous
    other = fact("cd02", "sink", "g", 15, ["p"], file="h")
    assert run(spark, [src, other, call(by=[["id"]])], [("h", "g", ["p"], 10)]) == want  # unique in another file


def test_calls_return_taint_only_through_parameters_that_reach_a_return(spark):
    src = fact("s", "source", "m", 1, outs=["a"])
    body = [fact("r1", "propagation", "same", 11, ["v"], ["w"]), fact("r2", "return", "same", 12, ["w"])]
    hop = lambda i, line, a, b: fact(i, "propagation", "m", line, [a], [b], op="same", by=[[a]])
    fns = [("f", "same", ["v"], 10), ("f", "m", [], 1)]
    one = [src, *body, hop("p1", 2, "a", "b"), fact("k", "sink", "m", 3, ["b"])]
    assert run(spark, one, fns) == {("s", "k", True, ("p1",))}
    two = [src, *body, hop("p1", 2, "a", "b"), hop("p2", 3, "b", "c"), fact("k", "sink", "m", 4, ["c"])]
    assert run(spark, two, fns, max_depth=1) == set() and run(spark, two, fns, max_depth=2) == {("s", "k", True, ("p1", "p2"))}
    drops = [src, fact("r2", "return", "same", 12, ["w"]), hop("p1", 2, "a", "b"), fact("k", "sink", "m", 3, ["b"])]
    assert run(spark, drops, fns) == set()
    assert run(spark, [src, hop("p1", 2, "a", "b"), fact("k", "sink", "m", 3, ["b"])]) == {("s", "k", False, ("p1",))}  # a name outside the tree is a local step


def test_conditional_kills_several_inputs_files_and_limits(spark):
    src = fact("s", "source", "m", 1, outs=["a"])
    assert run(spark, [src, fact("q", "propagation", "m", 2, [], ["a"], meta={"conditional": "true"}), fact("k", "sink", "m", 3, ["a"])]) == {("s", "k", False, ())}
    assert run(spark, [src, fact("p", "propagation", "m", 2, ["clean", "a"], ["b", "c"]), fact("k", "sink", "m", 3, ["x", "c"])]) == {("s", "k", False, ("p",))}
    assert run(spark, [src, fact("k", "sink", "m", 3, ["a"], file="other")]) == set()
    assert run(spark, [src, fact("p", "propagation", "m", 2, ["a"], ["b"]), fact("q", "propagation", "m", 3, ["b"], ["c"]), fact("k", "sink", "m", 4, ["c"])], max_steps=1) == set()
    assert run(spark, [src, fact(None, "sink", "m", 3, [None]), fact("k", None, None, None)]) == set()


def test_grades(spark):
    df = spark.createDataFrame([(1, 2, 0, False), (1, 3, 2, False), (1, 4, 1, True)], "source_id int, sink_id int, steps int, interprocedural boolean")
    assert [(r.confidence, r.strength) for r in taint.graded(df).orderBy("sink_id").collect()] == [(0.95, "strong"), (0.9, "strong"), (0.8, "moderate")]
