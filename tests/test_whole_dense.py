from __future__ import annotations

import random
import time

import pytest

from quarry.operators import graph
from quarry.plans import core_facts


def brute_reach(edges, depth):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for start in after:
        seen, front = {start}, {start}
        for d in range(1, depth + 1):
            front = {y for x in front for y in after.get(x, ())} - seen
            seen |= front
            out |= {(start, y, d) for y in front}
    return out


def shuffled(spark):
    """Bytes of shuffle written so far in this session."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.5)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_reach_of_a_dense_graph_shuffles_no_walks(spark, tmp_path):
    """700 functions of 40 calls each: 28,000 edges, 489,300 pairs and 45 million walks of three calls."""
    rng = random.Random(7)
    edges = {(f"f{a}", f"f{b}") for a in range(700) for b in rng.sample(range(700), 40)}
    rows = [(str(i), list(e)) for i, e in enumerate(sorted(edges))]
    spark.createDataFrame(rows, "id string, call_chain array<string>").coalesce(4).write.parquet(f"{tmp_path}/findings.parquet")
    before = shuffled(spark)
    got = [(r.start, r.node, r.distance) for r in core_facts.q1_reach(spark, str(tmp_path)).collect()]
    assert shuffled(spark) - before < 4e6
    assert len(got) == len(set(got)) and set(got) == brute_reach(edges, 3)


@pytest.mark.parametrize(("nodes", "calls", "depth"), [(150, 900, 1), (150, 900, 3), (150, 400, 9), (90, 3000, 2)])
def test_bits_and_joins_reach_the_same(spark, monkeypatch, nodes, calls, depth):
    """Loops, nodes without calls, repeated and null edges; groups of 64 starts, the last one not full."""
    rng = random.Random(nodes + calls)
    edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes + 30)}") for _ in range(calls)] + [("n1", "n1")]
    df = spark.createDataFrame([*edges, *edges[:50], ("n2", None), (None, "n3")], "src string, dst string")
    want = brute_reach(edges, depth)
    for walks in (0.0, 1e18):
        monkeypatch.setattr(graph, "_walks", lambda *_, w=walks: w)
        got = [(r.start, r.node, r.distance) for r in graph.reach_dense(df, depth).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_walks_are_counted_and_groups_bounded(spark):
    whole = spark.createDataFrame([(0, "a", [1, 2]), (1, "b", [2]), (2, "c", [0]), (3, "d", [])], "id bigint, node string, next array<bigint>")
    assert [graph._walks(whole, d) for d in (1, 2, 3)] == [4, 4 + 5, 4 + 5 + 7]
    assert graph._groups(100, 50, 3, 8) == 1 and graph._groups(3517, 3517, 3, 6) == 12
    n = 100_000
    groups = graph._groups(n, n, 3, 6)
    assert groups > 12 and -(-n // groups) * n * 5 <= graph.BITS
    assert graph.reach_dense(spark.createDataFrame([], "src string, dst string"), 3).collect() == []
