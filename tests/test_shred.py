from __future__ import annotations

import json
import random

import pytest

from quarry.operators.shred import MAP_WIDTH, _parse, folded, layout, read_json, schema_graph, shred

STEP = ("runs", "results", "steps")


def frame(spark, bodies, parts=1):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id bigint, body string").repartition(parts)


def graph_of(spark, bodies, parts=1):
    df = frame(spark, bodies, parts)
    return df, folded(schema_graph(df, "body"))


def test_readable_bodies_only():
    assert read_json('﻿{"a": 1}') == {"a": 1}
    assert read_json(json.dumps(json.dumps({"a": 1}))) == {"a": 1}
    assert read_json('{"a": 1') is None and read_json("") is None and read_json(None) is None and read_json("{} x") is None
    assert read_json("[" * 100_000) is None


def test_the_parser_of_any_depth_agrees_with_the_usual_one():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        return [1.5, "a\n\"é", None, True, -3][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 5 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}

    for _ in range(300):
        text = json.dumps(value(4), indent=rng.choice([None, 1]))
        assert _parse(text) == json.loads(text)
        for _ in range(10):
            i = rng.randrange(len(text))
            bad = text[:i] + rng.choice(["", ",", "}", "]", "{", '"', ":", "0"]) + text[i + 1 :]
            try:
                want = json.loads(bad)
            except ValueError:
                with pytest.raises(ValueError):
                    _parse(bad)
            else:
                assert _parse(bad) == want


def test_bodies_of_any_depth_are_read(spark):
    deep = '{"runs": [{"id": "r", "x": ' + "[" * 50_000 + "]" * 50_000 + ', "a": ' + '{"b": ' * 30_000 + "1" + "}" * 30_000 + "}]}"
    df, graph = graph_of(spark, [deep])
    rows = shred(df, "id", "body", layout(graph, repeated=[("runs",)]), {("runs",): [("id",), ("x",)]}, levels=0).collect()
    assert [(r.path, r.members["id"], len(r.members["x"])) for r in rows] == [("runs/0", "r", 100_000)]


def test_repeated_shared_and_recursive_elements_get_tables(spark):
    df, graph = graph_of(spark, ['{"runs": [{"tool": {"name": "t", "meta": {"v": 1}}, "results": [{"meta": {"v": 2}, "child": {"child": {"x": 1}}}]}]}'])
    lay = layout(graph)
    why = {"/".join(p): w for p, w in lay.tabled.items() if p}
    assert why == {"runs": "repeated", "runs/results": "repeated", "runs/tool/meta": "shared", "runs/results/meta": "shared", "runs/results/child": "recursive"}
    assert ("tool", "name") in lay.columns[("runs",)]
    rows = {(r.path, r.parent, r.level, tuple(sorted(r.members.items()))) for r in shred(df, "id", "body", lay).collect()}
    assert rows == {
        ("", "", 0, ()),
        ("runs/0", "", 0, (("tool/name", "t"),)),
        ("runs/0/tool/meta", "runs/0", 0, (("v", "1"),)),
        ("runs/0/results/0", "runs/0", 0, ()),
        ("runs/0/results/0/meta", "runs/0/results/0", 0, (("v", "2"),)),
        ("runs/0/results/0/child", "runs/0/results/0", 0, ()),
        ("runs/0/results/0/child/child", "runs/0/results/0/child", 1, (("x", "1"),)),
    }


def test_a_member_that_becomes_shared_changes_the_tables(spark):
    one = '{"runs": [{"id": "a", "place": {"uri": "x"}}]}'
    tables = {}
    for name, bodies in (("one", [one]), ("two", [one, '{"runs": [{"step": {"place": {"uri": "y"}}}]}'])):
        df, graph = graph_of(spark, bodies)
        lay = layout(graph)
        tables[name] = {(r.path, tuple(sorted(r.members.items()))) for r in shred(df.filter("id = 0"), "id", "body", lay).collect() if r.path}
        label = shred(df.filter("id = 0"), "id", "body", lay, {("runs",): [("place", "uri")]}).collect()
        assert [(r.path, r.members) for r in label] == [("runs/0", {"place/uri": "x"})]  # read through the key where it has a table
    assert tables["one"] == {("runs/0", (("id", "a"), ("place/uri", "x")))}
    assert tables["two"] == {("runs/0", (("id", "a"),)), ("runs/0/place", (("uri", "x"),))}
    assert lay.home(("runs",), ("place", "uri")) == (("runs", "place"), ("uri",))


def test_rows_keep_links_positions_and_lone_objects(spark):
    bodies = [
        json.dumps({"runs": {"results": [None, {"id": "a", "steps": {"n": 1}}, 5, {"id": None, "steps": [{"n": "x"}, None, {"n": {"k": [1]}}]}]}, "other": {"results": [{"id": "no"}]}}),
        '{"runs": [',
        None,
        "",
        "null",
    ]
    df, graph = graph_of(spark, bodies)
    lay = layout(graph, repeated=[("runs",), ("runs", "results"), STEP])
    rows = shred(df, "id", "body", lay, {("runs",): [], ("runs", "results"): [("id",)], STEP: [("n",)]}).collect()
    got = {(r.id, r.element, r.path, r.parent, tuple(r.members.values())) for r in rows}
    assert got == {
        (0, "runs", "runs/0", "", ()),
        (0, "results", "runs/0/results/1", "runs/0", ("a",)),
        (0, "results", "runs/0/results/3", "runs/0", ()),
        (0, "steps", "runs/0/results/1/steps/0", "runs/0/results/1", ("1",)),
        (0, "steps", "runs/0/results/3/steps/0", "runs/0/results/3", ("x",)),
        (0, "steps", "runs/0/results/3/steps/2", "runs/0/results/3", ('{"k": [1]}',)),
    }


def test_maps_keyed_by_data_fold_alike_in_any_split(spark):
    bodies = [json.dumps({"runs": [{"bag": {f"k{i * 10 + j}": {"v": i, f"w{i}": {"z": 1}} for j in range(10)}}]}) for i in range(300)]
    graphs = [graph_of(spark, bodies, parts)[1] for parts in (1, 20)]
    assert graphs[0] == graphs[1] and len(graphs[0]) < MAP_WIDTH
    assert graphs[0][("runs", "bag", "*")][1] == 3000
    df = frame(spark, bodies, 20)
    assert folded(schema_graph(df, "body"), most=700) == graphs[0]  # folded by Spark first
    with pytest.raises(ValueError):
        folded(schema_graph(df, "body"), most=5)
    rows = shred(df.filter("id = 7"), "id", "body", layout(graphs[0])).collect()
    assert {r.path for r in rows if r.node == '["runs", "bag", "*"]'} == {f"runs/0/bag/k{70 + j}" for j in range(10)}


def test_lone_surrogates_pass(spark):
    df, graph = graph_of(spark, ['{"runs": [{"n": "\\ud800", "\\ud801": {"a": 1}}]}'])
    assert [r.members["n"] for r in shred(df, "id", "body", layout(graph), {("runs",): [("n",)]}).collect()] == ["?"]


def test_empty_table_and_unknown_paths(spark):
    df, graph = graph_of(spark, [None])
    lay = layout(graph, repeated=[("runs",)])
    assert shred(df.limit(0), "id", "body", lay, {("runs",): []}).count() == 0
    with pytest.raises(ValueError):
        shred(df, "id", "body", lay, {("nowhere",): []})
