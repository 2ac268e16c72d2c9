from __future__ import annotations

import json

import pytest

from quarry.extract.facts import semantic_facts, symbols
from quarry.extract.events import read
from quarry.operators import context, decisions, graph


def test_answers_are_decoded_strictly():
    one = {"id": "a", "evidence_relation": "SUPPORTS"}
    assert decisions.decode("```json\n[" + json.dumps(one) + ",]\n```", ["a"]) == [one]
    assert decisions.decode(json.dumps({"assessments": [{"id": "b"}, one]}), ["a", "b"]) == [one, {"id": "b"}]
    assert decisions.decode(json.dumps(one), ["a"]) == [one]
    for text, ids in (("", ["a"]), ("```xml\n[]\n```", ["a"]), ("```", ["a"]), (json.dumps(one), ["a", "b"]), (json.dumps([one, one]), ["a", "b"]), (json.dumps([{"id": ""}]), ["a"]), ("[] []", []), ("nothing", ["a"]), (json.dumps([{"id": "z"}]), ["a"])):
        with pytest.raises(ValueError):
            decisions.decode(text, ids)


def test_answers_become_bounded_decisions(spark):
    cand = spark.createDataFrame([(x, "High", 0.8) for x in "abcdefghij"], "id string, severity string, confidence double")
    say = lambda i, rel, st=None, sev=None, conf=None, reason="r", ids=("e1",): {k: v for k, v in {"id": i, "evidence_relation": rel, "claim_strength": st, "severity": sev, "confidence": conf, "reason": reason, "evidence_ids": list(ids)}.items() if v is not None}
    reply = [
        say("a", " supports", "UNCHANGED", "high", 0.8), say("b", "SUPPORTS", "LOWER", "Low", 0.5), say("c", "SUPPORTS", "UNCHANGED", "Low", 0.8), say("d", "SUPPORTS", "LOWER", "Critical", 0.9), say("e", "CONTRADICTS"),
        say("f", "INSUFFICIENT", ids=("e1", "made-up")), say("g", "CONTRADICTS", ids=("made-up",)), say("h", "CONTRADICTS", sev="Low"), say("i", "SUPPORTS", "UNCHANGED", "High", 1.5), say("j", "SUPPORTS", "LOWER", "Low", 0.1, " "),
    ]
    rows = [(1, json.dumps(reply), list("abcdefghij")), (2, "broken", ["z"]), (3, None, ["y"])]
    got = decisions.answers(spark.createDataFrame(rows, "g int, text string, asked array<string>"), "g", "text", "asked")
    assert {(r.id, r.broken is None) for r in got.filter("g > 1").collect()} == {("z", False), ("y", False)}
    offered = spark.createDataFrame([(x, ["e1", "e2"]) for x in "abcdefghij"], "id string, offered array<string>")
    out = {r.finding_id: (r.status, r.severity, r.confidence, r.malformed is None) for r in decisions.decide(cand, got, offered).collect()}
    assert out == {
        "a": ("CONFIRMED", "High", 0.8, True), "b": ("DOWNGRADED", "Low", 0.5, True), "c": ("UNCERTAIN", "High", 0.8, False), "d": ("UNCERTAIN", "High", 0.8, False), "e": ("UNSUPPORTED", "High", 0.0, True),
        "f": ("UNCERTAIN", "High", 0.0, True), "g": ("UNCERTAIN", "High", 0.8, False), "h": ("UNCERTAIN", "High", 0.8, False), "i": ("UNCERTAIN", "High", 0.8, False), "j": ("UNCERTAIN", "High", 0.8, False),
    }


def test_cache_keeps_the_last_valid_answer(spark):
    c = spark.createDataFrame([("k", "old", True, 1), ("k", "bad", False, 3), ("m", "x", False, 1)], "key string, answer string, valid boolean, stored_at int")
    n = spark.createDataFrame([("k", "new", True, 2), (None, "n", True, 2)], "key string, answer string, valid boolean, stored_at int")
    kept = decisions.store(c.filter("valid"), n)
    assert [(r.key, r.answer) for r in kept.collect()] == [("k", "new")]
    q = spark.createDataFrame([("k",), ("m",)], "key string")
    assert {r.key: r.answer for r in decisions.cached(q, c).collect()} == {"k": "old", "m": None}


SRC = 'package a\n\nimport "net/http"\n\n// h handles a request.\nfunc h(r *http.Request, db *sql.DB) {\n\tid := r.FormValue("id")\n\tq := "select " + id\n\tdb.Exec(q) // nolint\n}\n\nvar Limit = 3\n'


def packet(spark, limits=None, steps=()):
    files = spark.createDataFrame([(1, "/r/a.go", "Go", SRC)], "file_id bigint, path string, language string, content string")
    facts = semantic_facts(files)
    kind = "array<struct<kind:string,file:string,line:int,column:int,expression:string,message:string,related_symbol:string>>"
    found = spark.createDataFrame([("x", "R", "/r/a.go", 9, 9, [tuple(s) for s in steps], ["q", "h"]), ("gone", "R", "/r/b.go", 9, 9, [], []), ("null", "R", None, None, None, None, None)], f"finding_id string, rule_id string, file string, start_line int, end_line int, steps {kind}, symbols array<string>")
    fn = facts.filter("kind = 'function'").selectExpr("file", "operation name", "start_line", "end_line")
    ids = {r.operation: r.id for r in facts.filter("kind in ('source', 'propagation')").collect()}
    sink = facts.filter("kind = 'call' and operation = 'db.Exec'").first().id
    traces = spark.createDataFrame([(ids["http.query"], sink, [ids["assignment"]])], "source_id string, sink_id string, path array<string>")
    rel = spark.createDataFrame([("/r/a.go", "h", "n", 1, "caller", "Function", 1, 2)], "file string, fn string, node string, rank int, name string, kind string, start_line int, end_line int")
    nodes = spark.createDataFrame([("/r/a.go", "h", "Function", 6, 10)], "file string, name string, kind string, start_line int, end_line int")
    eco = spark.createDataFrame([("/r/a.go", "net/http")], "file string, ecosystem string")
    items = context.evidence(found, files.select("path", "content").withColumnRenamed("path", "file"), facts, fn, traces, rel, rel.limit(0), nodes, eco, limits)
    return {r.finding_id: r for r in context.packets(found, items, limits).collect()}


def test_packets_hold_all_kinds_of_evidence(spark):
    got = packet(spark)
    assert got["gone"].sufficiency == got["null"].sufficiency == "INSUFFICIENT" and got["gone"].items == 0
    x = got["x"]
    by = {}
    for e in x.evidence:
        by.setdefault(e.kind, []).append(e)
    assert x.sufficiency == "SUFFICIENT" and not x.truncated and x.items == len(x.evidence)
    assert by["primary"][0].content == "\tdb.Exec(q) // nolint" and by["enclosing"][0].symbol == "h" and by["enclosing"][0].content.startswith("func h")
    assert [e.content for e in by["provenance"][:3]] == ['dataflow source: r.FormValue("id")', 'dataflow propagation: q := "select " + id', "dataflow sink: db.Exec(q)"]
    assert by["caller"][0].content == "Function caller" and by["ecosystem"][0].content == "net/http" and by["symbol"][-1].content == "Function definition"
    assert [e.content for e in by["comment"]] == ["db.Exec(q) // nolint"]
    assert len({e.id for e in x.evidence}) == x.items


def test_packets_give_up_the_least_first(spark):
    few = packet(spark, {"items": 4})["x"]
    assert few.truncated and few.items == 4 and few.evidence[0].kind == "primary" and few.sufficiency == "INSUFFICIENT"
    missing = packet(spark, steps=[("hypothesis_evidence_missing", "", 0, 0, "", "none", "")])["x"]
    assert missing.sufficiency == "INSUFFICIENT"


def test_graph_of_declarations(spark):
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    nodes, edges = graph.build(
        df([("a",), (None,)], "file string"), df([("a", "run", "", 1, 2), ("a", "run", "(t *T)", 3, 4), ("a", "T", None, 5, 6)], "file string, name string, receiver string, start_line int, end_line int"),
        df([("a", "T", 7, 8)], "file string, name string, start_line int, end_line int"), df([("a", "x/y", "y"), ("a", "os", "os"), ("a", "z", "")], "file string, path string, alias string"), df([("a", "v", "Variable"), ("a", "f", "Function")], "file string, name string, kind string"),
    )
    assert {(r.id, r.kind, r.name) for r in nodes.collect()} == {("a", "File", "a"), ("a:run", "Function", "run"), ("a:T.run", "Method", "run"), ("a:T", "Type", "T"), ("import:a:x/y", "Import", "y:x/y"), ("import:a:os", "Import", "os"), ("import:a:z", "Import", "z"), ("Variable:a:v", "Variable", "v")}
    assert edges.count() == 8 and edges.filter("kind = 'Imports'").count() == 3
    s = graph.stats(nodes, edges).first()
    assert (s.nodes, s.edges, s.functions, s.types, s.files) == (8, 8, 2, 1, 1)
    names = df([("k", "run"), ("k", "T"), ("k", "none")], "key string, name string")
    assert [r.id for r in graph.find_symbols(nodes, names, 2).orderBy("rank").collect()] == ["a:run", "a:T.run"]
    e = df([("a", "b"), ("a", "c"), ("b", "d"), ("d", "e")], "src string, dst string")
    assert [(r.node, r.rank) for r in graph.relations(e, df([("a",)], "start string"), 2, 2).orderBy("rank").collect()] == [("b", 1), ("c", 2)]


def test_symbols_of_each_language():
    got = lambda lang, text: [(k, n) for k, n, _ in symbols(read(lang, text))]
    assert got("Go", "package a\n\nvar x, y = 1, 2\n\nconst (\n\tA = 1\n\tB\n)\n") == [("Package", "a"), ("Variable", "x"), ("Constant", "A"), ("Constant", "B")]
    assert got("Python", "x = 1\ndef f():\n    y = 2\n") == [("Variable", "x")]
    assert got("Rust", "const A: u8 = 1;\nfn f() { let z = 2; }\n") == [("Constant", "A"), ("Variable", "z")]
    assert got("C#", "class A { public int P { get; set; } void F() { var q = 1; q = 2; } }") == [("Variable", "P"), ("Variable", "q")]
