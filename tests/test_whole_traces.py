from __future__ import annotations

from datetime import datetime, timedelta

from quarry.operators import taint
from quarry.plans import core_facts

READS = [5, 1, 2, 3, 9]  # numbers in props that make a propagation read v0 .. v4


def chain(user, first, steps):
    """Events of one function: a source, so many propagations and a sink, each reading what the one before wrote."""
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    rows = [(first, at(0), user, "signup", "{}")]
    rows += [(first + i, at(i), user, "click", f'{{"k": {READS[(i - 1) % 5]}}}') for i in range(1, steps + 1)]
    return [*rows, (first + steps + 1, at(steps + 1), user, "error", f'{{"k": {READS[steps % 5]}}}')]


def test_long_chains_of_events_are_followed(spark, tmp_path):
    """The five symbols recur, and a write with an input leaves an older taint, so the fewest steps are at most two."""
    rows = chain(1, 100, 1) + chain(2, 200, 6) + chain(3, 300, 16) + chain(4, 400, 17)
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: core_facts.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.source_id, r.sink_id, r.steps) for r in run("d1_traces")} == {(100, 102, 1), (200, 207, 1), (300, 317, 1), (400, 418, 2)}


def test_traces_of_up_to_sixteen_steps_are_followed(spark):
    rows = []
    for fn, n in (("a", 1), ("b", 6), ("c", 16), ("d", 17)):
        rows.append((f"{fn}s", "source", "f", fn, 1, None, "v0"))
        rows += [(f"{fn}{i}", "propagation", "f", fn, 1 + i, f"v{i - 1}", f"v{i}") for i in range(1, n + 1)]
        rows.append((f"{fn}k", "sink", "f", fn, 2 + n, f"v{n}", None))
    df = spark.createDataFrame(rows, "id string, kind string, file string, function string, line int, input string, output string")
    got = {(r.source_id, r.sink_id): r.path for r in taint.traces(df).collect()}
    assert set(got) == {("as", "ak"), ("bs", "bk"), ("cs", "ck")} and got["cs", "ck"] == [f"c{i}" for i in range(1, 17)]
