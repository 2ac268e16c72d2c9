from __future__ import annotations

import random

from quarry.llm.topn import local_bounds, top_n

SCHEMA = "g string, s double, id string, _part int, _bound string, place string"
ORDER = [("s", True), ("id", False)]


def brute(rows, n):
    groups = {}
    for g, s, i in {(r[0], r[1], r[2]) for r in rows}:
        groups.setdefault(g, []).append((s, i))
    out = set()
    for g, xs in groups.items():
        xs.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or ""))
        out |= {(g, k + 1, i) for k, (_, i) in enumerate(xs[:n])}
    return out


def test_against_brute_force_with_a_hot_group_ties_nulls_and_repeats(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else rng.choice([None, "a", "b", *map(str, range(200))])
        rows.append((g, rng.choice([None, 0.0, 0.5, 1.0]), f"{rng.randrange(900):04}", i, "x", "y"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r.g, r.place_, r.id) for r in top_n(df, ["g"], ORDER, 3, place="place_").collect()}
    assert got == brute(rows, 3)


def test_small_groups_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1.0, "x", 0, "", "")], SCHEMA)
    assert [(r.g, r.place) for r in top_n(df, ["g"], ORDER, 3).collect()] == [("a", 1)]
    assert top_n(df.limit(0), ["g"], ORDER, 3).count() == 0


def test_the_scan_is_pruned_and_cut_before_the_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(str(i % 5), float(i), str(i), i, "wide" * 20, "") for i in range(1000)], SCHEMA)
    df.write.parquet(str(tmp_path / "t"))
    plan = top_n(spark.read.parquet(str(tmp_path / "t")), ["g"], ORDER, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    scans = plan[plan.index("Physical Plan") :].split("ReadSchema:")[1:]
    assert scans and all("_bound" not in x.split("\n")[0] for x in scans)


def test_bounds_beyond_the_broadcast_change_nothing(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abcdefgh"), rng.choice([None, 0.0, float("inf"), 1.0]), f"{rng.randrange(300):03}", i, "", "") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for bounds in (1, 3, 100):
        assert {(r.g, r.place, r.id) for r in top_n(df.drop("place"), ["g"], ORDER, 4, bounds=bounds).collect()} == brute(rows, 4)


def test_nan_is_greatest_and_bounds_hold(spark):
    rows = [("a", float("nan"), "n", 0, "", "")] + [("a", float(i), str(i), 0, "", "") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert [r.id for r in top_n(df.drop("place"), ["g"], ORDER, 2).orderBy("place").collect()] == ["n", "8"]
    assert [r.id for r in local_bounds(df.select("g", "s", "id"), ["g"], ORDER, 2).collect()] == ["7"]


def test_the_result_composes(spark):
    df = spark.createDataFrame([(str(i % 3), float(i), str(i), i, "", "") for i in range(30)], SCHEMA).drop("place")
    out = top_n(df, ["g"], ORDER, 2).select("g", "place", "id")
    again = spark.createDataFrame(out.collect(), out.schema)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0 and out.join(again, ["g", "place"], "left_anti").count() == 0
