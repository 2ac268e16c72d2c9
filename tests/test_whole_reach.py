from __future__ import annotations

from quarry.plans import core_facts


def test_all_functions_have_their_callers_and_reach(spark, tmp_path):
    """Thirty functions are called; the starts of the chains, which nobody calls, reach something too."""
    chains = [[f"a{i}", f"b{i}", f"c{i}"] for i in range(15)]
    spark.createDataFrame([(str(i), c) for i, c in enumerate(chains)], "id string, call_chain array<string>").coalesce(1).write.parquet(f"{tmp_path}/findings.parquet")
    called = {(r.node, r.caller) for r in core_facts.q2_called_by(spark, str(tmp_path)).collect()}
    assert called == {(f"b{i}", f"a{i}") for i in range(15)} | {(f"c{i}", f"b{i}") for i in range(15)}
    reach = {(r.start, r.node, r.distance) for r in core_facts.q1_reach(spark, str(tmp_path)).collect()}
    assert reach == {x for i in range(15) for x in ((f"a{i}", f"b{i}", 1), (f"a{i}", f"c{i}", 2), (f"b{i}", f"c{i}", 1))}
