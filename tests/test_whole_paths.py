from __future__ import annotations

from quarry.plans import core_facts


def brute_paths(edges, src, dst, most):
    out, todo = set(), [(src,)]
    while todo:
        path = todo.pop()
        for b in sorted({b for a, b in edges if a == path[-1]} - set(path)):
            if b == dst:
                out.add((*path, b))
            elif len(path) + 1 < most:
                todo.append((*path, b))
    return out


def test_every_pair_and_paths_of_up_to_eleven_nodes(spark, tmp_path):
    """Sixty pairs, and one chain each of eleven and of twelve nodes; a shorter way skips one node of each."""
    chains = [[f"s{i}", f"m{i}", f"t{i}"] for i in range(60)]
    chains += [[f"x{i}" for i in range(11)], [f"y{i}" for i in range(12)], ["x3", "x5"], ["y3", "y5"]]
    rows = [(str(i), 7, c) for i, c in enumerate(chains)]
    spark.createDataFrame(rows, "id string, scan_id bigint, call_chain array<string>").coalesce(1).write.parquet(f"{tmp_path}/findings.parquet")
    edges = {e for c in chains for e in zip(c, c[1:], strict=False)}
    want = {(c[0], c[-1], ">".join(p)) for c in chains if len(c) > 2 for p in brute_paths(edges, c[0], c[-1], 11)}
    got = {(r.src, r.dst, r.path) for r in core_facts.q4_paths(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 60 + 2 + 1
