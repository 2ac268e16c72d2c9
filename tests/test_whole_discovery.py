from __future__ import annotations

from quarry.plans import core_files


def test_only_files_over_500_kib_are_too_large(spark, tmp_path):
    limit = 500 * 1024
    rows = [
        (1, 7, "a/small.go", 3000), (2, 7, "a/middle.go", 3001), (3, 7, "a/at_limit.go", limit), (4, 7, "a/large.go", limit + 1),
        (5, 7, "a/blob.unknown", 4000), (6, 7, "a/large_test.go", limit + 1), (7, 7, "vendor/large.go", limit + 1), (8, 7, "a/none.go", None),
    ]
    content = "package a\n"
    spark.createDataFrame([(*r, content) for r in rows], "file_id bigint, repo_id bigint, rel_path string, size bigint, content string").write.parquet(f"{tmp_path}/files.parquet")
    got = {r.file_id: r.skip_reason for r in core_files.s2_skip_reasons(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "size", 5: "unclassified", 6: "test", 7: "pruned", 8: None}
    s = core_files.s9_discovery_stats(spark, str(tmp_path)).collect()[0]
    assert (s.repo_id, s.total, s.skipped, s.by_size, s.by_ignore, s.by_test) == (7, 4, 3, 1, 0, 1)
