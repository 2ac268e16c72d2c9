from __future__ import annotations

import pytest

from quarry.llm.endings import ending
from quarry.llm.p8 import cut_texts

FULL = "The scan reads every file. The report lists each finding with its place."


@pytest.mark.parametrize(
    "text",
    [FULL, FULL + "\n\n```go\nx := 1\n```", FULL + "\n\n| GO-SEC-335 | 623 |", FULL + "\n\n(closed as duplicate of #706)", "Why does it stop?", 'He said "done."', FULL + "  \n\n"],
)
def test_complete(text):
    assert ending(text)[0] == "complete"


@pytest.mark.parametrize(
    "text",
    ["The scan reads every file in the tree and then the rep", FULL + " The trace goes from the source to the [...]", FULL + " Then it...", FULL + "\n\n```go\nx := 1\nif y", FULL + " It names the owner,", "Nothing between the two calls stops the so <snip>", "The ingest team confir&am", "author: Between two checkp�", FULL + " It fires on roster/stage_fixture."],
)
def test_cut(text):
    assert ending(text)[0] == "cut"


def test_nothing_to_judge():
    assert ending("") is None and ending("  \n ") is None


def test_open_ends_are_settled_by_the_corpus(spark):
    long = "Static evidence shows one opaque cache and no sink."
    texts = {
        1: FULL + "\n\nLGTM", 2: long + "\n\nLGTM", 3: FULL + "\n\nStatus: CONFIRMED", 4: long + "\n\nStatus: CONFIRMED",
        5: FULL + "\n\nStatic evidence", 6: long + "\n\nStatic evidence", 7: long,
        8: FULL + "\n\n- Pinning the edge", 9: FULL + "\n\n- Static evi", 10: None, 11: "", 12: FULL + "\n\nWe shall see...", 13: long + "\n\nWe shall see...", 14: FULL + "\n\nFixed in v1.2.3", 15: long + "\n\nFixed in v10.0.1",
        16: FULL, 17: FULL + "\n\nMore text follows.", 18: "x" * 300_000 + " and then the", 19: "Only once here",
    }
    df = spark.createDataFrame([(k, v, "d") for k, v in texts.items()], "doc_id bigint, text string, unit string")
    assert {r.doc_id for r in cut_texts(df, "doc_id", "text").collect()} == {5, 6, 9, 18, 19}
    assert cut_texts(df.limit(0), "doc_id", "text").count() == 0


def test_prefixes_of_any_length_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from quarry.llm.p8 import longer_copies

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 40, 130]))) for _ in range(300)] + ["The " + "x" * 110, "The " + "x" * 111, None]
    texts += [t[: rng.randrange(len(t) + 1)] for t in texts if t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    goes_on = ~(F.col("s_end").rlike("[0-9]") & F.col("t_next").rlike("[0-9]"))
    got = {r.s for r in longer_copies(df.select(F.col("t").alias("s")), df, goes_on).collect()}
    known = [t for t in texts if t]
    want = {s for s in known if any(len(t) > len(s) and t.startswith(s) and not (s[-1].isdigit() and t[len(s)].isdigit()) for t in known)}
    assert got == want and "The " + "x" * 110 in got


def test_a_long_last_line_meets_its_longer_copy(spark):
    from quarry.llm.p8 import cut_texts

    line = "supercalifragilisticexpialidocious" * 3 + "abcdefgh"
    rows = [(1, f"One. Two.\n{line}"), (2, f"Three. Four.\n{line}"), (3, f"Five.\n{line}and more of it"), (4, None), (5, "")]
    got = {r[0] for r in cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert {1, 2} <= got and not got & {4, 5}
