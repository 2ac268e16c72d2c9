from __future__ import annotations

import random

import numpy as np

from quarry.llm.p7 import leaks, own_wording
from quarry.llm.winnow import K, WINDOW, Codes, grams, winnow, words


def test_every_shared_run_of_seven_words_shares_a_fingerprint():
    rng = random.Random(1)
    codes = Codes()
    prints = lambda ws: {int(h[i]) for h in [grams(np.array([codes[w] for w in ws], np.uint64))] for i in winnow(h)}
    for _ in range(300):
        run = [f"w{rng.randrange(50)}".encode() for _ in range(K + WINDOW - 1)]
        a = [f"a{rng.randrange(50)}".encode() for _ in range(rng.randrange(20))] + run + [b"x"] * rng.randrange(20)
        b = [b"y"] * rng.randrange(20) + run + [f"b{rng.randrange(50)}".encode() for _ in range(rng.randrange(20))]
        assert prints(a) & prints(b)


def test_words_pass_over_case_marks_and_spaces():
    assert words("The  *Quick*\n> brown_fox—jumps, SOFT­EN") == [b"the", b"quick", b"brown", b"fox", b"jumps", b"soften"]


ITEM = "Read the excerpt carefully. " + " ".join(f"term{i}" for i in range(40)) + "."


def check(spark, texts, sent=5000, items=None):
    items = items or [(1, ITEM), (2, "Read the excerpt carefully. " + " ".join(f"other{i}" for i in range(40))), (3, "Read the excerpt carefully. short one"), (4, None), (1, ITEM)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    own = own_wording(spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    return {(r[0], r[1]) for r in leaks(docs, "doc_id", "text", own, "item_id", "wording", sent=sent).collect()}


def test_passages_and_what_is_none(spark):
    t = [f"term{i}" for i in range(40)]
    lost = t[:10] + t[11:20] + ["new"] + t[21:30]
    shuffled = t[::2] + t[1::2]
    texts = [
        "before " + " ".join(t[5:21]) + " after",
        "\n".join("> " + w.upper() + "," for w in t[3:25]),
        " ".join(lost),
        " ".join(t[:15]),
        " ".join(shuffled),
        "Read the excerpt carefully. " * 8,
        " ".join(w if i % 5 else "zz" for i, w in enumerate(t)),
        None,
        "",
        "filler " * 50_000 + " ".join(t[:16]),
    ]
    want = {(0, 1), (1, 1), (2, 1), (9, 1)}
    assert check(spark, texts) == want
    assert check(spark, texts, sent=1) == want


def test_empty_sides(spark):
    assert check(spark, [None]) == set()
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs, "doc_id", "text", own_wording(items, "item_id", "text"), "item_id", "wording").count() == 0


def test_items_of_one_wording_keep_it(spark):
    rows = [(i, f"Own start {i}. Rest {i}.") for i in range(5)]
    got = {r.item_id: r.wording for r in own_wording(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text").collect()}
    assert got == {i: t for i, t in rows}


def test_any_number_of_shared_opening_sentences_is_left_out(spark):
    rows = [(i, f"Read this. Then think. Choose well. Answer once. Own start {i}. Rest {i}.") for i in range(5)] + [(9, "Read this. Alone.")]
    got = {r.item_id: r.wording for r in own_wording(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text").collect()}
    assert got == {i: f"Own start {i}. Rest {i}." for i in range(5)} | {9: "Alone."}
