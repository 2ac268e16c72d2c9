from __future__ import annotations

import random

import pytest

from quarry.llm.p7 import _carried, leaks
from quarry.llm.winnow import longest_carry

ITEM = [f"term{i}" for i in range(40)]


def replaced(*at):
    return " ".join("other" if i in at else w for i, w in enumerate(ITEM))


@pytest.mark.parametrize("sent", [5000, 0])
def test_a_passage_after_a_gap_on_its_diagonal_is_found(spark, sent):
    texts = [
        replaced(8, 9, 10),  # words 0-7, three others, words 11-39
        replaced(8, 12),  # two replaced words three apart, then a clean passage
        replaced(8, 9, 10, 19, 20, 29, 30),  # no run of 16 words
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item_id bigint, text string")
    assert {r.doc_id for r in leaks(docs, "doc_id", "text", items, "item_id", "text", sent=sent).collect()} == {0, 1}


def test_passing_over_hits_loses_nothing():
    rng = random.Random(3)
    seen = set()
    for _ in range(400):
        item = [f"w{rng.randrange(30)}".encode() for _ in range(40)]
        doc = [b"x" if rng.random() < 0.12 else w for w in item]
        ends = list(range(1, len(item) + 1))
        hits = [(p, q) for p in range(len(doc)) for q in range(len(item)) if doc[p : p + 5] == item[q : q + 5] and len(doc[p : p + 5]) == 5]
        want = any(longest_carry(doc, item, ends, p, q) >= 16 for p, q in hits)
        assert _carried(doc, item, ends, hits, 16) == want
        seen.add(want)
    assert seen == {True, False}


def test_long_stretches_are_read_to_their_start():
    item = [f"w{i}".encode() for i in range(900)]
    doc = [b"x" if i == 60 else w for i, w in enumerate(item)]
    assert longest_carry(doc, item, list(range(1, 901)), 890, 890) == 899


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_many_items_in_one_document(spark, sent):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(300)]
    docs = spark.createDataFrame([(1, " . ".join(t for _, t in items)), (2, items[7][1]), (3, None)], "doc_id bigint, text string")
    got = leaks(docs, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text", sent=sent)
    assert {(r[0], r[1]) for r in got.collect()} == {(1, i) for i in range(300)} | {(2, 7)}
