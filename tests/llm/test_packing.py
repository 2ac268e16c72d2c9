from __future__ import annotations

import random

from quarry.llm.p6 import best_fit_decreasing, pack, token_counts


def brute(sizes, cap):
    rooms, out = [], []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            r, i = min(fit)
            rooms[i] -= s
        else:
            i = len(rooms)
            rooms.append(cap - s)
        out.append(rooms[i])
    return len(rooms), out


def test_tightest_packet_as_by_trying_all():
    rng = random.Random(3)
    for cap in (1, 7, 64, 100):
        sizes = sorted((rng.randint(1, cap) for _ in range(300)), reverse=True)
        bins = best_fit_decreasing(sizes, cap)
        rooms, trace = {}, []
        for s, b in zip(sizes, bins, strict=True):
            rooms[b] = rooms.get(b, cap) - s
            trace.append(rooms[b])
        assert min(rooms.values()) >= 0
        assert (len(rooms), trace) == brute(sizes, cap)


def test_items_are_laid_whole_and_only_oversize_ones_split(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 5, 30, 64, 64, 65, 200, 0, None, -3]), "x") for i in range(500)]
    items = spark.createDataFrame(rows, "doc bigint, size bigint, packet string")
    limits = spark.createDataFrame([("s", 64), ("l", 1000), ("bad", None), ("zero", 0), ("s", 64)], "profile string, cap int")
    out = pack(items, "doc", "size", limits, "profile", "cap", shard_packets=10).collect()
    for name, cap in (("s", 64), ("l", 1000)):
        own = [r for r in out if r.profile == name]
        fill = {}
        for r in own:
            fill[r.packet] = fill.get(r.packet, 0) + r.tokens
        assert max(fill.values()) <= cap
        for d, size, _ in rows:
            parts = sorted((r.start, r.tokens) for r in own if r.doc == d)
            if not size or size < 0:
                assert parts == []
            elif size <= cap:
                assert parts == [(0, size)]
            else:
                assert len(parts) == -(-size // cap) and sum(t for _, t in parts) == size
                assert all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:]))
        total = sum(fill.values())
        assert len(fill) <= -(-total // cap) * 1.1 + 6
    assert {r.profile for r in out} == {"s", "l"}
    assert pack(items.limit(0), "doc", "size", limits, "profile", "cap").count() == 0
    assert pack(items, "doc", "size", limits.limit(0), "profile", "cap").count() == 0


def test_token_counts_are_those_of_the_vocabulary(spark):
    import base64

    import tiktoken
    from quarry.llm.p6 import _PATTERN
    from quarry.llm.words import TOKENIZER_DIR

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb"))}
    enc = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world", "<|endoftext|>", "żółw 漢字\n\n\t x", "a" * 5000, "", None]
    got = {r.id: r.tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}


def test_many_shards_fill_as_one(spark):
    rng = random.Random(8)
    rows = [(i, int(min(3000, rng.lognormvariate(4, 1.2))) + 1) for i in range(40_000)]
    items = spark.createDataFrame(rows, "doc bigint, size bigint")
    limits = spark.createDataFrame([("l", 1024)], "profile string, cap int")
    total = sum(n for _, n in rows)
    fill = []
    for packets in (10**9, 600):
        out = pack(items, "doc", "size", limits, "profile", "cap", shard_packets=packets)
        fill.append(total / 1024 / out.select("packet").distinct().count())
    assert total > 4 * 600 * 1024 and fill[1] >= fill[0] - 0.002
