"""Problem 6: texts laid whole into packets of fixed capacity, sized in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.words import TOKENIZER_DIR
from quarry.session import materialize
from quarry.tables import table

#: Packets of the greatest capacity that one task fills at least: the one or two it leaves half empty cost 0.2 % of the room at most.
SHARD_PACKETS = 600
#: Items that one task holds at most, however small they are.
SHARD_ITEMS = 2_000_000
# Fixed value: how the vocabulary's tokenizer parts a text before it merges bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, tokens) of every text that is neither null nor empty; special tokens' strings are ordinary text."""
    path, kind = f"{folder}/byte_bpe_50k.tiktoken", df.schema[key].dataType.simpleString()
    vocabulary = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # one file of 50,256 entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else None for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "tokens"])

    return df.select(key, text).mapInArrow(count, f"`{key}` {kind}, tokens bigint").filter("tokens is not null")


class Tightest:
    """Open packets by what they can still take; finds the one that fits most tightly in logarithmic time.

    A segment tree over the remaining capacities 0..capacity counts the packets
    below each node.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, packet: int, room: int) -> None:
        self.bins[room].append(packet)
        at, tree = self.leaves + room, self.tree
        while at:
            tree[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The packet with the least room that is at least `size`, and its room; it is removed."""
        at, tree = self.leaves + size, self.tree
        if not tree[at]:
            while True:  # up until a right neighbour holds a packet
                if at & 1 == 0 and tree[at + 1]:
                    at += 1
                    break
                at >>= 1
                if at <= 1:
                    return None
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        packet = self.bins[room].pop()
        while at:
            tree[at] -= 1
            at >>= 1
        return packet, room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Packet of each item; items come in decreasing order and none exceeds the capacity."""
    tree, out, packets = Tightest(capacity), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            packet, room = packets, capacity
            packets += 1
        else:
            packet, room = found
        out.append(packet)
        if room > size:
            tree.put(packet, room - size)
    return out


def pack(items: DataFrame, key: str, size: str, limits: DataFrame, profile: str, capacity: str, shard_packets: int = SHARD_PACKETS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(profile, packet, key, piece, start, tokens): every item laid into packets of each capacity.

    An item that alone exceeds the capacity is split into full pieces and a
    rest, 0-based; all others stay whole as piece 0. Items are dealt by hash of
    their key to shards, each packed by best fit decreasing, so no task grows
    with the data: as many shards as keep at least `shard_packets` packets of
    the greatest capacity in each, more only where a shard would hold above
    `shard_items` items. The items are summed first, so they should come from a
    written table. Items of null, zero or negative
    size and null or non-positive capacities give no row; a repeated key is laid
    as often as it comes.
    """
    caps = limits.select(F.col(profile).alias("profile"), F.col(capacity).cast("bigint").alias("capacity")).filter("capacity > 0").distinct()
    rows = [(r.profile, r.capacity) for r in caps.collect()]  # one row a profile
    count, total = items.filter(F.col(size) > 0).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(size).cast("bigint")), F.lit(0))).first()
    shards = max(1, total // (shard_packets * max((c for _, c in rows), default=1)), -(-count // shard_items))
    dealt = items.filter(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))
    kind = items.schema[key].dataType.simpleString()
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in rows])) if rows else None
    if each is None:
        return dealt.select(F.lit(None).cast("string").alias("profile"), F.lit(None).cast("bigint").alias("packet"), F.col("key").alias(key), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("size").alias("tokens")).limit(0)

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        cap, shard, name = int(group["capacity"].iat[0]), int(group["shard"].iat[0]), group["profile"].iat[0]
        whole, pieces = group["size"] // cap, group["size"] % cap
        out = [group[["key"]].assign(piece=whole, start=whole * cap, tokens=pieces)[pieces > 0]]
        big = group[whole > 0]
        if len(big):
            full = big.loc[big.index.repeat(whole[big.index])][["key"]]
            part = full.groupby(level=0).cumcount()
            out.append(full.assign(piece=part, start=part * cap, tokens=cap))
        laid = pd.concat(out).sort_values(["tokens", "key", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        laid["packet"] = [b * shards + shard for b in best_fit_decreasing(laid["tokens"].tolist(), cap)]
        return laid.assign(profile=name)[["profile", "packet", "key", "piece", "start", "tokens"]]

    spread = dealt.withColumn("_l", each).select("key", "size", "shard", "_l.profile", "_l.capacity")
    laid = spread.groupBy("profile", "shard").applyInPandas(lay, f"profile string, packet bigint, key {kind}, piece bigint, start bigint, tokens bigint")
    return laid.withColumnRenamed("key", key)


def p6_packets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = materialize(token_counts(docs, "doc_id", "text"), "sizes")
    return pack(sizes, "doc_id", "tokens", table(spark, folder, "packet_limits"), "profile", "max_approx_tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Packets, tokens and share of the room used, for each profile."""
    limits = table(spark, folder, "packet_limits").select("profile", F.col("max_approx_tokens").cast("bigint").alias("capacity")).distinct()
    laid = p6_packets(spark, folder).groupBy("profile").agg(F.count_distinct("packet").alias("packets"), F.sum("tokens").alias("tokens"))
    return laid.join(limits, "profile").select("profile", "capacity", "packets", "tokens", F.round(F.col("tokens") / (F.col("packets") * F.col("capacity")), 6).alias("fill"))
