"""Problem 7: documents that carry passages of evaluation items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.winnow import Codes, _run, grams, longest_carry, winnow, words
from quarry.tables import table

#: Words of an item's own wording that make a case.
LEAST = 16
#: Most bytes of item texts that are sent to every worker; their words and fingerprints take some twenty times as much there.
SENT_BYTES = 4 << 20
#: Items that a document meets in one row beyond that.
ITEMS_A_ROW = 256
#: Items that must share an opening sentence for it to be an instruction.
SHARED = 3


def own_wording(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, wording): the text without the opening sentences that at least `SHARED` items have alike, however many they are.

    An opening is known by the chained hash of its sentences, so an item of n
    sentences gives n - 1 short rows; its last sentence is always its own. Null
    texts give no row, of a repeated key one text counts.
    """
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.?!])\s+"), lambda s: s != "")
    items = df.filter(F.col(text).isNotNull()).select(F.col(key), sentences.alias("_s")).dropDuplicates([key])
    chain = F.aggregate(
        F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))),
        F.array().cast("array<bigint>"),
        lambda a, s: F.concat(a, F.array(F.xxhash64(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")), F.lower(s)))),
    )
    openings = items.select(key, F.posexplode(chain).alias("_n", "_o"))
    many = openings.groupBy("_o").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= SHARED).select("_o")
    shared = openings.join(many, "_o").groupBy(key).agg((F.max("_n") + 1).alias("_own"))
    out = items.join(shared, key, "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    return out.select(key, F.array_join(F.slice("_s", F.col("_own") + 1, F.greatest(F.size("_s"), F.lit(1))), " ").alias("wording"))


def _item_words(text: str) -> tuple[list[bytes], list[int]]:
    """Words, and for each the end of the blank-separated word it belongs to."""
    out: list[bytes] = []
    ends: list[int] = []
    for chunk in text.split():
        own = words(chunk)
        out += own
        ends += [len(out)] * len(own)
    return out, ends


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, sent: int = SENT_BYTES) -> DataFrame:
    """(doc_key, item_key): the document carries at least `least` words of the item in their order, in one stretch.

    Case, punctuation, spacing and markup do not count; single words may be lost
    or replaced at distances of eight words or more. Null and empty texts and
    items of fewer than `least` words give no row; each pair comes once.

    Items of up to `sent` bytes, summed first, are sent to the workers with their
    fingerprints; beyond that the fingerprints of both sides meet in a shuffled
    join, and a document meets the items it shares one with.
    """
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length(item_text) + 16), F.lit(0))).first()[0]
    if bytes_ <= sent:
        return _sent(docs, doc_key, doc_text, items, item_key, item_text, least).distinct()
    return _shuffled(docs, doc_key, doc_text, items, item_key, item_text, least)


def _carried(doc: list[bytes], item: list[bytes], ends: list[int], hits: list[tuple[int, int]], least: int) -> bool:
    """Whether any hit extends to `least` words. hits: by p, then q.

    All hits inside one common run extend to the same stretch, so each run of a
    diagonal is judged once, and a later run of the same diagonal by itself.
    """
    done: dict[int, int] = {}  # diagonal -> end of its run judged last
    for p, q in hits:
        if p < done.get(p - q, 0):
            continue
        done[p - q] = p + _run(doc, item, p, q)
        if longest_carry(doc, item, ends, p, q) >= least:
            return True
    return False


def _sent(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int) -> DataFrame:
    known = [(r[0], *_item_words(r[1])) for r in items.select(item_key, item_text).collect() if r[1]]
    known = [x for x in known if len(x[1]) >= least]
    codes = Codes()
    prints: list[tuple[int, int, int]] = []
    for i, (_, own, _) in enumerate(known):
        h = grams(np.array([codes[w] for w in own], np.uint64))
        prints += [(int(h[q]), i, int(q)) for q in winnow(h)]
    prints.sort()
    sent = docs.sparkSession.sparkContext.broadcast((known, prints))
    doc_type, item_type = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    id_type = pa.string() if item_type == "string" else pa.int64() if item_type == "bigint" else pa.int32()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prints = sent.value
        own = np.array([h for h, _, _ in prints], np.uint64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(own & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        codes = Codes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            take, found = [], []
            at = 0
            while at < len(texts):
                split, starts, total = [], [], 0
                flat: list[bytes] = []
                first = at
                while at < len(texts) and total < 400_000:
                    ws = words(texts[at]) if texts[at] else []
                    split.append(ws)
                    starts.append(total)
                    flat += ws
                    flat.append(b"")
                    total += len(ws) + 1
                    at += 1
                codes[b""] = 0
                arr = np.fromiter(map(codes.__getitem__, flat), np.uint64, len(flat))
                h = grams(arr)
                at_print = winnow(h)
                hp = h[at_print]
                near = sieve[(hp & np.uint64((1 << 20) - 1)).astype(np.int64)]
                at_print, hp = at_print[near], hp[near]
                lo, hi = np.searchsorted(own, hp, "left"), np.searchsorted(own, hp, "right")
                begin = np.array(starts, np.int64)
                hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for j in np.flatnonzero(hi > lo):
                    pos = int(at_print[j])
                    d = int(np.searchsorted(begin, pos, "right")) - 1
                    for x in range(int(lo[j]), int(hi[j])):
                        hits[d, prints[x][1]].append((pos - starts[d], prints[x][2]))
                for (d, i), pairs in hits.items():
                    if _carried(split[d], known[i][1], known[i][2], pairs, least):
                        take.append(first + d)
                        found.append(known[i][0])
            if take:
                yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), pa.array(found, id_type)], names=[doc_key, item_key])

    return docs.select(doc_key, doc_text).mapInArrow(search, f"`{doc_key}` {doc_type}, `{item_key}` {item_type}")


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, pos): the winnowed fingerprints of each text."""
    kind = df.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                ws = words(t)
                h = grams(np.fromiter(map(codes.__getitem__, ws), np.uint64, len(ws)))
                at = winnow(h)
                if len(at):
                    ids = batch.column(0).take(pa.array(np.full(len(at), i, np.int64)))
                    yield pa.record_batch([ids, pa.array(h[at].view(np.int64)), pa.array(at.astype(np.int32))], names=[key, "print", "pos"])

    return df.select(key, text).mapInArrow(write, f"`{key}` {kind}, print bigint, pos int")


def _shuffled(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int) -> DataFrame:
    left = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_t"))
    right = items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("_w"))
    a = fingerprints(left, "_d", "_t").select("_d", "print").distinct()
    b = fingerprints(right, "_i", "_w").select("_i", "print").distinct()
    pairs = a.join(b, "print").select("_d", "_i").distinct()
    row = F.floor((F.row_number().over(Window.partitionBy("_d").orderBy("_i")) - 1) / ITEMS_A_ROW)
    met = pairs.withColumn("_row", row).join(right, "_i").groupBy("_d", "_row").agg(F.collect_list("_i").alias("_is"), F.collect_list("_w").alias("_ws"))
    both = met.join(left, "_d")  # a text travels once for each `ITEMS_A_ROW` items

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()

        def gram(ws: list[bytes]) -> np.ndarray:
            return grams(np.fromiter(map(codes.__getitem__, ws), np.uint64, len(ws)))

        for batch in batches:
            keep: list[int] = []
            found: list[object] = []
            for n, (t, ids, texts) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                doc = words(t)
                hd = gram(doc)
                at = [(int(hd[p]), int(p)) for p in winnow(hd)]
                for item_id, w in zip(ids, texts, strict=True):
                    item, ends = _item_words(w)
                    if len(item) < least:
                        continue
                    hi = gram(item)
                    where = defaultdict(list)
                    for q in winnow(hi):
                        where[int(hi[q])].append(int(q))
                    hits = [(p, q) for h, p in at for q in where.get(h, ())]
                    if _carried(doc, item, ends, hits, least):
                        keep.append(n)
                        found.append(item_id)
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(found, batch.column(2).type.value_type)], names=[doc_key, item_key])

    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    return both.select("_d", "_t", "_is", "_ws").mapInArrow(extend, f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    items = own_wording(table(spark, folder, "eval_items"), "item_id", "text")
    return leaks(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "wording")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with the number of documents that carry it."""
    items = table(spark, folder, "eval_items").select("item_id", "suite").dropDuplicates(["item_id"])
    found = p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))
