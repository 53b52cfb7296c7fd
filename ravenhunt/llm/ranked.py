"""Operator 11, ranked lexical search, reversed.

The items are the index and the documents are the queries: an inverted index
over the items' terms is broadcast, every document's term counts stream through
it, and each item keeps a heap of its ``k`` best documents, which is all that a
task hands on. Heaps are merged in two rounds (by task group, then by item).

One pass over the texts writes each document's counts of the items' terms to
the shared folder. Numbers of documents, of terms and of documents holding a
term are sums over that table; they are the same whatever the index's size.

Items go into blocks by the bytes of their texts, at most ``BLOCK`` bytes each
(more only for one item that is larger), so that what is broadcast is bounded;
each block streams the documents once.

Scores are whole 64-bit numbers:
``sum(weight * ((1e9 * tf) div (1000 * tf + 12 * m)))``, with
``m = 75 + (25 * n * N) div L`` and
``weight = floor(1000 * ln((2N + 2) / (2df + 1)))``.

Defined results: a null or empty text has no terms and is found by no item;
a null item text finds nothing; repeated items (equal rows or ids, or a null
id) are each searched and returned; repeated documents are each ranked, equal
scores by doc_id, a null doc_id last; empty tables give an empty result; only
doc_id, text and item_id are read. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravenhunt.session import scratch_table

BLOCK = 16 << 20
MERGE_GROUPS = 64
STEP = 1 << 19  # postings, or scores, that a step works on at once (more for one document that meets more)
NO_ID = (1 << 63) - 1  # stands for a null doc_id in ties: last
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms, in order: runs of ASCII letters and digits and of all
    symbols beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class Index:
    """Inverted index of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.rows = [row for row, _ in items]
        counts = [Counter(terms(text)) for _, text in items]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        by_term: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for item, found in enumerate(counts):
            for t, n in found.items():
                by_term[self.number[t]].append((item, n))
        self.start = np.cumsum([0, *map(len, by_term)])
        self.item = np.array([i for found in by_term for i, _ in found], np.int64)
        self.times = np.array([n for found in by_term for _, n in found], np.int64)

    def weighted(self, df: dict[int, int], documents: int) -> np.ndarray:
        """What each posting multiplies a document's share by."""
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.number))]
        return self.times * np.repeat(np.array(w, np.int64), np.diff(self.start))


def term_counts(docs: DataFrame, number) -> DataFrame:
    """(doc_id, n, term, tf): each document's terms, and which of the index's
    terms it has how often. ``number`` is the broadcast dictionary of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            size, term, tf, at = [], [], [], [0]
            for text in batch.column("text"):
                found = terms(text.as_py())
                size.append(len(found))
                for t, k in Counter(found).items():
                    i = known.get(t)
                    if i is not None:
                        term.append(i)
                        tf.append(k)
                at.append(len(term))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))],
                names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def documents_with(counts: DataFrame, width: int) -> dict[int, int]:
    """Number of documents that hold each term, summed by the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("term").flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["t", "df"])

    found = counts.select("term").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return {r["t"]: r["df"] for r in found.collect()}  # at most a block's terms


class Heaps:
    """The k best (score, document) of each item; the least one on top."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # scores from which a document may enter

    def offer(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """``scores``: documents x items."""
        for d, item in zip(*np.nonzero(scores >= self.least), strict=True):
            entry, heap = (int(scores[d, item]), -int(doc_ids[d])), self.held[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def shares(counts: DataFrame, index, k: int, documents: int, total: int) -> DataFrame:
    """(task, item, score, doc_id): the heaps of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, item, weight, items = index.value
        heaps = Heaps(items, k)
        size = np.diff(start)
        for batch in batches:
            lists = batch.column("term")
            term, tf, at = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy(), lists.offsets.to_numpy()
            at = at - at[0]
            m = np.array([75 + (25 * n * documents) // total for n in batch.column("n").to_pylist()], np.int64)
            share = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(at)))
            doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            met = np.r_[0, np.cumsum(size[term])][at] + items * np.arange(len(at))  # postings and scores before each document
            lo = 0
            while lo < len(m):
                hi = max(lo + 1, int(np.searchsorted(met, met[lo] + STEP, "right")) - 1)
                here = slice(at[lo], at[hi])
                n = size[term[here]]
                posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[term[here]], n)
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                scores = np.zeros((hi - lo) * items, np.int64)
                np.add.at(scores, np.repeat(doc, n) * items + item[posting], weight[posting] * np.repeat(share[here], n))
                heaps.offer(scores.reshape(-1, items), doc_ids[lo:hi])
                lo = hi
        rows = [(i, score, -doc) for i, heap in enumerate(heaps.held) for score, doc in heap]
        cols = zip(*rows, strict=True) if rows else [()] * 3
        item_of, score, doc_id = (pa.array(c, pa.int64()) for c in cols)
        task = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([task, item_of, score, doc_id], names=["task", "item", "score", "doc_id"])

    return counts.mapInArrow(run, "task long, item long, score long, doc_id long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank; first within groups of tasks."""
    best = [F.desc("score"), F.asc("doc_id")]
    groups = heaps.withColumn("_g", F.pmod("task", F.lit(MERGE_GROUPS)))
    groups = groups.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_g").orderBy(*best))).filter(F.col("_r") <= k)
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.select("item", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text)
    for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    items = scratch_table(items.withColumn("row", F.monotonically_increasing_id()), "items")
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    blocks = min(rows, -(-size // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks))))
    out = None
    for b in range(blocks):
        held = items.filter(F.col("block") == b).orderBy("row").collect()  # about `block` bytes
        if not held:
            continue
        index = Index([(r["row"], r["text"]) for r in held])
        counts = scratch_table(term_counts(docs, spark.sparkContext.broadcast(index.number)), "term-counts")
        documents, total = counts.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = index.weighted(documents_with(counts, len(index.number)), documents)
        shared = spark.sparkContext.broadcast((index.start, index.item, weight, len(index.rows)))
        best = merged(shares(counts.filter("n > 0"), shared, k, documents, total), k)
        rows = spark.createDataFrame(list(enumerate(index.rows)), "item long, row long")  # a block's items
        best = best.join(rows, "item").select("row", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    return out.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
