"""Operator 6, benchmark decontamination: BM25 inverted index with block-max WAND.

The test items are indexed: per word a postings list in item order, with the
BM25 contribution of the word to the item, cut into blocks that know their
largest contribution. Contributions are divided by the item's score for its own
words, so a score is the share of the item that a passage holds, and one
threshold suits items of all lengths. Every document is cut into overlapping
passages such that any stretch as long as the longest item lies whole in one.
Every passage is a query; block-max WAND walks its words' postings and returns
all items at or above the threshold. Before the walk, one bound is taken for
all passages of a document at once: an item can only reach the threshold
with some of its own rarer words, so a passage without enough of those is done
(the share its common words can give at most is below the threshold).

A hit counts if the item's question and its answer are both in the passage: of
each, at least ``OVERLAP`` of its n-grams. An item has one text; its last third
of words counts as the answer. Grams have ``NGRAM`` words, fewer in parts so
short that one changed word would break more than the overlap leaves over.

Items are broadcast in shards of at most ``SHARD`` items; each shard sees all
documents, which are never shuffled. Only hits leave the tasks. Numbers of
items, of items with a word, the average and the greatest length are counted over all
shards, so what is a hit does not depend on how items are dealt.

Defined results: null and empty items and texts match nothing; an item with a
null id and a text is searched like any other; items of equal id and text count once; a repeated document gives its hits again; an empty
table gives an empty result; only the ids and the texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import with_computed, with_rank
from ravenhunt.session import scratch_table

THRESHOLD, OVERLAP, NGRAM = 0.6, 0.6, 5
K1, B, POSTINGS_BLOCK, SHARD = 1.2, 0.75, 16, 20_000
words_of = re.compile(r"\w+").findall


class Index:
    """BM25 index of (item_id, words) with block maxima."""

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float, stats: tuple[int, float, int, dict[str, int]] | None = None):
        """``stats``: number of items, their average and greatest length and the
        words' item counts over all shards (none: these items are all)."""
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.threshold = threshold
        sizes = [len(w) for w in self.words]
        n, average, self.longest, df = stats or (len(items), sum(sizes) / max(1, len(items)), max(sizes, default=0), Counter(w for ws in self.words for w in set(ws)))
        self.postings: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            tf = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / average)
            part = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(part.values())
            for w, x in part.items():
                lists[w].append((i, x / own))
        for w, posts in lists.items():
            item, share = np.array([p[0] for p in posts]), np.array([p[1] for p in posts])
            self.postings[w] = item.tolist(), share.tolist(), [float(share[k : k + POSTINGS_BLOCK].max()) for k in range(0, len(share), POSTINGS_BLOCK)]
        self.top = {w: max(p[2]) for w, p in self.postings.items()}
        self._essential(df, lists)

    def _essential(self, df: Counter, lists: dict) -> None:
        """Per item, its most frequent words whose shares stay below the
        threshold can't make a hit alone; the others are essential, and a hit
        needs at least the rest of the threshold from them."""
        self.need = np.zeros(len(self.ids))
        share = {(w, i): x for w, posts in lists.items() for i, x in posts}
        essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            left = 0.0
            for w in sorted(set(ws), key=lambda w: (-df[w], w)):
                if left + share[w, i] < self.threshold * 0.75:
                    left += share[w, i]
                else:
                    essential[w].append((i, share[w, i]))
            self.need[i] = self.threshold - left - 1e-9
        self.word_id = {w: k for k, w in enumerate(essential)}
        self.start = np.r_[0, np.cumsum([len(essential[w]) for w in self.word_id])].astype(np.int64)
        flat = [p for w in self.word_id for p in essential[w]]
        self.item, self.share = np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat], float)

    def passages(self, words: list[str], stride: int) -> list[int]:
        """Which passages (of two strides) may reach the threshold."""
        get = self.word_id.get
        at = np.array([k for k, w in enumerate(words) if w in self.word_id], np.int64)
        if not len(at):
            return []
        word = np.array([get(words[k]) for k in at], np.int64)
        many = self.start[word + 1] - self.start[word]
        post = np.repeat(self.start[word] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        block, word = np.repeat(at // stride, many), np.repeat(word, many)
        # passage p is the blocks p and p + 1; each word counts once in it
        p = np.r_[block, block - 1]
        hit = np.unique(np.c_[p, np.r_[word, word], np.r_[post, post]], axis=0)
        pair, where = np.unique(hit[:, 0] * len(self.ids) + self.item[hit[:, 2]], return_inverse=True)
        enough = np.bincount(where.ravel(), self.share[hit[:, 2]]) >= self.need[pair % len(self.ids)]
        return sorted({max(0, int(x)) for x in (pair // len(self.ids))[enough]})

    def search(self, words: set[str]) -> list[tuple[int, float]]:
        """All (item, share) at or above the threshold, by block-max WAND."""
        out, bar = [], self.threshold - 1e-9
        lists = [(*self.postings[w], self.top[w]) for w in sorted(words & self.postings.keys())]
        at = [0] * len(lists)
        while True:
            live = sorted((lists[t][0][at[t]], t) for t in range(len(lists)) if at[t] < len(lists[t][0]))
            bound, pivot = 0.0, None
            for k, (item, t) in enumerate(live):
                bound += lists[t][3]
                if bound >= bar:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            front = [t for _, t in live[: pivot + 1]]
            # the blocks that would hold this item
            block_bound, reach = 0.0, len(self.ids)
            for t in front:
                posts, _, tops, _ = lists[t]
                b = self._block(posts, at[t], item)
                if b < len(tops):
                    block_bound += tops[b]
                    end = (b + 1) * POSTINGS_BLOCK
                    reach = min(reach, posts[end - 1] + 1 if end <= len(posts) else len(self.ids))
            if block_bound >= bar:
                if live[0][0] == item:
                    score = 0.0
                    for t in front:
                        score += lists[t][1][at[t]]
                        at[t] += 1
                    if score >= bar:
                        out.append((item, score))
                    continue
                goal = item
            else:  # no item up to the nearest block end can pass
                after = live[pivot + 1][0] if pivot + 1 < len(live) else len(self.ids)
                goal = max(item + 1, min(reach, after))
            for t in front:
                at[t] = self._seek(lists[t][0], at[t], goal)

    @staticmethod
    def _seek(posts: list[int], at: int, item: int) -> int:
        from bisect import bisect_left

        return bisect_left(posts, item, at)

    @staticmethod
    def _block(posts: list[int], at: int, item: int) -> int:
        b = at // POSTINGS_BLOCK
        while (b + 1) * POSTINGS_BLOCK <= len(posts) and posts[(b + 1) * POSTINGS_BLOCK - 1] < item:
            b += 1
        return b

    def overlaps(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams that the passage has."""
        words = self.words[item]
        cut = len(words) - max(1, len(words) // 3)

        def share(part: list[str]) -> float:
            if not part:
                return 1.0
            n = max(1, min(NGRAM, 2 * (len(part) + 1) // 7))  # one changed word breaks at most n of len(part) + 1 - n
            grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
            return len(grams & {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}) / len(grams)

        return share(words[:cut]), share(words[cut:])

    def hits(self, text: str, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """The best verified hit of each item: (item id, passage's first word, share, question, answer)."""
        words = words_of(text.lower())
        stride = max(1, self.longest)
        best: dict[int, tuple] = {}
        for p in self.passages(words, stride):
            passage = words[p * stride : (p + 2) * stride]
            for item, score in self.search(set(passage)):
                question, answer = self.overlaps(item, passage)
                if question >= overlap and answer >= overlap:
                    hit = (score, question + answer, -p)
                    if item not in best or hit > best[item][0]:
                        best[item] = hit, (self.ids[item], p * stride, score, question, answer)
        return [x for _, (_, x) in sorted(best.items())]


HITS = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """One row per document and test item it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.unionByName, [docs.mapInArrow(_searcher(index, overlap), HITS) for index in _indexes(items, threshold, shard)])


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no test item; nothing is shuffled."""
    columns = docs.columns
    for index in _indexes(items, threshold, shard):
        def compute(texts: pa.Array, index=index) -> dict[str, pa.Array]:
            return {"hit": pa.array([t.is_valid and bool(index.value.hits(t.as_py(), overlap)) for t in texts], pa.bool_())}

        docs = with_computed(docs, compute, "hit boolean").filter("not hit").select("_row.*")
    return docs.select(*columns)


def _indexes(items: DataFrame, threshold: float, shard: int) -> list:
    """Broadcast indexes of at most ``shard`` items each."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text is not null").distinct()
    items = scratch_table(with_rank(items, [], ["item_id", "text"], "rank"), "items")
    counts = scratch_table(_word_counts(items), "item-words")
    whole = counts.filter("word is null").first()
    n, average, longest = (whole["items"], whole["words"] / whole["items"], whole["longest"]) if whole and whole["items"] else (0, 1.0, 0)
    out = []
    for s in range(max(1, -(-items.count() // shard))):
        rows = items.filter((F.col("rank") >= s * shard) & (F.col("rank") < (s + 1) * shard)).orderBy("item_id", "text").collect()  # at most `shard`
        words = [(r["item_id"], words_of(r["text"].lower())) for r in rows]
        here = spark.createDataFrame([(w,) for w in sorted({w for _, ws in words for w in ws})], "word string")
        df = {r["word"]: r["items"] for r in counts.join(F.broadcast(here), "word").collect()}  # a shard's words
        out.append(spark.sparkContext.broadcast(Index([(i, w) for i, w in words if w], threshold, (n, average, longest, df))))
    return out


def _word_counts(items: DataFrame) -> DataFrame:
    """(word, items, words, longest): number of items with each word; for the null
    word the number of all items that have words, of their words, and of the longest's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [w for w in (words_of(t.as_py().lower()) for t in batch.column("text")) if w]
            df: dict = dict(Counter(w for ws in held for w in set(ws)))
            df[None] = len(held)
            total, longest = ([f(map(len, held)) if w is None and held else 0 for w in df] for f in (sum, max))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((list(df), pa.string()), (list(df.values()), pa.int64()), (total, pa.int64()), (longest, pa.int64()))], names=["word", "items", "words", "longest"])

    found = items.select("text").mapInArrow(run, "word string, items long, words long, longest long")
    return found.groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _searcher(shared, overlap: float):
    names = [x.split()[0] for x in HITS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(doc, *hit) for doc, text in zip(ids, batch.column("text"), strict=True) if text.is_valid for hit in index.hits(text.as_py(), overlap)]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run
