"""Operator 13, spelling variant grouping by a dictionary of trie-node pairs.

Words come from whole texts. Two words are near if one inserted, deleted or
replaced code point turns one into the other.

1. *Numbering*: the distinct words are sorted over range partitions. A node of
   their trie (a prefix) gets the number ``rank * width + depth``, ``rank``
   being that of the first word which has the prefix. A word shares its nodes
   with the word before it as far as both agree, so one pass over a sorted
   partition numbers them; a partition whose first words continue a prefix of
   the one before takes that one's numbers (one record per partition passes the
   driver). The reversed words, sorted the same way, number the suffixes.
2. *Dictionary*: a word of m code points gives a pair (prefix node, suffix
   node) for each of its m positions *skipped*, and for each of the m + 1
   places where one may be *inserted*. Words that share a pair and both skip
   there differ by one replacement; a word that skips there and one that is
   split there differ by one insertion. Of equal letters in a row only the last
   is skipped against a split, so that no two words meet twice.
3. *Groups*: a pair's words differ in one code point, so a group has at most as
   many words as there are letters, plus one. Sorted rows stream through numpy:
   each word gets its number of near words and the best one, never all pairs.
4. Forms are followed to their roots by pointer doubling; a form's count is at
   least ``RATIO`` times the word's, so chains are short.

Defined results: a null text has no words; a null doc_id counts as an empty
one in the check value; repeated rows count each; of near words with equal
counts the first in code-point order is the form; an empty table gives an empty
result; only doc_id and text are read. Nothing is capped: words may be of any
length (their nodes are numbers, so memory grows with the length, not with its
square).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import partitions
from ravenhunt.session import drop_scratch, scratch_table

MIN_LENGTH, MIN_COUNT, RATIO, DELETE_ONE_IN = 6, 5, 5, 199
HELD = 1 << 24  # bytes of words a task counts before it hands them on


def _runs(min_length: int):
    """Runs long enough to be words, in texts whose A-Z are lower-cased."""
    return re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, counts, held = _runs(min_length), Counter(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, k in Counter(findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DELETE_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    if word not in counts:
                        held += len(word) + 100
                    counts[word] += k
                if held > HELD:
                    yield flush()
                    counts, held = Counter(), 0
        if counts:
            yield flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    """How many code points ``a`` and ``b`` begin with in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def lists(values: list[list[int]]) -> pa.ListArray:
    at = np.fromiter(accumulate(map(len, values), initial=0), np.int32, len(values) + 1)
    flat = np.fromiter((x for v in values for x in v), np.int64, int(at[-1]))
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def trie_nodes(words: DataFrame, reverse: bool, width: int) -> DataFrame:
    """(word, n, rank, nodes): the nodes of each word's prefixes (``reverse``:
    suffixes) of 0, 1, ... code points, and the word's rank in that order."""
    spark = words.sparkSession
    keyed = words.select("word", "n", (F.reverse("word") if reverse else F.col("word")).alias("key"))
    keyed = keyed.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, firsts, pos = TaskContext.get().partitionId(), "", [], 0
        for batch in batches:
            out, start = [], pos
            for key in batch.column("key").to_pylist():
                same = shared_prefix(before, key)
                firsts = firsts[: same + 1] if pos else []
                firsts = firsts + [pos] * (len(key) + 1 - len(firsts))
                out.append(firsts)
                before, pos = key, pos + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(out), pa.int32()), pa.array(np.arange(start, pos)), *batch.columns, lists(out)], names=["part", "pos", "word", "n", "key", "firsts"])

    table = scratch_table(keyed.mapInArrow(local, "part int, pos long, word string, n long, key string, firsts array<long>"), "trie")
    ends = table.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"), F.max_by("firsts", "pos").alias("firsts"))
    carry: dict[int, tuple[int, list[int]]] = {}  # part -> (words before it, ranks of its first word's prefixes that the part before has)
    offset, last, ranks = 0, "", []
    for e in sorted(ends.collect(), key=lambda e: e["first"]):  # a record per partition
        shared = ranks[: shared_prefix(last, e["first"]) + 1]
        carry[e["part"]] = offset, shared
        ranks = [shared[d] if f == 0 and d < len(shared) else offset + f for d, f in enumerate(e["firsts"])]
        offset, last = offset + e["size"], e["last"]
    known = spark.sparkContext.broadcast(carry)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, pos = batch.column("part").to_numpy(), batch.column("pos").to_numpy()
            firsts = batch.column("firsts")
            at, flat = firsts.offsets.to_numpy(), firsts.values.to_numpy()[firsts.offsets[0].as_py() : firsts.offsets[-1].as_py()]
            at = at - at[0]
            size = np.diff(at)
            depth = np.arange(at[-1]) - np.repeat(at[:-1], size)
            rank = np.empty(len(flat), np.int64)
            own = np.empty(len(part), np.int64)
            for p in np.unique(part):
                start, shared = known.value[p]
                mine = np.repeat(part == p, size)
                f, d = flat[mine], depth[mine]
                ranks = f + start
                if shared:
                    old = (f == 0) & (d < len(shared))
                    ranks[old] = np.array(shared)[d[old]]
                rank[mine] = ranks
                own[part == p] = pos[part == p] + start
            nodes = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(rank * width + depth))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(own), nodes], names=["word", "n", "rank", "nodes"])

    return table.select("part", "pos", "word", "n", "firsts").mapInArrow(whole, "word string, n long, rank long, nodes array<long>")


SPLIT, SKIP, SKIP_LAST = range(3)  # a place for one more; a position left out; one whose next letter is another


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, w, n): the pairs of every word of ``words`` (word, n, rank, nodes,
    suffixes); w is the word's rank times 4 plus what happens at the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                pre, suf = batch.column("nodes").flatten().to_numpy(), batch.column("suffixes").flatten().to_numpy()
                size = np.array([len(w) for w in batch.column("word").to_pylist()], np.int64) + 1
                at = np.r_[0, np.cumsum(size)]
                letters = np.frombuffer("".join(w + "\0" for w in batch.column("word").to_pylist()).encode("utf-32-le"), "<u4")
                i = np.arange(at[-1]) - np.repeat(at[:-1], size)
                back = np.repeat(at[1:] - 1, size) - i  # where the suffix after i code points stands
                rank, n = (np.repeat(batch.column(c).to_numpy(), size) for c in ("rank", "n"))
                in_word = i < np.repeat(size, size) - 1
                kind = np.where(letters != np.r_[letters[1:], 0], SKIP_LAST, SKIP)
                p = np.r_[pre, pre[in_word]]
                s = np.r_[suf[back], suf[back[in_word] - 1]]
                w = np.r_[rank * 4 + SPLIT, (rank * 4 + kind)[in_word]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, s, w, np.r_[n, n[in_word]])], names=["p", "s", "w", "n"])

    return words.mapInArrow(run, "p long, s long, w long, n long")


def near_in_groups(p: np.ndarray, s: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(word, near words, best one's count, best one) of the words of whole
    groups; rows are sorted by p and s. A word may come more than once."""
    start = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]
    group = np.cumsum(start) - 1
    many = np.bincount(group)[group] > 1
    group, word, kind, n = group[many], w[many] >> 2, w[many] & 3, n[many]
    order = np.lexsort((word, -n, kind == SPLIT, group))  # in a group: those that skip, best first; then the split one
    group, word, kind, n = group[order], word[order], kind[order], n[order]
    total = int(group[-1]) + 1 if len(group) else 0
    skip, last = kind != SPLIT, kind == SKIP_LAST
    skips, lasts = np.bincount(group[skip], minlength=total), np.bincount(group[last], minlength=total)

    def first(which: np.ndarray) -> np.ndarray:
        """The first row of each group among ``which``, -1 without one."""
        out = np.full(total, -1)
        rows = np.flatnonzero(which)[::-1]
        out[group[rows]] = rows
        return out

    best, split, best_last = first(skip), first(~skip), first(last)
    rows = np.flatnonzero(skip)
    g = group[rows]
    top = np.where(best[g] == rows, np.where(skips[g] > 1, rows + 1, -1), best[g])  # the best other one that skips
    other = np.where(kind[rows] == SKIP_LAST, split[g], -1)
    near = skips[g] - 1 + (other >= 0)
    take = (other >= 0) & ((top < 0) | (n[other] > n[top]) | ((n[other] == n[top]) & (word[other] < word[top])))
    top = np.where(take, other, top)
    held, lone = near > 0, np.flatnonzero((split >= 0) & (lasts > 0))
    rows, near, top = np.r_[rows[held], split[lone]], np.r_[near[held], lasts[lone]], np.r_[top[held], best_last[lone]]
    return [word[rows], near, n[top], word[top]]


def near_words(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best_n, best) of every word that has a near word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            rows = [np.r_[a, c.to_numpy()] for a, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            end = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])  # the last group may go on
            held = [x[end:] for x in rows]
            if end:
                yield made([x[:end] for x in rows])
        if len(held[0]):
            yield made(held)

    def made(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in near_in_groups(*rows)], names=["rank", "near", "best_n", "best"])

    sorted_pairs = pairs.repartition(partitions(pairs.sparkSession), "p", "s").sortWithinPartitions("p", "s")
    found = sorted_pairs.mapInArrow(run, "rank long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("first"))).alias("top")
    found = found.groupBy("rank").agg(F.sum("near").alias("n_near"), best)
    return found.select("rank", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.first")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root): the end of each word's chain of ``forms`` (rank, form)."""
    to = scratch_table(forms.select("rank", F.col("form").alias("to")), "roots")
    while True:
        ahead = to.select(F.col("rank").alias("_r"), F.col("to").alias("_t"))
        longer = scratch_table(to.join(ahead, F.col("to") == F.col("_r"), "left").select("rank", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), "roots")
        drop_scratch(to)
        to = longer.select("rank", "to")
        to.scratch = longer.scratch
        if longer.filter("moved").isEmpty():
            return to.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = scratch_table(word_counts(docs, min_length, min_count), "words")
    width = (words.agg(F.max(F.length("word"))).first()[0] or 0) + 1
    forward = scratch_table(trie_nodes(words, False, width), "forward")
    suffixes = trie_nodes(words, True, width).select(F.col("word").alias("_w"), F.col("nodes").alias("suffixes"))
    both = forward.join(suffixes, F.col("word") == F.col("_w")).select("word", "n", "rank", "nodes", "suffixes")
    near = near_words(node_pairs(both))
    ranked = forward.select("rank", "word", "n")
    rows = ranked.join(near, "rank", "left").withColumn("form", F.when(F.col("best_n") >= F.lit(ratio) * F.col("n"), F.col("best")))
    rows = scratch_table(rows.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "near")
    ends = roots(rows.filter("form is not null").select("rank", "form"))
    name = ranked.select(F.col("rank").alias("_k"), F.col("word").alias("_name"))
    linked = rows.filter("form is not null").join(ends, "rank")
    linked = linked.join(name.select(F.col("_k").alias("form"), F.col("_name").alias("form_word")), "form")
    linked = linked.join(name.select(F.col("_k").alias("root"), F.col("_name").alias("root_word")), "root")
    columns = ["word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"]
    lone = rows.filter("form is null").select("word", F.lit(None).cast("string").alias("form_word"), F.col("word").alias("root_word"), "n", "n_near", "form_n")
    return linked.select(*columns).unionByName(lone.select(*columns))
