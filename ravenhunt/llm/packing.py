"""Operator 4, best-fit packing.

Best-fit decreasing over all pieces: pieces go, longest first, into the open
sequence with the least room that still holds them. Sequences with equal room
are alike, and so are pieces of equal length, so the plan needs only the
number of pieces of each length (at most ``capacity`` counts, whatever the
input). A segment tree over the capacities 0..capacity, holding which of them
have open sequences, finds the tightest fit in logarithmic time; runs of equal
pieces that meet runs of equal sequences are placed in one step. The plan is
the exact best-fit-decreasing packing, as a table of runs ``(length, first
rank, how many, first sequence, offset)``.

Spark does the rest: tokenizing (Arrow), counting lengths, ranking the pieces
of each length (``with_rank``, so a common length is spread over buckets), and
looking each piece's run up.

Defined results: a null text is an empty one (the end token alone); repeated
rows are packed each; an empty table gives an empty result; only doc_id and
text are read. The plan's size depends on the capacity, not on the rows; it is
broadcast up to ``BROADCAST_RUNS`` runs and joined by length and rank beyond.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import Memo, tidied, with_rank
from ravenhunt.llm.tokens import tokenizer
from ravenhunt.session import scratch_table, settings

WORDS_HELD, PARTS_HELD = 32 << 20, 64 << 20  # bytes of the memories of a task
BROADCAST_RUNS = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_pack = [Struct(f"<{n}I").pack for n in range(16)]
STEP = 4 << 20
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(STEP)}  # 64 MB else, held by Spark and by the worker
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class WordIds:
    """Token ids of whole texts, through the ids of their words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words (runs without ASCII white space) one after another.
    Words are encoded by the library and kept as little-endian bytes, as far as
    the task's bounded memories reach; words of plain letters share their
    parts' ids. That the words' and parts' ids make up the library's is checked
    on the tokenizer's own vocabulary when it is loaded (``alike``); with a
    tokenizer where they do not, whole texts go to the library."""

    def __init__(self, path: str):
        import regex

        self.tok = tokenizer(path)
        self.forget()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.easy = re.compile("[!-~¡-¬®-ɏ]*").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes = {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}  # byte-level alphabet
        self.alike = self.probe()

    def forget(self) -> None:
        self.odd: Memo = Memo(WORDS_HELD)  # words of more than letters
        self.parts: Memo = Memo(PARTS_HELD)

    def part(self, s: bytes) -> bytes:
        """Ids of a lower-cased part (letters, a number or signs)."""
        tokens = self.tok.model.tokenize(s.decode() if s.isalnum() else s.decode("latin-1").translate(self.bytes))
        n = len(tokens)
        ids = _pack[n](*[t.id for t in tokens]) if n < len(_pack) else np.array([t.id for t in tokens], "<u4").tobytes()
        self.parts.put(s, ids, len(s) + 4 * n)
        return ids

    def whole(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters
            w = w.lower()
            return self.parts.get(w) or self.part(w)
        if w[-1] in b".,;:!?" and w[:-1].isalpha():
            a, b = w[:-1].lower(), w[-1:]
            return (self.parts.get(a) or self.part(a)) + (self.parts.get(b) or self.part(b))
        ids = self.odd.get(w)
        if ids is None:
            s = w.decode()
            if self.easy(s) and "<|" not in s:  # here the library's normaliser is NFC and lower case, letter by letter
                found = [p.encode() for p in self.split((s if s.isascii() else unicodedata.normalize("NFC", s)).lower())]
                ids = b"".join([self.parts.get(p) or self.part(p) for p in found])
            else:
                ids = self.whole(s)
            self.odd.put(w, ids, len(w) + len(ids))
        return ids

    def probe(self) -> bool:
        """Do this tokenizer's ids come from words and parts? Held against the
        library on its vocabulary, as it stands, capitalised, and in running text."""
        known = sorted(t for t in self.tok.get_vocab() if t.isprintable())[:: max(1, self.tok.get_vocab_size() // 2000)]
        words = [w for t in known for w in (t, t.capitalize(), f"{t}.", f"({t}9", f"é{t}'s")] + ["don't", "A1-b_2", "Straße,", "x\u0301y", "日本語", "<|endoftext|>", "ĀÉÿ"]
        texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["  a\tb\n c ", "", " "]
        return all(a == self.whole(t) for a, t in zip(self.by_words(pa.array(texts)), texts, strict=True))

    def by_words(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids. Arrow splits the texts and finds the distinct words;
        only those are looked up, and numpy lays their ids out again."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat, at = split.flatten(), split.offsets.to_numpy()
        at = at - at[0]
        words = flat.filter(pc.not_equal(flat, "")) if len(flat) else flat
        blank = np.r_[0, np.cumsum(pc.equal(flat, "").to_numpy(zero_copy_only=False))] if len(flat) else np.zeros(1, np.int64)
        at = at - blank[at]  # splitting leaves empty words at a text's ends
        coded = words.dictionary_encode()
        known = list(map(self.word, coded.dictionary.cast(pa.large_binary()).to_pylist()))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        per_word = size[which]
        end = np.cumsum(per_word)
        laid = ids[np.repeat(start[which] - end + per_word, per_word) + np.arange(end[-1] if len(end) else 0)]
        cut = np.r_[0, end][at]
        return (laid[lo:hi].tobytes() for lo, hi in itertools.pairwise(cut.tolist()))

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, some ``STEP`` bytes of texts (at least one) at once."""
        texts = pc.fill_null(texts, "")
        if not self.alike:
            yield from (self.whole(t) for t in texts.to_pylist())
            return
        ends, lo = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            yield from self.by_words(texts.slice(lo, hi - lo))
            lo = hi


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """Loaded once per worker. (A function that is sent to the workers has
    copies of the module's own names, so it can't look them up itself.)"""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The token pieces of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        ids_of.forget()
        end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        ids_of.forget()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(run), PIECE)


class Tightest:
    """Segment tree over 0..n: which values are open; the least open value at or above one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = bytearray(2 * self.size)

    def set(self, i: int, on: bool) -> None:
        i += self.size
        self.tree[i] = on
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def at_least(self, i: int) -> int | None:
        i += self.size
        if self.tree[i]:
            return i - self.size
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, n, first sequence, offset) of the exact
    best-fit-decreasing packing of ``counts`` (length -> pieces)."""
    tree = Tightest(capacity)
    rooms: dict[int, list[list[int]]] = {}  # room left -> [first sequence, how many]
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                tree.set(room, True)
            rooms[room].append([first, n])

    def take(room: int, want: int) -> tuple[int, int]:
        first, n = rooms[room][-1]
        n = min(n, want)
        rooms[room][-1][0] += n
        rooms[room][-1][1] -= n
        if not rooms[room][-1][1]:
            rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                tree.set(room, False)
        return first, n

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            each = (room or capacity) // length  # what one sequence of this room takes before the next is tighter
            want = max(1, left // each)
            each = min(each, left)
            if room is None:
                room, first, n = capacity, opened, want
                opened += n
            else:
                first, n = take(room, want)
            for k in range(each):
                plan.append((length, rank, n, first, capacity - room + k * length))
                rank += n
            left -= each * n
            put(room - each * length, first, n)
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset."""
    spark = docs.sparkSession
    with settings(spark, BATCH):
        cut = scratch_table(pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_fit_plan(counts, capacity)
    ranked = with_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    if len(plan) > BROADCAST_RUNS:
        runs = spark.createDataFrame(plan, "_l long, _r long, _m long, _s long, offset long")
        here = (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_r")) & (F.col("_rank") < F.col("_r") + F.col("_m"))
        return ranked.join(runs, here).withColumn("sequence_id", F.col("_s") + F.col("_rank") - F.col("_r")).select(*COLUMNS)
    table = np.array(sorted(plan) or [(0, 0, 0, 0, 0)], np.int64)
    shared = spark.sparkContext.broadcast(((table[:, 0] << 48) + table[:, 1], table))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = shared.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            found = runs[np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=COLUMNS)

    return ranked.select(*COLUMNS[:5], "_rank").mapInArrow(locate, PIECE + ", sequence_id long, offset long")
