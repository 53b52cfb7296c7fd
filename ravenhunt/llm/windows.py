"""Windows of fixed length that occur again: what operators 2 and 10 share.

A window is ``window`` consecutive symbols (words or bytes) of one document.
Neighbouring windows are handled in *runs*: each window's anchor is its
``gram``-gram with the smallest hash (the leftmost of equals), and a run is the
windows in a row that have the same anchor. Equal windows have equal anchors at
equal places, wherever they stand, so it is enough to compare runs of equal
anchors:

1. ``scan`` finds the runs of every document with numpy and packs them by the
   anchor's hash into one row per Arrow batch and part. Runs that repeat within
   a batch with the same text are combined there (a passage in a third of all
   documents gives one record per batch).
2. ``settle`` gets whole parts. Anchors that occur once are done. Runs of equal
   anchor and text are settled together. What is left are anchors with several
   different texts around them: only these are looked at symbol by symbol.
3. ``contexts`` fetches the texts of the runs left, and the operator's own
   method (suffix automata, bucket refinement) compares them per anchor.
   An anchor with more than ``hot`` different texts is refined further: its
   windows are split by the anchor's place in them, and the symbols that all
   windows of a share have in common join the key. ``refined`` goes on until no
   key of several places has more than ``hot`` texts, by counting them.
4. ``by_document`` brings all marks (start, windows) to their documents.

Documents are told apart by (doc, seq): doc is the doc_id (null: the largest
long, so such rows come last), seq tells rows of equal doc_id apart by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import partitions, with_rank
from ravenhunt.operators.joins import sized_broadcast
from ravenhunt.session import scratch_table

BLOCK = 1 << 20  # symbols that are looked at together
LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xFFFFFF)
MARK = np.dtype([("doc", "<i8"), ("seq", "<i4"), ("start", "<i8"), ("n", "<u2")])
RUN = np.dtype([("anchor", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("seq", "<i4"), ("start", "<i8"), ("n", "<u2"), ("at", "<u2"), ("many", "u1")])


@dataclass(frozen=True)
class Kind:
    """What a symbol is: how to read a document's symbols and cut out a part of it."""

    window: int
    gram: int
    words: bool

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols one after another (bytes as uint8, words as hashes) and where each document begins."""
        if not self.words:
            return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        from xxhash import xxh64_intdigest

        parts = [np.fromiter(map(xxh64_intdigest, w := t.split()), np.uint64, len(w)) for t in texts]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]

    def split(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.words else text

    def cut(self, split, start: int, end: int) -> bytes:
        return b" ".join(split[start:end]) if self.words else split[start:end]


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def gram_hashes(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of each ``q`` consecutive symbols, by doubling."""
    n, out, done, cur, size = len(h) - q + 1, None, 0, h, 1
    while True:
        if q & size:
            piece = cur[done : done + n]
            out = piece if out is None else mix(out * _ODD + piece)
            done += size
        if 2 * size > q:
            return out
        cur = mix(cur[:-size] * _ODD + cur[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """``_ODD`` and its inverse to the powers 0..n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        size = max(n, BLOCK + (1 << 12))
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)], dtype=np.uint64) for x in (_ODD, inverse)]
    return _POWERS


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols of each [start, end), whatever stands around them."""
    power, inverse = powers(len(h))
    sums = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64)]
    return mix((sums[end] - sums[start]) * inverse[start])


def find_runs(symbols: np.ndarray, begins: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """(document's index, anchor hash, hash of the run's text, first window, number of windows, anchor's place after it) of
    each run, a block at a time."""
    w = kind.window - kind.gram + 1
    for lo in range(0, max(0, len(symbols) - kind.window + 1), BLOCK):
        part = symbols[lo : lo + BLOCK + kind.window - 1]
        h = BYTE[part] if part.dtype == np.uint8 else mix(part * _ODD)
        grams = gram_hashes(h, kind.gram)
        place = np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min((grams & ~_PLACE) | place, w) & _PLACE).astype(np.int64)
        starts = np.arange(lo, lo + len(at))
        doc = np.searchsorted(begins, starts, "right") - 1
        whole = starts + kind.window <= begins[doc + 1]
        new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        # within a document the windows that don't fit are its last ones
        n = np.add.reduceat(whole.astype(np.int64), first)
        first, n = first[n > 0], n[n > 0]
        if not len(first):
            continue
        anchor = at[first]
        span = span_hashes(h, first, first + n + kind.window - 1) ^ mix((anchor - first).astype(np.uint64) * _ODD + np.uint64(1))
        yield doc[first], grams[anchor], span, starts[first] - begins[doc[first]], n, anchor - first


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, seq, text); seq is 0 where doc_ids are unique, which one narrow count tells."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    if docs.groupBy("doc").count().filter("count > 1").isEmpty():
        return docs.withColumn("seq", F.lit(0))
    return scratch_table(with_rank(docs, ["doc"], [F.sha2(F.coalesce("text", F.lit("")), 256)], "seq")
                         .withColumn("seq", F.col("seq").cast("int")), "numbered")


def _bytes(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def limited(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their bytes pass ``most``."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def scan(docs: DataFrame, kind: Kind, first_stays: bool, parts: int) -> DataFrame:
    """(part, kind, blob): runs (kind 1) by anchor, marks (kind 0) by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in limited(batches):
            symbols, begins = kind.symbols(_bytes(batch.column("text")))
            doc, seq = batch.column("doc").to_numpy(), batch.column("seq").to_numpy()
            found = [np.empty(0, RUN)]
            for i, anchor, span, start, n, at in find_runs(symbols, begins, kind):
                runs = np.zeros(len(i), RUN)
                for name, col in zip(("anchor", "span", "doc", "seq", "start", "n", "at"), (anchor, span, doc[i], seq[i], start, n, at), strict=True):
                    runs[name] = col
                found.append(runs)
            runs = np.concatenate(found)
            runs = runs[np.lexsort((runs["start"], runs["seq"], runs["doc"], runs["span"], runs["anchor"]))]
            again = np.r_[False, same_run(runs)] if len(runs) else np.empty(0, bool)
            many = np.r_[again[1:], False] | again if len(runs) else again
            marks = runs[again if first_stays else many]
            runs["many"] = many
            runs = runs[~again]
            yield packed(runs, (runs["anchor"] % np.uint64(parts)).astype(np.int64), 1)
            yield packed(as_marks(marks), (mix(marks["doc"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), 0)

    return docs.select("doc", "seq", "text").mapInArrow(run, "part int, kind int, blob binary")


def same_run(runs: np.ndarray) -> np.ndarray:
    """Which of the sorted runs have the anchor and text of the one before."""
    return (runs["anchor"][1:] == runs["anchor"][:-1]) & (runs["span"][1:] == runs["span"][:-1])


def as_marks(runs: np.ndarray) -> np.ndarray:
    marks = np.empty(len(runs), MARK)
    for name in MARK.names:
        marks[name] = runs[name]
    return marks


def packed(rows: np.ndarray, part: np.ndarray, kind: int) -> pa.RecordBatch:
    """One blob per part: the columns one after another, ordered by document, so that they compress."""
    order = np.lexsort((rows["start"], rows["doc"], part))
    rows, part = rows[order], part[order]
    parts, first = np.unique(part, return_index=True)
    blobs = [b"".join(c[name].tobytes() for name in rows.dtype.names) for c in np.split(rows, first[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def unpacked(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(blob) // dtype.itemsize
    rows, at = np.empty(n, dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize * n
        rows[name] = np.frombuffer(blob[at : at + size], dtype[name])
        at += size
    return rows


SETTLED = "kind int, doc long, seq int, start long, n int, at int, anchor long, weight int, others int"


def settled(parts: DataFrame, first_stays: bool, n_parts: int) -> DataFrame:
    """Marks (kind 0) and the runs left (kind 1; ``others`` different texts have their anchor)."""

    def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        runs = runs[np.lexsort((runs["start"], runs["seq"], runs["doc"], runs["span"], runs["anchor"]))]
        again = np.r_[False, same_run(runs)]
        group = np.cumsum(~again) - 1  # runs of one anchor and text
        many = np.maximum(np.bincount(group), 1 + np.bincount(group, runs["many"]).astype(int)) > 1
        marks = runs[again if first_stays else many[group]]
        first = runs[~again]
        by_anchor = np.cumsum(np.r_[True, first["anchor"][1:] != first["anchor"][:-1]]) - 1
        texts = np.bincount(by_anchor)[by_anchor]
        left = texts > 1
        if not first_stays:  # one that occurs once must be among them
            left &= (np.bincount(by_anchor, ~many) > 0)[by_anchor]
        return marks, first[left], 1 + many[left], texts[left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, rows, at=None, anchor=None, weight=None, others=None):
            n, zero = len(rows), np.zeros(len(rows), np.int64)
            cols = [np.full(n, kind), rows["doc"], rows["seq"], rows["start"], rows["n"], *(zero if x is None else x for x in (at, anchor, weight, others))]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in SETTLED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types, strict=True)], names=names)

        def whole(blobs):
            marks, left, weight, others = settle(np.concatenate(blobs))
            yield out(0, marks)
            yield out(1, left, left["at"], np.ascontiguousarray(left["anchor"]).view(np.int64), weight, others)

        held, part = [], None
        for batch in batches:
            for p, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 0:
                    yield out(0, unpacked(blob.as_py(), MARK))
                    continue
                if p != part and held:
                    yield from whole(held)
                    held = []
                part = p
                held.append(unpacked(blob.as_py(), RUN))
        if held:
            yield from whole(held)

    return parts.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(run, SETTLED)


def zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, seq, z): the texts compressed, as texts are large in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [press.compress((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "doc", "seq")] + [pa.array(z, pa.binary())], names=["doc_id", "doc", "seq", "z"])

    return docs.select("doc_id", "doc", "seq", "text").mapInArrow(run, "doc_id long, doc long, seq int, z binary")


CONTEXT = "key long, low int, high int, at int, doc long, seq int, start long, n int, weight int, text binary"


def shares(n: int, at: int, places: int, others: int, hot: int) -> list[tuple[int, int, int, int]]:
    """A run's windows split by the anchor's place in the window, the finer the
    more texts its anchor has: (first window, windows, lowest place, highest
    place) of each share; the places are those of the share, not of the run."""
    size = places
    while others > hot and size > 1:
        size, others = -(-size // 2), others // 2
    out, k = [], 0
    while k < n:  # in the run's window k the anchor stands at place at - k
        low = (at - k) // size * size
        m = min(n - k, at - k - low + 1)
        out.append((k, m, low, min(low + size, places) - 1))
        k += m
    return out


def contexts(docs: DataFrame, left: DataFrame, kind: Kind, hot: int) -> DataFrame:
    """The texts of the runs left, under the key where they meet those they may equal."""
    asked = left.groupBy("doc", "seq").agg(F.collect_list(F.struct("start", "n", "at", "anchor", "weight", "others")).alias("runs"))
    places = kind.window - kind.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, seq = batch.column("doc").to_pylist(), batch.column("seq").to_pylist()
            for i in range(batch.num_rows):
                split = kind.split(unpress.decompress(batch.column("z")[i].as_py()))
                rows = []
                for r in batch.column("runs")[i].as_py():
                    anchor = r["start"] + r["at"]
                    for k, m, low, high in shares(r["n"], r["at"], places, r["others"], hot):
                        key, start = r["anchor"], r["start"] + k
                        if high - low + 1 < places:  # what all windows of the share have in common
                            key = _joined(key, low, kind.cut(split, anchor - low, anchor - high + kind.window))
                        rows.append((key, low, high, r["at"] - k, doc[i], seq[i], start, m, r["weight"], kind.cut(split, start, start + m - 1 + kind.window)))
                yield _context(rows)

    return zipped(docs).join(asked, ["doc", "seq"]).select("doc", "seq", "z", "runs").mapInArrow(run, CONTEXT)


def _context(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    cols = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in CONTEXT.split(", ")])


def _joined(key: int, low: int, core: bytes) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(core, (key ^ low) & (2**64 - 1))
    return x - (1 << 64) if x >= 1 << 63 else x


def refined(found: DataFrame, kind: Kind, hot: int) -> DataFrame:
    """The contexts in shares of half as many places, as long as more than ``hot`` texts have a share's key."""

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, low, high, at, doc, seq, start, n, weight, text in zip(*(batch.column(x.split()[0]).to_pylist() for x in CONTEXT.split(", ")), strict=True):
                split, half = kind.split(text), low + (high - low + 1) // 2
                upper = min(n, max(0, at - half + 1))  # the windows whose anchor stands at ``half`` or after it come first
                for k, m, lo, hi in ((0, upper, half, high), (upper, n - upper, low, half - 1)):
                    if m:
                        core = kind.cut(split, at - lo, at - hi + kind.window)
                        rows.append((_joined(key, lo, core), lo, hi, at - k, doc, seq, start + k, m, weight, kind.cut(split, k, k + m - 1 + kind.window)))
            yield _context(rows)

    done = []
    while True:
        crowded = found.filter("low < high").groupBy("key").count().filter(F.col("count") > hot).select("key")
        crowded = scratch_table(crowded, "crowded")  # at most one key in ``hot`` texts
        if crowded.isEmpty():
            return scratch_table(reduce(DataFrame.unionByName, [*done, found]), "refined") if done else found
        few = sized_broadcast(crowded)
        done.append(found.join(few, "key", "left_anti"))
        found = scratch_table(found.join(few, "key").select(*found.columns).mapInArrow(halved, CONTEXT), "contexts")


MARKS = "doc long, seq int, start long, n int"
Resolve = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def resolved(found: DataFrame, resolve: Resolve, chunk: int) -> DataFrame:
    """Marks within the contexts of one key. ``resolve(texts, doc, seq, start, weight)``
    gets whole keys, about ``chunk`` bytes of text at a time, and says for each text which
    of its windows are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            doc, seq, start, weight = (t.column(c).to_numpy() for c in ("doc", "seq", "start", "weight"))
            marks = []
            for i, hit in enumerate(resolve(t.column("text").to_pylist(), doc, seq, start, weight)):
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                    marks += [(doc[i], seq[i], start[i] + a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            cols = zip(*marks, strict=True) if marks else [()] * 4
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=["doc", "seq", "start", "n"])

        def chunks(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole keys, as many as fit."""
            key = t.column("key").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            size = np.r_[0, np.cumsum(pc.binary_length(t.column("text")).to_numpy())][edges]
            i = 0
            while i < len(edges) - 1:
                j = max(i + 1, int(np.searchsorted(size, size[i] + chunk, "right")) - 1)
                yield out(t.slice(edges[i], edges[j] - edges[i]))
                i = j

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            key = batch.column("key")
            if not rows or len(key) and key[0] == key[-1] and sum(b.nbytes for b in held) < chunk:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if last:
                yield from chunks(t.slice(0, last))
            held, rows = t.slice(last).to_batches(), len(key) - last
        if rows:
            yield from chunks(pa.Table.from_batches(held))

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, MARKS)


def marked(docs: DataFrame, kind: Kind, first_stays: bool, resolve: Resolve, hot: int, chunk: int) -> DataFrame:
    """Marks of all windows that occur again (``first_stays``: that occur before)."""
    parts = partitions(docs.sparkSession)
    table = scratch_table(settled(scan(docs, kind, first_stays, parts), first_stays, parts), "settled")
    left = table.filter("kind = 1").select("doc", "seq", "start", "n", "at", "anchor", "weight", "others")
    marks = table.filter("kind = 0").select("doc", "seq", "start", "n")
    columns = ["key", "doc", "seq", "start", "weight", "text"]
    found = contexts(docs, left.filter(F.col("others") <= hot), kind, hot).select(*columns)
    if not left.filter(F.col("others") > hot).isEmpty():
        crowd = scratch_table(contexts(docs, left.filter(F.col("others") > hot), kind, hot), "contexts")
        crowd = refined(crowd, kind, hot)
        # shares of one place: whole windows, of which only the count and the first matter
        alone = crowd.filter("low = high").select("key", F.struct("doc", "seq", "start").alias("at"), "weight", "doc", "seq", "start", "n")
        seen = alone.groupBy("key").agg(F.min("at").alias("first"), F.sum("weight").alias("times"))
        again = F.col("at") != F.col("first") if first_stays else F.col("times") > 1
        marks = marks.unionByName(alone.join(seen, "key").filter(again).select("doc", "seq", "start", "n"))
        found = found.unionByName(crowd.filter("low < high").select(*columns))
    return marks.unionByName(resolved(found, resolve, chunk))


def by_document(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, z, marks): each document with its marks, start * 65536 + windows (null: none)."""
    per = marks.groupBy("doc", "seq").agg(F.collect_list(F.col("start") * 65536 + F.col("n")).alias("marks"))
    return zipped(docs).join(per, ["doc", "seq"], "left").select("doc_id", "z", "marks")


def covered(n: int, marks: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` symbols are covered by marked windows."""
    edge = np.zeros(n + 1, np.int64)
    start = marks >> 16
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (marks & 65535) + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0
