"""Operator 10, suffix-array deduplication over bytes: bucket-pointer refinement.

Each byte covered by a ``WINDOW``-byte string that also starts earlier goes.
``windows.marked`` settles the runs of windows whose whole text repeats; what is
left are anchors with several texts around them. Their suffixes are sorted as
far as the window reaches, by bucket-pointer refinement (Schuermann and Stoye
2007): the first ``GRAM0`` bytes of a suffix choose its bucket, and a suffix's
bucket pointer is the place where its bucket begins. Buckets of more than one
suffix are refined by sorting on the bucket pointers of the suffixes a bucket
depth later; the refined pointers are written back and used by the next
refinement, so the depth doubles each time. Suffixes alone in their bucket are
done and are not sorted again. Windows still in one bucket at the window's
length are equal, and all but the first in document order are marked.

Defined results: a null text is an empty one; texts shorter than a window lose
nothing; of repeated rows (also of one doc_id) the first stays; null doc_ids
come last in the order; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ravenhunt.llm.windows import Kind, by_document, covered, marked, prepared

WINDOW, GRAM, GRAM0 = 100, 40, 8
CHUNK, HOT = 1 << 21, 10_000  # bytes that are sorted together; different texts under one key


def window_buckets(text: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, pointers) of all windows of ``window`` bytes; equal windows have
    equal pointers. ``end`` has, for each place, the end of its own string."""
    room = end - np.arange(len(text))
    q = min(GRAM0, window)
    value = np.zeros(len(text), np.uint64)
    for i in range(q):
        value[: len(text) - i] = (value[: len(text) - i] << np.uint64(8)) | text[i:]
    pointer = len(text) + np.arange(len(text))  # a suffix too short for its depth is alone
    active = np.flatnonzero(room >= q)
    active = refined(pointer, active, value[active])
    depth = q
    while depth < window:
        step = min(depth, window - depth)
        active = active[room[active] >= depth + step]
        active = refined(pointer, active, pointer[active + step], within=True)
        depth += step
    starts = np.flatnonzero(room >= window)
    return starts, pointer[starts]


def refined(pointer: np.ndarray, active: np.ndarray, key: np.ndarray, within: bool = False) -> np.ndarray:
    """Sort ``active`` by ``key`` (within their buckets) and point each at its
    new bucket's first place; returns those that still share one."""
    if not len(active):
        return active
    old = pointer[active] if within else np.zeros(len(active), np.int64)
    order = np.lexsort((key, old))
    active, key, old = active[order], key[order], old[order]
    new_old = np.r_[True, old[1:] != old[:-1]]
    new = new_old | np.r_[True, key[1:] != key[:-1]]
    place = np.arange(len(active))
    first = np.maximum.accumulate(np.where(new, place, 0))
    base = np.maximum.accumulate(np.where(new_old, place, 0))
    pointer[active] = old + first - base
    sizes = np.diff(np.r_[np.flatnonzero(new), len(active)])
    return np.sort(active[np.repeat(sizes > 1, sizes)])


def seen_before(texts: list[bytes], doc, seq, start, weight, window: int = WINDOW) -> list[np.ndarray]:
    """Which windows of each text are not the first of their kind in document order."""
    if not texts:
        return []
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(length)[:-1]]
    text = np.frombuffer(b"".join(texts), np.uint8)
    own = np.repeat(np.arange(len(texts)), length)
    at, pointer = window_buckets(text, (begin + length)[own], window)
    order = np.lexsort((start[own[at]] + at - begin[own[at]], seq[own[at]], doc[own[at]], pointer))
    later = np.r_[False, pointer[order][1:] == pointer[order][:-1]]
    hit = np.zeros(len(text), bool)
    hit[at[order[later]]] = True
    return [hit[b : b + n - window + 1] for b, n in zip(begin, length, strict=True)]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of ``docs`` (doc_id, text):
    kept is the remaining bytes, n_spans the number of maximal removed runs."""
    docs = prepared(docs)
    marks = marked(docs, Kind(window, min(gram, window), False), True, partial(seen_before, window=window), hot, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            marks = batch.column("marks")
            for i in range(batch.num_rows):
                text = unpress.decompress(batch.column("z")[i].as_py())
                gone = covered(len(text), np.array(marks[i].as_py() or [], np.int64), window)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), *(pa.array([n], pa.int64()) for n in (len(text), int(gone.sum()), spans)), pa.array([kept], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return by_document(docs, marks).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
