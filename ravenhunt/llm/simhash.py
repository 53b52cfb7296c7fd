"""Operator 3, SimHash near-duplicates: pigeonring filtering.

Fingerprints: a text's words (A-Z lowered, split at ASCII white space), its
shingles of ``SHINGLE`` words, the unsigned XXH64 of each; a bit is 1 if it is
set in more than half of the hashes.

Pairs within ``distance`` bits are found without comparing all: the 64 bits
form a ring of ``distance + 1`` segments. By the pigeonring principle (Qin and
Xiao 2018) a pair within the distance has a segment from which every chain of
consecutive segments keeps its cumulative difference within its share of the
budget: none in the first segment, at most one bit in the first two, two in
the first three, and so on. The index key holds the first segment whole and
the second with one bit blanked, so only pairs whose first two chain lengths
keep the budget ever meet; the longer chains are checked before the full
Hamming distance.

Copies share one fingerprint, and only distinct fingerprints are joined.
Within a key's group the links are found by growing connected sets, so a group
of k fingerprints gives at most k - 1 links, whose components equal those of
all links. A group of more than ``GROUP`` fingerprints is dealt out as pairs of
blocks to many tasks. Components then come from star contraction rounds.

Defined results: a null or empty text has fingerprint zero, which links like
any other; fewer words than a shingle give one shingle of all words; repeated
rows are a group; a row with a null doc_id keeps its component, whose id is
the smallest non-null doc_id; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import components, with_computed
from ravenhunt.session import scratch_table

SHINGLE, DISTANCE, SEED = 4, 4, 42
GROUP = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed long."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    done = 0
    while done < n:  # long texts in blocks
        m = min(n - done, 1 << 14)
        h = np.fromiter((xxh64_intdigest(g, SEED) for _, g in zip(range(m), grams)), np.uint64, m)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(m, 64).sum(0, dtype=np.int64)
        done += m
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(shingle: int):
    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        return {"fp": pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())}

    return compute


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_computed(docs, _fingerprints(shingle), "fp long").select("_row.doc_id", "fp")


def ring(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    edges = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(first: int, width: int):
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(fps: DataFrame, distance: int) -> DataFrame:
    """(key, fp): segment ``start`` whole and the next one with one bit
    blanked. The start stands in the key's upper six bits."""
    segments, keys = ring(distance), []
    for i, (a, wa) in enumerate(segments):
        b, wb = segments[(i + 1) % len(segments)]
        for hole in range(wb):
            body = F.xxhash64(F.lit(hole), _segment(a, wa), _segment(b, wb).bitwiseAND(F.lit(~(1 << hole))))
            keys.append(F.shiftrightunsigned(body, 6).bitwiseOR(F.lit(i << 58)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def chain_links(x: np.ndarray, y: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Indices of the pairs (x, y) within the distance: the chains from
    ``start`` that the key left open, shortest first, then all bits."""
    segments = ring(distance)
    diff = np.bitwise_xor(x, y)
    at, mask = np.arange(len(diff)), 0
    for length in range(len(segments)):
        first, width = segments[(start + length) % len(segments)]
        mask |= ((1 << width) - 1) << first
        budget = (length + 1) * distance // len(segments)
        if length >= 2 or length == len(segments) - 1:
            at = at[np.bitwise_count(diff[at] & np.uint64(mask)) <= budget]
    return at[np.bitwise_count(diff[at]) <= distance]


def group_links(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """At most k - 1 links that connect what all links of the group connect."""
    rest, links = np.unique(fps), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = chain_links(x, rest, start, distance)
            if len(near):
                front += list(rest[near])
                links += [(x, y) for y in rest[near]]
                rest = np.delete(rest, near)
    return links


def sorted_group_links(ids: np.ndarray, start: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of whole groups; ``ids`` are sorted."""
    fp = fp.view(np.uint64)
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(ids)])
    links = []
    two = first[sizes == 2]  # nearly all groups that have a pair at all
    for i in range(distance + 1):
        own = two[start[two] == i]
        own = own[chain_links(fp[own], fp[own + 1], i, distance)]
        links += zip(fp[own], fp[own + 1], strict=True)
    for s, n in zip(first[sizes > 2], sizes[sizes > 2], strict=True):
        links += group_links(fp[s : s + n], int(start[s]), distance)
    return links


def links_of_groups(keys: DataFrame, by: list[str], distance: int, group: int) -> DataFrame:
    """(a, b, key): the links within groups of rows equal in ``by`` (the first
    is ``key``), for rows sorted by it. With ``group``, larger groups come back
    unjoined instead, as rows (null, fp, key)."""
    names = ["a", "b", "key"]

    def linked(ids, k, f):
        links = np.array(sorted_group_links(ids, k[0] >> 58, f, distance), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.nulls(len(links), pa.int64())], names=names)

    def unjoined(k, f):
        return pa.RecordBatch.from_arrays([pa.nulls(len(f), pa.int64()), pa.array(f), pa.array(k[0])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f, large = np.empty((len(by), 0), np.int64), np.empty(0, np.int64), None
        for batch in batches:
            k = np.concatenate([k, np.stack([batch.column(c).to_numpy() for c in by])], axis=1)
            f = np.concatenate([f, batch.column("fp").to_numpy()])
            if large is not None:  # more of a large group
                same = (k == large).all(0)
                yield unjoined(k[:, same], f[same])
                k, f = k[:, ~same], f[~same]
                large = None if len(f) else large
            if not len(f):
                continue
            ids = np.r_[0, np.cumsum((k[:, 1:] != k[:, :-1]).any(0))]
            last = int(np.searchsorted(ids, ids[-1]))  # the last group may go on in the next batch
            yield linked(ids[:last], k[:, :last], f[:last])
            k, f = k[:, last:], f[last:]
            if group and len(f) > group:
                large = k[:, :1]
                yield unjoined(k, f)
                k, f = k[:, :0], f[:0]
        if len(f):
            yield linked(np.zeros(len(f), np.int64), k, f)

    return keys.mapInArrow(run, "a long, b long, key long")


def near_links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect what all
    pairs within the distance connect."""
    if distance < 1:  # distinct fingerprints differ
        return fps.sparkSession.createDataFrame([], "a long, b long")
    keys = ring_keys(fps, distance).repartition("key").sortWithinPartitions("key")
    found = scratch_table(links_of_groups(keys, ["key"], distance, group).distinct(), "links")
    links = found.filter("a is not null").select("a", "b")
    large = found.filter("a is null").select("key", F.col("b").alias("fp"))
    if not large.isEmpty():
        # a large group: its blocks meet pair by pair, each pair of blocks in one task
        blocks = large.join(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / group).cast("int").alias("n")), "key")
        block = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        tiles = blocks.select("key", "fp", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
        tiles = tiles.select("key", (F.least("b", "c").cast("long") * 2**31 + F.greatest("b", "c")).alias("tile"), "fp")
        tiles = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile")
        more = links_of_groups(tiles, ["key", "tile"], distance, 0)
        links = links.union(more.select("a", "b"))
    return links


def classes(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(fp, first, root): each distinct fingerprint of ``fps`` (doc_id, fp), its
    smallest doc_id and the fingerprint that stands for its component."""
    alone = scratch_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(alone.select("fp"), distance, group))
    return alone.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of ``docs`` (doc_id, text)."""
    fps = scratch_table(fingerprints(docs, shingle), "fingerprints")
    placed = classes(fps, distance, group)
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the
    smallest doc_id (a null one only if the component has no other; of repeated
    rows one)."""
    columns = docs.columns
    fps = scratch_table(fingerprints(docs, shingle), "fingerprints")
    placed = classes(fps, distance, group)
    stays = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("s")).select("s.first", F.col("s.fp").alias("own"))
    repeated = not fps.groupBy("doc_id", "fp").count().filter("count > 1").isEmpty()
    rows = with_computed(docs, _fingerprints(shingle), "fp long")
    same = (F.col("fp") == F.col("own")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("first"))
    rows = rows.join(stays, same, "left_semi")
    if repeated:
        rows = rows.withColumn("_id", F.col("_row.doc_id")).dropDuplicates(["_id", "fp"])
    return rows.select("_row.*").select(*columns)
