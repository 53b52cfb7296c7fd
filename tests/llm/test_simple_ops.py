"""Token counts, packing, sharding, SimHash and nearest neighbours against brute force."""

import collections
import gc
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from ravenhunt.llm import common, nearest, packing, sharding, simhash, tokens

from .cases import awkward, frame, prose

SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple]:
    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk,overlap", [(tokens.CHUNK, tokens.OVERLAP), (300, 16), (40, 4)])
def test_token_counts(spark, chunk, overlap):
    rows = awkward() + [(i + 1000, t) for i, t in corpus()]
    if chunk < 1000:
        rows = [(i, t and t[:4000]) for i, t in rows]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert rows_of(tokens.token_counts(frame(spark, rows), path, 1024, chunk, overlap)) == sorted(want, key=repr)


def test_overlap_widens(spark):
    tok = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "ab" * 3000 + " tail of it " + "-" * 2000 + " end"
    assert tokens.spliced_count(text, tok, 64, 8) == len(tok.encode(text, add_special_tokens=False).ids)


def test_packing_is_whole_and_tight(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in awkward() if i != 6] + [(i + 1000, t) for i, t in corpus()]
    rows = [(i if i is not None else -1, t) for i, t in rows]
    capacity = 512
    got = packing.pack(frame(spark, rows), path, capacity, 1).collect()
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_best_fit([r.length for r in got], capacity)


def plain_best_fit(lengths, capacity) -> int:
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_equals_plain_best_fit():
    rnd = np.random.default_rng(0)
    for trial in range(200):
        capacity = int(rnd.integers(5, 60))
        lengths = rnd.integers(1, capacity + 1, int(rnd.integers(1, 300)))
        if trial % 3 == 0:
            lengths = np.minimum(lengths, rnd.integers(1, 6))
        plan = packing.best_fit_plan(dict(collections.Counter(lengths.tolist())), capacity)
        used, seen = collections.defaultdict(list), collections.Counter()
        for length, rank, n, first, offset in plan:
            assert rank == seen[length]
            seen[length] += n
            for s in range(first, first + n):
                used[s].append((offset, length))
        assert seen == collections.Counter(lengths.tolist())
        for s in used.values():
            ends = [0, *(o + n for o, n in sorted(s))]
            assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= capacity
        assert len(used) == plain_best_fit(lengths, capacity)


def plain_fingerprint(text) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("distance,group", [(4, 20_000), (4, 8), (2, 20_000), (1, 20_000)])
def test_simhash(spark, distance, group):
    rows = awkward() + [(i + 1000, t) for i, t in corpus()]
    fps = {t: plain_fingerprint(t) for _, t in rows}
    want, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = [fps[t] for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    want = [(d, f"{f[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)]
    assert rows_of(simhash.near_duplicates(frame(spark, rows), 4, distance, group)) == sorted(want, key=repr)


@pytest.mark.parametrize("group", [50, 20_000])
def test_near_links_of_dense_fingerprints(spark, group):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 3, np.uint64)
    flips = [int(base[i % 3]) ^ sum(1 << int(b) for b in set(rnd.integers(0, 64, int(rnd.integers(0, 5))))) for i in range(600)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in flips})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, group).collect()

    def roots(pairs):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = collections.defaultdict(set)
        for x in fps:
            groups[find(x)].add(x)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    assert roots(links) == roots(near)


def test_sharding(spark):
    rows = awkward() + [(i + 1000, t) for i, t in corpus()] + [(5000 + i, "copied many times") for i in range(90)]
    got = sharding.balanced_shards(frame(spark, rows), 7).collect()
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(7))
    sizes = [len(x) for x in per.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    where = collections.defaultdict(set)
    for r in got:
        where[r["size"], r.text_crc32].add(r.shard)
    copied = (len("copied many times") + 16, zlib.crc32(b"copied many times"))
    assert len(where.pop(copied)) <= 5  # larger than a shard: few parts
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    vectors = [(i, rnd.normal(size=8).astype("float32").tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(300)] + [(100, vectors[100][1])]
    vectors += [(1000, None), (1001, [0.0] * 8), (1050, [float("nan")] * 8), (1002, [1.0, None] + [0.0] * 6), (None, vectors[3][1]), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as q").repartition(5)
    got = nearest.nearest(df, every=50, k=5, block=64).collect()
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    want = {}
    for q, a in good.items():
        if q % 50 == 0:
            scored = sorted((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            scored = sorted((round(s, 12), i) for s, i in scored)[:5]
            want[q] = [(i, -s) for s, i in scored]
    mine = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in x] for q, x in mine.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(s - t) < 1e-9 for q in mine for (_, s), (_, t) in zip(mine[q], want[q]))


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")]).filter("doc_id > 1")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.token_counts(docs, path).count() == 0
    assert packing.pack(docs, path).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert sharding.balanced_shards(docs, 5).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors).count() == 0


def test_long_prose_is_chunked(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = prose(9, 60_000)
    assert len(text) > 2 * tokens.CHUNK
    want = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert tokens.token_counts(frame(spark, [(1, text)]), path).first().n_tokens == want


def test_packing_workers_stay_small(spark):
    """After its tasks a worker keeps one loaded tokenizer at most, and none of the words it met."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(64)], "doc_id long, text string").repartition(24)
    assert packing.pieces(docs, path, 4096, 1).count() == 64

    def alive(batches):
        found = [o for o in gc.get_objects() if type(o).__name__ == "WordIds"]
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([len(found)]), pa.array([sum(len(o.odd) + len(o.parts) for o in found)])], names=["loaded", "words"])

    rows = spark.range(0, 64, 1, 24).mapInArrow(alive, "loaded long, words long").collect()
    assert max(r.loaded for r in rows) <= 1 and sum(r.words for r in rows) == 0


def test_packing_takes_small_batches(spark, monkeypatch):
    """Texts come to the workers some 4 MB at once (by default 64 MB), and only there."""

    def sizes(docs, path, capacity, end_id):
        def run(batches):
            for batch in batches:
                n = batch.column("text").nbytes >> 20
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((n, pa.int64()), (0, pa.int32()), (0, pa.int64()), (1, pa.int64()), (0, pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.mapInArrow(run, packing.PIECE)

    monkeypatch.setattr(packing, "pieces", sizes)
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 200000) as text")
    got = [r.doc_id for r in packing.pack(docs, "").collect()]
    assert sum(got) >= 20 and max(got) <= 6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_freed_memory_goes_back():
    """Arrow's pool and the C library keep what is freed, unless told."""

    def held() -> int:
        return int(re.search(r"Private_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    common.give_back()
    before = held()
    small = [pa.array([str(i) * 50]) for i in range(200_000)]
    most = held()
    kept, small = small[::1000], None
    common.give_back()
    assert most - before > 60 and held() - before < (most - before) / 2 and len(kept) == 200
