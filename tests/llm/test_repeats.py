"""Repeated word and byte windows against brute force."""

import collections
import random

import duckdb
import numpy as np
import pytest

from ravenhunt.llm import substrings, suffixes, windows

from .cases import awkward, frame, prose

SF = "/root/testdata/sf0.001"


def brute_words(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    times = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for j in order:
        text = (rows[j][1] or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - window + 1):
            w = hash(text[i : i + window])
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((rows[j][0], len(text), int(gone.sum()), spans, bytes(np.frombuffer(text, np.uint8)[~gone[:-1]])))
    return sorted(out, key=repr)


def overlapping(seed: int) -> list[tuple]:
    """Texts that share pieces cut at random places, so that the same words stand in many surroundings."""
    rnd = random.Random(seed)
    base = [prose(seed + i, 150).split() for i in range(4)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rnd.randint(1, 5)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            words += b[i : i + rnd.randint(1, 120)] + prose(1000 * seed + d, rnd.randint(0, 3)).split()
        rows.append((2000 + d, " ".join(words)))
    return rows


def result(df):
    return sorted((tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window,gram,hot", [(35, 12, 2000), (6, 3, 2), (8, 1, 3)])
def test_words(spark, window, gram, hot):
    rows = awkward() + overlapping(1)
    if window == 35:
        rows += duckdb.connect().execute(f"select doc_id + 10000, text from '{SF}/documents.parquet'").fetchall()
    else:
        rows = [(i, t and t[:3000]) for i, t in rows]
    got = result(substrings.deduplicated(frame(spark, rows), window, gram, hot, 1 << 12))
    assert got == brute_words(rows, window)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


@pytest.mark.parametrize("window,gram,hot", [(100, 40, 10_000), (20, 8, 2), (12, 5, 3)])
def test_bytes(spark, window, gram, hot):
    rows = awkward() + overlapping(2)
    if window == 100:
        rows += duckdb.connect().execute(f"select doc_id + 10000, text from '{SF}/documents.parquet'").fetchall()
    else:
        rows = [(i, t and t[:2000]) for i, t in rows]
    assert result(suffixes.deduplicated(frame(spark, rows), window, gram, hot, 1 << 14)) == brute_bytes(rows, window)


def test_whole_windows_of_a_hot_anchor(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join([rnd.choice("abcd") for _ in range(9)] + ["same", "old", "line"] + [rnd.choice("abcd") for _ in range(9)])) for i in range(400)]
    got = result(substrings.deduplicated(frame(spark, rows), 5, 3, 1, 1 << 12))
    assert got == brute_words(rows, 5)
    assert result(suffixes.deduplicated(frame(spark, rows), 20, 8, 1, 1 << 12)) == brute_bytes(rows, 20)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def phrase(n: int, words: int) -> list[tuple]:
    """One phrase of 19 bytes within ``n`` different surroundings."""
    rnd = random.Random(6)
    return [(i, " ".join([rnd.choice("abcdefgh") for _ in range(words)] + ["some same old line"] + [rnd.choice("abcdefgh") for _ in range(words)])) for i in range(n)]


def test_one_key_over_several_batches(spark, small_batches):
    rows = phrase(400, 12)
    for hot in (100, 1000):
        assert result(suffixes.deduplicated(frame(spark, rows), 20, 8, hot, 1 << 10)) == brute_bytes(rows, 20)
        assert result(substrings.deduplicated(frame(spark, rows), 6, 3, hot, 1 << 10)) == brute_words(rows, 6)


def test_hot_keys_are_refined_by_their_texts(spark, small_batches):
    rows = phrase(400, 12)

    def resolve(texts, doc, seq, start, weight):
        assert len(texts) <= 100, f"{len(texts)} texts under one key"
        return suffixes.seen_before(texts, doc, seq, start, weight, 20)

    docs = windows.prepared(frame(spark, rows))
    marks = windows.marked(docs, windows.Kind(20, 8, False), True, resolve, 100, 1)
    assert marks.count() > 0


def test_no_texts():
    none = np.empty(0, np.int64)
    assert suffixes.seen_before([], none, none, none, none) == []


def test_empty(spark):
    docs = frame(spark, [(1, "x")]).filter("doc_id > 1")
    assert substrings.deduplicated(docs).count() == 0
    assert suffixes.deduplicated(docs).count() == 0


def test_automaton_counts():
    rnd = random.Random(0)
    for _ in range(50):
        texts = [[rnd.choice("ab") for _ in range(rnd.randint(1, 30))] for _ in range(rnd.randint(1, 5))]
        weights = [rnd.randint(1, 2) for _ in texts]
        automaton = substrings.SuffixAutomaton(texts, weights)

        def times(w):
            return sum(k * sum(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1)) for t, k in zip(texts, weights))

        for t in texts:
            for i, m in enumerate(automaton.matching_statistics(t)):
                want = max((n for n in range(i + 2) if n == 0 or times(t[i + 1 - n : i + 1]) >= 2), default=0)
                assert m == want


def test_window_buckets():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        texts = [bytes(rnd.integers(97, 99, int(rnd.integers(1, 80))).astype(np.uint8)) for _ in range(6)]
        window = int(rnd.integers(1, 40))
        end = np.concatenate([np.full(len(t), e) for t, e in zip(texts, np.cumsum([len(t) for t in texts]))])
        whole = b"".join(texts)
        at, pointer = suffixes.window_buckets(np.frombuffer(whole, np.uint8), end, window)
        assert at.tolist() == [i for i in range(len(whole)) if i + window <= end[i]]
        groups = collections.defaultdict(set)
        for i, p in zip(at, pointer):
            groups[whole[i : i + window]].add(int(p))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(set(), *groups.values())) == len(groups)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_runs_hold_every_window_once(monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rnd = np.random.default_rng(1)
    texts = [bytes(rnd.integers(97, 100, int(n)).astype(np.uint8)) for n in rnd.integers(0, 300, 30)]
    kind = windows.Kind(25, 7, False)
    symbols, begins = kind.symbols(texts)
    seen = collections.Counter()
    for doc, _, _, start, n, _ in windows.find_runs(symbols, begins, kind):
        for d, s, m in zip(doc, start, n):
            seen.update((int(d), int(s) + k) for k in range(m))
    assert seen == collections.Counter((d, i) for d, t in enumerate(texts) for i in range(len(t) - 24))
