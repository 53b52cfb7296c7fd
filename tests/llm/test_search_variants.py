"""Ranked search (11) and spelling variants (13) against plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ravenhunt.llm import ranked, variants
from tests.llm.cases import awkward, frame, prose

# --- operator 11 ------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [m.translate(LOWER) for m in TERM.findall(text or "")]


def plain_search(docs, items, k):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for d, c in found:
            m = 100 - 25 + (25 * c.total() * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        out += [(item_id, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, prose(60, 40)), (2, "the THE of"), (3, None), (4, ""), (5, "日本語の文章 one Σίσυφος"), (5, "naïve x1y2 42"), (5, "naïve x1y2 42"), (None, "the end."), (7, "nothing.here_at-all")]


@pytest.mark.parametrize("block", [1, 300, ranked.BLOCK])
def test_ranked_search(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as row", "2 as block", "3 as doc_id", "4 as rank").repartition(3)
    got = ranked.ranked_search(frame(spark, awkward()), items, k=7, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(awkward(), ITEMS, 7)


def test_small_steps_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked, "STEP", 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.ranked_search(frame(spark, awkward()), items, k=20)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(awkward(), ITEMS, 20)


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), (awkward(), []), ([(1, None), (2, " ")], ITEMS), ([(1, "a")], [(1, "b")])])
def test_nothing_to_find(spark, docs, items):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.ranked_search(docs, items).collect() == []


def test_heaps_keep_ties_by_document():
    heaps = ranked.Heaps(1, 3)
    heaps.offer(np.array([[5], [5], [0], [9], [5]]), np.array([8, 3, 1, 4, 2]))
    heaps.offer(np.array([[5], [4]]), np.array([1, 0]))
    assert sorted(heaps.held[0], reverse=True) == [(9, -4), (5, -1), (5, -2)]


# --- operator 13 ------------------------------------------------------------
def plain_words(docs, min_length=6, min_count=5):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    rows, form = [], {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        rows.append((w, n, len(others)))
    out = []
    for w, n, n_near in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near, form[w] and words[form[w]]))
    return sorted(out)


def spelt(seed=1):
    """Texts of few words in many spellings, some common, some rare."""
    import random

    rnd, rows = random.Random(seed), []
    base = ["tionaal", "aaaaaa", "éclairs", "straßen", "the", "Àbcdefg", "abababab"]
    spellings = list(base)
    for w in base * 12:
        i, letter = rnd.randrange(len(w) + 1), rnd.choice("aabtéÿÀ")
        spellings += [w[:i] + letter + w[i:], w[:i] + w[i + 1 :], w[:i] + letter + w[i + 1 :]]
    spellings += ["x" * 700, "x" * 701, "x" * 350 + "y" + "x" * 349]
    for d in range(400):
        rows.append((d, " ".join(rnd.choice(spellings) if rnd.random() < 0.6 else rnd.choice(base).upper() for _ in range(12))))
    return rows


@pytest.mark.parametrize("rows", [awkward(), spelt(), spelt(2) + [(None, "tionaal tionaal"), (7, None), (7, "")]])
def test_spelling_variants(spark, rows):
    got = variants.spelling_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(rows)


def test_chains_end_at_their_root(spark):
    chain = ["abcdef" + "ghi"[:k] for k in range(4)]
    rows = [(d, " ".join([w] * 6 ** (4 - d))) for d, w in enumerate(chain)]
    exp = plain_variants(rows)
    assert {r[2] for r in exp} == {"abcdef"} and len(exp) == 4
    assert sorted(map(tuple, variants.spelling_variants(frame(spark, rows)).collect())) == exp


def test_no_words(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, "few words here")], "doc_id long, text string")).collect() == []


def test_nodes_are_prefixes(spark):
    """Equal numbers stand for equal prefixes, over all partitions."""
    words = sorted({w for r in spelt(3) for w in r[1].lower().split()})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for reverse in (False, True):
        rows = variants.trie_nodes(df, reverse, 800).collect()
        seen = {}
        for r in rows:
            key = r["word"][::-1] if reverse else r["word"]
            for depth, node in enumerate(r["nodes"]):
                assert seen.setdefault(node, key[:depth]) == key[:depth]
        assert len(seen) == len(set(seen.values()))
        order = [r["word"][::-1] if reverse else r["word"] for r in sorted(rows, key=lambda r: r["rank"])]
        assert order == sorted(order)
    assert len(words) == len(rows)


def test_shared_prefix():
    for a, b, n in [("", "", 0), ("a", "", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("abc", "abcd", 3), ("xbc", "abc", 0)]:
        assert variants.shared_prefix(a, b) == n
