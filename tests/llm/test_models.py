"""Classifier chain, decontamination and surrogates."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ravenhunt.llm import decontamination, surrogates, toxicity

from .cases import awkward, frame, prose

SF = "/root/testdata/sf0.001"
BAD = ["grolk", "snarf", "blunx", "wexxy"]


def labelled(n: int, seed: int = 0) -> list[tuple]:
    """(doc_id, text, rude, toxic): rude texts have bad words, toxic ones are rude and shout."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(seed + i, rnd.randint(30, 200)).split()
        rude, loud = rnd.random() < 0.4, rnd.random() < 0.5
        for _ in range(4 * rude):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        for _ in range(3 * loud):
            words.insert(rnd.randrange(len(words)), "!!")
        rows.append((i, " ".join(words), int(rude), int(rude and loud)))
    return rows


def test_chain_predicts_held_out_rows(spark):
    rows = labelled(600)
    docs = frame(spark, [(i, t) for i, t, *_ in rows] + [(i + 5000, t) for i, t in awkward() if i is not None] + [(None, "no id grolk snarf !!")])
    labels = spark.createDataFrame([(i, a, b, 1) for i, _, a, b in rows[:400]] + [(1, None, 1, 1), (None, 1, 1, 1), (99999, 1, 1, 1)], "doc_id long, rude int, toxic int, text int")
    got = {r._row.doc_id: r for r in toxicity.toxic_documents(docs, labels, categories=("rude", "toxic")).collect()}
    assert len(got) == len({i for i, *_ in rows}) + len({i for i, _ in awkward()})
    held = rows[400:]
    assert np.mean([(got[i].p_rude > 0.5) == a for i, _, a, _ in held]) > 0.97
    assert np.mean([got[i].is_toxic == b for i, _, _, b in held]) > 0.95
    assert 0 <= got[5001].p_toxic < 0.5


def test_out_of_fold_odds_feed_the_chain():
    rows = labelled(300)
    features, weights = toxicity.fit_chain([t for _, t, *_ in rows], np.array([r[2:] for r in rows], float))
    assert weights.shape == (2, len(features) + 4)
    assert weights[0, len(features) + 1] == 0 and weights[1, len(features) + 1] > 0  # toxic learns from rude


def test_chain_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(frame(spark, awkward()), labels).collect()
    assert len(got) == len(awkward()) and not any(r.is_toxic for r in got)
    one = spark.createDataFrame([(4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(frame(spark, awkward()), one).collect()
    assert all(r.p_quality > 0.9 and not r.is_toxic for r in got)
    assert toxicity.toxic_documents(frame(spark, [(1, "x")]).filter("doc_id > 1"), one).count() == 0


def test_fit_finds_the_minimum():
    rnd = np.random.default_rng(0)
    x = rnd.random((80, 6)) < 0.4
    y = (x @ np.array([2, -1, 0, 1, 0, -2]) + rnd.normal(size=80) > 0).astype(float)
    rows = toxicity.Rows([np.flatnonzero(r) for r in x], 6)
    w = toxicity.fit(rows, np.zeros((80, 0)), y, np.ones(80), 1.0)
    p = 1 / (1 + np.exp(-(x @ w[:6] + w[6])))
    assert np.abs(x.T @ (p - y) + w[:6]).max() < 0.05 and abs((p - y).sum()) < 0.05


def brute_search(index, words):
    shares = collections.Counter()
    for w in words:
        for i, s in zip(*index.postings.get(w, ([], [], []))[:2]):
            shares[i] += s
    return sorted((i, round(s, 9)) for i, s in shares.items() if s >= index.threshold - 1e-9)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6])
def test_wand_returns_all_above_the_threshold(threshold):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the"]
    items = [(i, [rnd.choice(words) for _ in range(rnd.randint(1, 12))]) for i in range(300)]
    index = decontamination.Index(items, threshold)
    for _ in range(150):
        query = {rnd.choice(words) for _ in range(rnd.randint(0, 30))}
        assert sorted((i, round(s, 9)) for i, s in index.search(query)) == brute_search(index, query)


def test_bound_keeps_every_passage_that_can_hit():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    items = [(i, [rnd.choice(words[:20] if rnd.random() < 0.5 else words) for _ in range(rnd.randint(1, 15))]) for i in range(60)]
    index = decontamination.Index(items, 0.6)
    for _ in range(30):
        text = [rnd.choice(words) for _ in range(200)]
        for _, item in rnd.sample(items, 3):
            k = rnd.randrange(200)
            text[k:k] = item
        s = index.longest
        want = {p for p in range(-(-len(text) // s)) if index.search(set(text[p * s : (p + 2) * s]))}
        assert want <= set(index.passages(text, s))


def test_contaminated(spark):
    items = [(i, prose(900 + i, 8 + i)) for i in range(30)] + [(40, None), (41, ""), (42, "!!"), (None, prose(1, 9)), (43, "solo")]
    hidden = [(2000 + i, prose(i, 300) + "\n" + items[i][1].upper() + " " + prose(i + 70, 200)) for i in range(0, 30, 3)]
    part = [(3000 + i, prose(i, 100) + " " + " ".join(items[i][1].split()[: len(items[i][1].split()) // 2]) + " " + prose(i + 70, 100)) for i in range(0, 30, 3)]
    docs = frame(spark, awkward() + hidden + part)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("rank", F.lit(1))
    for shard in (7, 20_000):
        got = decontamination.contaminated(docs, bench, shard=shard).collect()
        # document 8 begins with the words of the item without an id
        assert sorted((r.doc_id, r.item_id) for r in got) == [(8, None)] + [(2000 + i, i) for i in range(0, 30, 3)]
    assert decontamination.contaminated(docs, bench.filter("1 = 0")).count() == 0
    assert decontamination.contaminated(docs.filter("1 = 0"), bench).count() == 0


def test_contaminated_finds_the_given_leaks(spark):
    con = duckdb.connect()
    want = con.execute(f"select doc_id, item_id from '{SF}/documents.parquet' d join '{SF}/benchmark.parquet' b on contains(d.text, b.text) order by 1, 2").fetchall()
    got = decontamination.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert set(want) <= {(r.doc_id, r.item_id) for r in got} and len(got) <= len(want) + 3


PRIVATE = {
    "email": ["Jörg.Müller@Mail.example.org", "a@b.example.com", "ciónra.34@mail7.example.com"],
    "phone": ["+1 (017) 555-7713", "(555) 123-4567", "+44 20 7946 0958"],
    "ip": ["129.38.82.176", "8.8.4.4"],
    "card": ["4111 1111 1111 1111", "4845168114407329"],
    "ssn": ["123-45-6789"],
    "iban": ["DE44 5001 0517 5407 3249 31"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
    "name": ["Mrs. Anna Miller", "Herr Schmidt", "госпожа Иванова", "Κύριος Παπαδόπουλος"],
}


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0


def test_surrogates(spark):
    entities = [(k, e) for k, es in PRIVATE.items() for e in es]
    texts = [(i, f"Before {e}, and {e} again; word{i} end") for i, (_, e) in enumerate(entities)]
    texts += [(100, "write A@B.example.com or a@b.example.com, call +1 017 555 7713"), (100, "write A@B.example.com or a@b.example.com, call +1 017 555 7713")]
    texts += [(200 + i, t) for i, t in awkward() if i is not None]
    docs = frame(spark, texts)
    rows = surrogates.anonymised(docs, "k1").collect()
    assert len(rows) == len(texts) and set(docs.columns) < set(rows[0].asDict())
    new = {r.doc_id: r for r in rows}
    seen = set()
    for i, (kind, e) in enumerate(entities):
        assert new[i].n_entities == 2 and e not in new[i].text, (kind, e, new[i].text)
        m = re.fullmatch(rf"Before (.+), and (.+) again; word{i} end", new[i].text)
        assert m and m[1] == m[2]
        s = m[1]
        seen.add(s)
        if kind == "secret":
            assert re.fullmatch("[0-9a-f]{40}", s)
        elif kind != "name":
            assert [c.isdigit() for c in s] == [c.isdigit() for c in e] and [c.isupper() for c in s] == [c.isupper() for c in e]
        if kind == "card":
            assert luhn(s) == luhn(e)
        if kind == "ip":
            assert all(int(o) < 256 for o in s.split("."))
    assert len(seen) == len(entities)
    assert re.match(r"Mrs\. [A-Z][a-z]+na [A-Z][a-z]+na$", re.search("Before (.+), and", new[13].text)[1])
    pair = re.fullmatch(r"write (\S+) or (\S+), call (.+)", new[100].text)
    assert pair[1].lower() == pair[2].lower() and pair[1] != pair[2]
    call = re.search(r"Before (.+), and", new[3].text)[1]
    assert re.sub(r"\D", "", call) == re.sub(r"\D", "", pair[3]) and call.startswith("+1 ")
    assert {(r.doc_id, r.text) for r in rows if r.doc_id >= 200} == {(i, t) for i, t in texts if i >= 200}
    assert {r.text for r in surrogates.anonymised(docs, "k1").collect()} == {r.text for r in rows}
    assert surrogates.anonymised(docs, "k2").filter("doc_id = 0").first().text != new[0].text


def test_surrogates_stay_distinct(spark):
    ips = [f"1.2.{a}.{b}" for a in range(10) for b in range(10)] + [f"{a}.{b}.3.4" for a in range(1, 10) for b in range(10)]
    docs = spark.createDataFrame([(i, f"at {ip} now") for i, ip in enumerate(ips)], "doc_id long, text string")
    got = {r.doc_id: r.text.split()[1] for r in surrogates.anonymised(docs, "k").collect()}
    by_ip = collections.defaultdict(set)
    for i, ip in enumerate(ips):
        by_ip[ip].add(got[i])
    assert all(len(s) == 1 for s in by_ip.values())
    assert len({s for x in by_ip.values() for s in x}) == len(by_ip)
    assert not {s for x in by_ip.values() for s in x} & set(ips)


def test_short_formats_widen_until_surrogates_are_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Mr {a.upper()}{b}{c}" for a in letters for b in letters for c in letters][:5000]
    mails = [f"{a}@{b}.co" for a in letters for b in letters]
    entities = spark.createDataFrame([(x,) for x in [*names, *mails, "Q@Z.CO"]], "entity string")
    got = {r.entity: r.surrogate for r in surrogates.surrogate_table(entities, "k").collect()}
    assert got.pop("Q@Z.CO") == got["q@z.co"].upper()
    assert set(got) == {*names, *mails} and len(set(got.values())) == len(got)
    assert not set(got) & set(got.values())
    assert all(got[x].startswith("Mr ") for x in names)
    assert all(re.fullmatch(r"[a-z]{2,}@[a-z]\.co", got[x]) for x in mails)


def test_surrogates_of_an_empty_table(spark):
    assert surrogates.anonymised(frame(spark, [(1, "x")]).filter("doc_id > 1"), "k").count() == 0


def test_every_one_word_edit_of_an_item_is_found():
    rnd = random.Random(5)
    items = [(i, [f"w{rnd.randrange(400)}" for _ in range(n)]) for i, n in enumerate([15, 16, 18, 21, 27, 38, 51, 60])]
    index = decontamination.Index(items, decontamination.THRESHOLD)
    for i, ws in items:
        for k in range(len(ws)):
            for edited in (ws[:k] + ["other"] + ws[k + 1 :], ws[:k] + ws[k + 1 :], ws[:k] + ["more"] + ws[k:]):
                text = " ".join([f"v{rnd.randrange(400)}" for _ in range(40)] + edited + [f"v{rnd.randrange(400)}" for _ in range(40)])
                assert i in {h[0] for h in index.hits(text, decontamination.OVERLAP)}, (i, k)


def test_hits_do_not_depend_on_shards(spark):
    """Scores are those of all items, however many shards they are dealt into; items without an id count."""
    items = [(i, prose(900 + i, 12 + i % 9)) for i in range(40)] + [(None, prose(999, 30))]
    docs = spark.createDataFrame([(i, prose(i, 60) + " " + items[i][1] + " " + prose(i + 90, 60)) for i in range(41)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(repr, decontamination.contaminated(docs, bench, shard=shard).collect())) for shard in (5, 17, 1000)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) >= 41
    assert decontamination.clean(docs, bench, shard=9).count() == 0


def test_long_entities_and_clashing_names(spark):
    secret, mail = "a1" * 300, "x" * 200 + "@host.example.com"
    docs = spark.createDataFrame([(1, f"see {secret} and {mail}."), (2, "none"), (3, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "9 as n_entities", "'f' as __found", "'t' as __text", "'m' as _map", "'k' as _key", "'r' as _row", "5 as _entities")
    got = {r.doc_id: r for r in surrogates.anonymised(docs, "k").collect()}
    assert secret not in got[1].text and mail not in got[1].text and len(got[1].text) == len(f"see {secret} and {mail}.")
    assert [got[i].n_entities for i in (1, 2, 3)] == [2, 0, 0] and got[3].text is None and got[2]._map == "m"
    from corpus_pipeline import private

    kept = private(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.n_entities, r._entities) for r in kept.collect()) == [(1, 9, 5), (2, 9, 5), (3, 9, 5)]


def test_nearest_of_very_large_and_small_vectors(spark):
    from ravenhunt.llm.nearest import nearest

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    scale = 10.0 ** rng.choice([-300, -200, 0, 150, 200, 300], size=60)
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, scale))]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect()
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    for q in range(0, 60, 10):
        want = [i for i in np.argsort(-(unit @ unit[q]), kind="stable").tolist() if i != q][:3]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want
        assert np.allclose([r.score for r in mine], [unit[q] @ unit[i] for i in want])
