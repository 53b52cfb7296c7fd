"""Operator 7, toxicity: a classifier chain.

The categories (label columns) are predicted one after another. Each has a
linear model (logistic regression) over the whole text and the log-odds of the
categories before it. For training, those earlier log-odds are out-of-fold:
each row's come from a model that has not seen its fold, so later models learn
from predictions as good as they will get. Folds follow the text.

A text's units are its words, lower-cased, their beginnings (``PREFIXES``
letters), and its single symbols; features are whether a unit occurs at least
1, 2 or 4 times, and whether it makes up at least 1/200 or 1/50 of the text.
The features kept are those whose counts differ between the values of any
category by a likelihood ratio of at least ``RATIO``; the text's length is one
more feature.

The models are fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hash of doc_id, and of those on the first ``SAMPLE_BYTES`` bytes of
texts (documented bounds; fewer: all), one row of each doc_id and each distinct
text once. They train in one task, a bounded one, and only their weights (at
most ``FEATURES`` features) reach the driver. Every document is then scored by
its whole text, with no shuffle.

Defined results: a null or empty text is scored by the intercept alone; label
rows without a document, and null labels, are not trained on; repeated label
rows train again; without labels of both values a category's probability is
the share of the value there is (no labels: 0); repeated documents are scored
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravenhunt.llm.common import Memo, tidied, with_computed
from ravenhunt.session import scratch_table

SAMPLE, FEATURES, MIN_DOCS, RATIO, FOLDS, RIDGE = 8_000, 20_000, 4, 30.0, 5, 0.3
THRESHOLD = 0.5
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 22  # for the first count of features
PREFIXES, LEVELS, RATES, MEMO = (4, 5, 6, 7), (1, 2, 4), (200, 50), 32 << 20
_UNITS = re.compile(r"[^\W\d_]+|[^\w\s]").findall


def units_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def features_of(counts: dict[str, int], n: int) -> Iterator[str]:
    """The features of a text of ``n`` words and symbols, from its units' counts."""
    for u, k in counts.items():
        yield from (f"{u} {level}" for level in LEVELS if k >= level)
        yield from (f"{u} 1/{rate}" for rate in RATES if k * rate >= n)


class Reader:
    """The features of texts, among those in ``index`` (None: all)."""

    def __init__(self, index: dict[str, int] | None):
        self.index, self.memo = index, Memo(MEMO)
        self.units = index and {u: u for u in (f.rpartition(" ")[0] for f in index)}

    def __call__(self, text: str | None) -> tuple[list, float]:
        words = Counter(_UNITS((text or "").lower()))
        counts: dict[str, int] = defaultdict(int)
        for w, k in words.items():
            units = self.memo.get(w)
            if units is None:
                units = units_of(w)
                if self.units is not None:
                    units = [self.units[u] for u in units if u in self.units]  # one object for each unit
                    self.memo.put(w, units, len(w) + 8 * len(units))
            for u in units:
                counts[u] += k
        n = words.total()
        found = features_of(counts, n)
        if self.index is not None:
            found = sorted(self.index[f] for f in found if f in self.index)
        return list(found), float(np.log1p(n))


class Rows:
    """Sparse 0/1 rows with dense extra columns."""

    def __init__(self, index: list[np.ndarray], width: int):
        self.at = np.concatenate([*index, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(index)), [len(x) for x in index])
        self.n, self.width = len(index), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.width)


def fit(rows: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (words, extras, intercept) of a ridge logistic regression, by limited-memory BFGS."""
    k, total = extra.shape[1], weight.sum()
    if not total or not 0 < (weight * y).sum() < total:
        share = (weight * y).sum() / total if total else 0.0
        return np.r_[np.zeros(rows.width + k), np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)]

    def loss(w):
        z = rows.dot(w[: rows.width]) + extra @ w[rows.width : -1] + w[-1]
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w[:-1] ** 2).sum()
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        return value, np.r_[rows.back(g) + ridge * w[: rows.width], extra.T @ g + ridge * w[rows.width : -1], g.sum()]

    w = np.zeros(rows.width + k + 1)
    value, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(150):
        d, used = -g, []
        for s, t in reversed(pairs):
            a = (s @ d) / (s @ t)
            d = d - a * t
            used.append(a)
        if pairs:
            s, t = pairs[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), a in zip(pairs, reversed(used)):
            d = d + s * (a - (t @ d) / (s @ t))
        step = 1.0 if pairs else 1 / max(1.0, np.abs(g).max())
        while step > 1e-10:
            new, new_g = loss(w + step * d)
            if new <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (step * d) @ (new_g - g) > 1e-12:
            pairs = [*pairs[-9:], (step * d, new_g - g)]
        w, done = w + step * d, value - new < 1e-7 * max(1.0, abs(value))
        value, g = new, new_g
        if done:
            break
    return w


def ratios(t: np.ndarray, a: np.ndarray, n: int, p: float) -> np.ndarray:
    """Likelihood ratio of features in ``t`` of ``n`` texts, ``a`` of them among the ``p`` of a category."""
    out = np.zeros(len(t))
    for seen, expected in ((a, t * p / n), (t - a, t * (n - p) / n), (p - a, (n - t) * p / n), (n - t - p + a, (n - t) * (n - p) / n)):
        out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def telling(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The features that tell the values of some category apart, at most
    ``FEATURES``; each text's among them; the texts' sizes.

    Features are counted twice: by hash first, in ``BUCKETS`` counters, which
    shows which can be in ``MIN_DOCS`` texts at all; then by name, only those.
    So no more than numbers is held for most features of a text."""
    read, coarse = Reader(None), np.zeros(BUCKETS, np.int32)

    def buckets(found: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, found), np.int64, len(found)) & (BUCKETS - 1)

    for t in texts:
        coarse[np.unique(buckets(read(t)[0]))] += 1
    number: dict[str, int] = {}
    held, sizes = [], []
    for t in texts:
        found, size = read(t)
        often = (coarse[buckets(found)] >= MIN_DOCS).tolist()
        held.append(np.array([number.setdefault(f, len(number)) for f, keep in zip(found, often, strict=True) if keep], np.int32))
        sizes.append(size)
    best = np.zeros(len(number))
    total = sum((np.bincount(f, minlength=len(number)) for f in held), np.zeros(len(number), np.int64))
    for y in labels.T:
        known = np.flatnonzero(~np.isnan(y))
        n, p = len(known), float(np.nansum(y))
        if not 0 < p < n:
            continue
        with_it, every = np.zeros(len(number)), np.zeros(len(number))
        for i in known:
            every[held[i]] += 1
            with_it[held[i]] += y[i]
        r = ratios(every, with_it, n, p)
        best = np.maximum(best, np.where((r >= RATIO) & (total >= MIN_DOCS), r, 0))
    names = list(number)
    chosen = sorted(sorted(np.flatnonzero(best > 0).tolist(), key=lambda i: (-best[i], names[i]))[:FEATURES], key=names.__getitem__)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    return [names[i] for i in chosen], [np.sort(x[x >= 0]) for x in (place[f] for f in held)], np.array(sizes)


def fit_chain(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> tuple[list[str], np.ndarray]:
    """Features and one row of weights per category (features, length, one
    weight per category for its log-odds, intercept). ``labels`` has NaN where
    unknown."""
    features, found, sizes = telling(texts, labels)
    rows = Rows(found, len(features))
    fold = np.array([xxhash.xxh64_intdigest((t or "").encode()) % folds for t in texts])
    known = ~np.isnan(labels)
    n, k = labels.shape
    extra, out = sizes.reshape(n, 1), []

    def scores(w):
        return rows.dot(w[: rows.width]) + extra @ w[rows.width : -1] + w[-1]

    for c in range(k):
        y = np.nan_to_num(labels[:, c])
        w = fit(rows, extra, y, known[:, c].astype(float))
        out.append(np.r_[w[:-1], np.zeros(k - c), w[-1]])
        held_out = np.zeros(n)
        for f in range(folds):
            apart = fold == f
            held_out[apart] = scores(fit(rows, extra, y, (known[:, c] & ~apart).astype(float)))[apart]
        extra = np.c_[extra, np.clip(held_out, -20, 20)]
    return features, np.array(out).reshape(k, len(features) + 1 + k + 1)


def chain_scores(read: Reader, text: str | None, weights: np.ndarray) -> list[float]:
    """Probabilities of the categories, in the chain's order."""
    at, size = read(text)
    width = len(read.index)
    base = weights[:, at].sum(1) + weights[:, width] * size + weights[:, -1]
    odds: list[float] = []
    for c in range(len(weights)):
        odds.append(float(np.clip(base[c] + sum(weights[c, width + 1 + i] * o for i, o in enumerate(odds)), -20, 20)))
    return [1 / (1 + np.exp(-o)) for o in odds]


def trained(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The chain fitted on ``labels`` (doc_id and a 0/1 column per category)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)])
    rows = rows.filter("label_id is not null").orderBy(F.xxhash64("label_id"), *rows.columns).limit(sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text", *ys).alias("row"))
    rows = scratch_table(rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.*"), "sample")  # at most `sample` rows
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).filter(F.coalesce("bytes", F.lit(0)) <= SAMPLE_BYTES).select("doc_id", "text", *ys)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        seen = Counter(t.column("text").to_pylist())
        t = t.filter(pa.array([bool(seen.pop(x, 0)) for x in t.column("text").to_pylist()]))  # each text once
        y = np.stack([t.column(f"y{i}").to_numpy().astype(float) for i in range(len(categories))], axis=1)
        features, weights = fit_chain(t.column("text").to_pylist(), y)
        yield pa.RecordBatch.from_arrays([pa.array([features], pa.list_(pa.string())), pa.array([weights.ravel().tolist()])], names=["features", "weights"])

    model = rows.repartition(1).mapInArrow(tidied(train), "features array<string>, weights array<double>").collect()
    if not model:
        return [], np.c_[np.zeros((len(categories), 1 + len(categories))), np.full(len(categories), -20.0)]
    return model[0]["features"], np.array(model[0]["weights"]).reshape(len(categories), -1)


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray], categories: list[str]) -> DataFrame:
    """Each row of ``docs`` (as ``_row``) and the probability ``p_<category>`` of each category."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in categories]
    readers: list[Reader] = []  # one per task

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        features, weights = shared.value
        if not readers:
            readers.append(Reader({f: i for i, f in enumerate(features)}))
        p = np.array([chain_scores(readers[0], t.as_py(), weights) for t in texts], float).reshape(-1, len(weights))
        return {name: pa.array(np.ascontiguousarray(x)) for name, x in zip(names, p.T, strict=True)}

    return with_computed(docs, compute, ", ".join(f"{n} double" for n in names))


def toxic_documents(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (as ``_row``), its probabilities along the chain,
    and whether the last category's passes the threshold."""
    categories = list(categories)
    rows = scored(docs, trained(docs, labels, categories), categories)
    return rows.withColumn(f"is_{categories[-1]}", F.col(f"p_{categories[-1]}") > threshold)
