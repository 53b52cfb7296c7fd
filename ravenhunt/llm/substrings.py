"""Operator 2, substring deduplication over words: suffix automata.

Every word covered by a window of ``WINDOW`` words that also starts anywhere
else goes, first occurrences included. ``windows.marked`` settles the runs of
windows whose whole text repeats; what is left are anchors with several texts
around them. Those texts are the reference: they meet by anchor, in shards of
bounded size, and each shard gets a generalised suffix automaton whose states
know how often their words occur. The documents' texts are streamed through it
for matching statistics: at each word, the longest match that occurs at least
twice. Where it reaches the window's length, the window ending there is
removed; windows in a row give maximal spans.

An automaton goes only to the tasks whose texts can match it (by the shuffle
key), not to all: all shards together grow with the corpus, so a broadcast
would have no bound.

Defined results: a null text has no words; texts shorter than a window lose
nothing; repeated rows (also of one doc_id) are documents of their own, so each
is a copy of the other; an empty table gives an empty result; only doc_id and
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

WINDOW, GRAM = 35, 12
SHARD, HOT = 1 << 18, 2_000  # bytes of text in an automaton; different texts under one key


class SuffixAutomaton:
    """Generalised suffix automaton of sequences; ``times`` counts the occurrences of each state's words."""

    def __init__(self, sequences: list[list], weights: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]
        for words, weight in zip(sequences, weights, strict=True):
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.times[last] += weight
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.times[self.link[v]] += self.times[v]

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.times.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, w, q: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, p: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[p]:
            q = nxt[p][w]
            return q if length[q] == length[p] + 1 else self._clone(p, w, q)
        new = self._state({}, 0, length[p] + 1)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def matching_statistics(self, words: list, least: int = 2) -> Iterator[int]:
        """At each word, the length of the longest match ending there that occurs ``least`` times."""
        v, n = 0, 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                n += 1
            u = v
            while u > 0 and self.times[u] < least:
                u = self.link[u]
            yield n if u == v else self.length[max(u, 0)]


def repeated(texts: list[bytes], doc, seq, start, weight: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Which windows of each text occur at least twice among all texts."""
    split = [t.split() for t in texts]
    automaton = SuffixAutomaton(split, weight.tolist())
    return [np.fromiter((m >= window for m in automaton.matching_statistics(words)), bool, len(words))[window - 1 :] for words in split]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of ``docs`` (doc_id, text): kept is
    the remaining words, joined by one space, as UTF-8 bytes."""
    docs = prepared(docs)
    gram = min(gram, window)
    marks = marked(docs, Kind(window, gram, True), False, partial(repeated, window=window), hot, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                words, marks = unpress.decompress(batch.column("z")[i].as_py()).split(), batch.column("marks")[i].as_py()
                gone = covered(len(words), np.array(marks or [], np.int64), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if marks else words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), pa.array([len(words)], pa.int64()), pa.array([int(gone.sum())], pa.int64()), pa.array([kept], pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return by_document(docs, marks).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
