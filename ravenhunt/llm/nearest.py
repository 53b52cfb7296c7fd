"""Operator 8, approximate nearest neighbours: block matrix join.

Candidates are dealt into blocks of about ``BLOCK`` rows, queries too, and each
pair of blocks is one tile of the (queries x candidates) matrix. In a tile the
unit vectors are quantised to int8 with a scale each; the product of the
integer matrices is exact, and the known quantisation errors bound the cosine
from both sides: |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|. A pair survives
if its upper bound reaches the k-th best lower bound of its query; survivors
are computed again in double precision from the original vectors, and a heap
keeps each query's best k. The heaps of a query's tiles are merged by a window
over k rows a tile. Nothing is lost to the quantisation, so recall is 1.

Copies: of the candidates of a tile with equal vectors only the k + 1 smallest
ids can be among any query's nearest (ties go to the smaller id), so only these
are scored.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length
are no candidates of each other; repeated rows of one id and vector count
once, and a query never finds its own id; an empty table gives an empty
result; only the id and the vector are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ravenhunt.session import scratch_table

BLOCK = 4096


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, exact in products), scales, lengths of the coded vectors, error lengths."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    coded = codes * scale[:, None]
    slack = 1e-12  # for the roundings of these very figures
    return codes.astype(np.int8), scale, np.linalg.norm(coded, axis=1) + slack, np.linalg.norm(unit - coded, axis=1) + slack


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Correctly rounded sum of products, so equal vectors give equal scores wherever they stand."""
    return math.fsum((a * b).tolist())


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score): each query's k nearest of one tile."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    _, same = np.unique(c, axis=0, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    runs = same.ravel()[by]
    start = np.searchsorted(runs, runs)
    keep = np.sort(by[np.arange(len(by)) - start <= k])
    c_ids, c = c_ids[keep], c[keep]
    qc, qs, ql, qe = quantise(q / np.linalg.norm(q, axis=1)[:, None])
    cc, cs, _, ce = quantise(c / np.linalg.norm(c, axis=1)[:, None])
    whole = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers stay exact in the product
    cc = cc.astype(whole).T
    q_norm, c_norm = [math.sqrt(dot(x, x)) for x in q], [math.sqrt(dot(x, x)) for x in c]
    for i in range(0, len(q), 256):
        part = slice(i, i + 256)
        near = (qc[part].astype(whole) @ cc).astype(np.float64) * qs[part, None] * cs[None, :]
        error = qe[part, None] + ql[part, None] * ce[None, :] + 1e-12
        low = near - error
        own = c_ids[None, :] == q_ids[part, None]
        low[own] = -np.inf
        kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
        survives = (near + error >= kth[:, None]) & ~own
        for j in range(len(low)):
            at = np.flatnonzero(survives[j])
            best = heapq.nlargest(k, ((dot(q[i + j], c[m]) / (q_norm[i + j] * c_norm[m]), -int(c_ids[m])) for m in at))
            for score, minus in best:
                yield int(q_ids[i + j]), -minus, score


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine & some)
    # very large or small ones by a power of two, which changes no cosine, so that no square leaves a double's range
    top = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), -F.floor(F.least(F.greatest(F.log2(top), F.lit(-1000.0)), F.lit(1000.0))))
    safe = F.when(top.between(1e-100, 1e100), v).otherwise(F.transform(v, lambda x: x * power))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), safe.alias("v"), F.size(v).alias("dim")).distinct()


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every ``every``-th id."""
    rows = scratch_table(usable(vectors, id_col, vector_col), "vectors")
    query = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(query, 1))).first()
    n_blocks, m_blocks = max(1, -(-n // block)), max(1, -(-m // block))

    def own(col, blocks):
        return F.pmod(F.xxhash64(F.lit(col), F.col("vec_id"), F.col("v")), F.lit(blocks)).cast("int")

    def every_block(blocks):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    cand = rows.select("vec_id", "v", "dim", own("c", n_blocks).alias("c"), every_block(m_blocks).alias("q"))
    asks = rows.filter(query).select("vec_id", "v", "dim", own("q", m_blocks).alias("q"), every_block(n_blocks).alias("c"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        return ids, table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(tile_nearest(*matrix(left), *matrix(right), k))
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    tiles = asks.groupBy("dim", "q", "c").cogroup(cand.groupBy("dim", "q", "c")).applyInArrow(
        tile, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # an id with several vectors: its best score counts
    one = tiles.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
