"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravenhunt.session import drop_scratch, read_table, scratch_table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every document (other columns are never read)."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


class Memo(dict):
    """What a worker remembers, in about ``most`` bytes: when they are used up,
    the older half of the entries goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used = most, 0

    def put(self, key, value, size: int) -> None:
        """``size``: the entry's bytes besides some 200 of the dictionary's and the objects' own."""
        size += 200
        if self.used + size > self.most:
            for old in list(islice(self, -(-len(self) // 2))):
                del self[old]
            self.used //= 2
        if self.used + size <= self.most:
            self.used += size
            self[key] = value


def give_back() -> None:
    """What this process has freed goes back to the system: objects in cycles,
    Arrow's pool, and the C library's free blocks (where it is glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker stays small between its tasks: a
    worker outlives its stage, and the next ones share the executor with it."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def with_rank(df: DataFrame, keys: list[str], order: list[str | Column], out: str, buckets: int | None = None) -> DataFrame:
    """Gapless rank from 0 of every row within its group, of any group size.

    Rows go to ``buckets`` hash buckets of the ``order`` columns; a row's rank
    is the number of rows in earlier buckets of its group plus its place in
    its bucket. So no task sorts more than a bucket, however large a group is
    (and the rank follows the buckets, not the order columns)."""
    buckets = buckets or max(64, 2 * partitions(df.sparkSession))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    same = F.col("_b") == F.col("_b2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*cols))
    return (df.withColumn("_p", place).join(offsets, same)
            .withColumn(out, F.col("_o") + F.col("_p") - 1)
            .drop("_b", "_b2", "_o", "_p", *[f"_k{i}" for i in range(len(keys))]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest
    node it is connected to. Large-star and small-star rounds (Kiveris et al.
    2014), each written to the shared folder, until the edges no longer
    change; only two numbers per round reach the driver. A node with very many
    neighbours is a minimum aggregated before the shuffle and one join key,
    which adaptive execution can split."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, seen = scratch_table(e, "edges"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("n", "m"))
        new = scratch_table(small.filter("a <> b").distinct(), "edges")
        drop_scratch(e)
        e = new
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select("b", "b").distinct())


def with_computed(docs: DataFrame, compute: Callable[[pa.Array], dict[str, pa.Array]], fields: str) -> DataFrame:
    """(_row, *fields): every row of ``docs`` whole, with what ``compute`` makes of
    its texts (null for null). No name of ``docs`` can clash with a field."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = StructType([rows.schema["_row"], *StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *made.values()], names=["_row", *made])

    return rows.mapInArrow(tidied(run), schema)
