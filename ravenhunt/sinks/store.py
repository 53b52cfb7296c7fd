"""An IOC store that can be looked up.

The store is a Parquet table bucketed by ``value`` and sorted within each
bucket. A lookup joins on ``value``, so only the values asked for are shuffled
(to the store's buckets); the store itself is read bucket by bucket, never
moved, however large it is. Appends add files to the buckets; ``compact`` writes
the table anew with one sorted file a bucket and without repeated copies.

The bucketing is part of the table's declaration, not of its files: a session
that has not written the store declares it with ``open_store`` over its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64

def append_store(iocs: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Add IOC rows (any columns with ``value``) to the store; it is made if it is not there.

    Rows go to their bucket's task first, so that a bucket gets one file an
    append and not one of every task."""
    spark = iocs.sparkSession
    rows = iocs.repartition(buckets, "value")
    rows.write.mode("append").format("parquet").option("path", path).bucketBy(buckets, "value").sortBy("value").saveAsTable(table)
    return spark.table(table)


def open_store(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The store in a folder, declared in this session."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (value) SORTED BY (value) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def compact(store: DataFrame, table: str, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The store without repeated copies (rows of equal ``keys``: the least by
    the other columns stays), as a new table in a new folder. Copies of a value
    lie in one bucket, so nothing is shuffled for it."""
    rest = [c for c in store.columns if c not in keys]
    if rest:
        least = store.groupBy("value", *[k for k in keys if k != "value"]).agg(F.min(F.struct(*rest)).alias("__rest"))
        one = least.select(*[F.col(f"__rest.{c}").alias(c) if c in rest else F.col(c) for c in store.columns])
    else:
        one = store.distinct()
    one.write.format("parquet").option("path", path).bucketBy(buckets, "value").sortBy("value").saveAsTable(table)
    return store.sparkSession.table(table)


def lookup(values: DataFrame, store: DataFrame, value_col: str = "value") -> DataFrame:
    """Every (checked value, stored IOC) pair, case-sensitive. The store's
    side of the join has no exchange; the values are broadcast if Spark finds
    them small, else shuffled to the buckets."""
    asked = values.select(F.col(value_col).alias("indicator"))
    return asked.join(store, asked["indicator"] == store["value"])
