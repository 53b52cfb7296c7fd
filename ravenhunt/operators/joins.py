"""Join helpers: broadcast only a side whose size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes that a side may have, as counted below, and still be broadcast.
BROADCAST_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` has in memory (one job over it)."""
    wide = [c for c, t in df.dtypes if t == "string" or t.startswith(("array", "map", "struct"))]
    texts = [F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`"))))), F.lit(0)) for c in wide]
    n, *sizes = df.agg(F.count(F.lit(1)), *texts).first()
    return n * 16 * len(df.columns) + sum(sizes)


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size is within ``max_bytes``, else ``df``:
    beyond the bound Spark plans a shuffle join instead."""
    return sized_local(df, table_bytes(df), max_bytes)


def sized_local(df: DataFrame, size: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same for a size that the caller knows."""
    return F.broadcast(df) if size <= max_bytes else df
