"""P15, P16, A19, A20 and run metrics: table profiles and type narrowing.

Each profile is a global ``agg`` with partial aggregation on every
partition. ``column_profile(exact=False)`` uses HyperLogLog sketches
(``approx_count_distinct``), fixed-size state per partition; ``exact=True``
adds one column-pruned distinct aggregate per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference's behaviour) -------------------
CATEGORY_RATIO = 0.5  # text columns with a unique ratio below this -> category
INT_RANGES = [("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1)]
MAX_ROWS = 1_000_000
MAX_BYTES = 500 * 1024 * 1024
# ----------------------------------------------------------------------------

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, _INTS):
        return "int"
    if isinstance(dt, _FLOATS):
        return "float"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column rows, distinct values, unique ratio, min, max (as text)
    and the narrowed type P15 would pick. Long form, one row per column.

    Counts, minima and maxima come from one global aggregate. Distinct counts
    are exact per column (``exact=True``): one aggregate per column that reads
    only that column and pre-aggregates on every partition, so no row is
    copied once per column; ``exact=False`` uses HyperLogLog in the same pass.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if _kind(f.dataType) in ("int", "float", "text") or isinstance(
            f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)
        ):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        else:
            aggs += [F.lit(None).cast("string").alias(f"lo{i}"), F.lit(None).cast("string").alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                (F.col(f"d{i}") if not exact else F.lit(None).cast("long")).alias("distinct_count"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.lit(_kind(f.dataType)).alias("kind"),
            )
        )
    long = wide.select(F.col("__rows").alias("row_count"), F.inline(F.array(*rows)))
    if exact:
        parts = [
            df.select(F.col(f"`{f.name}`").alias("v")).distinct()
            .agg(F.count("v").alias("distinct_count")).select(F.lit(f.name).alias("column_name"), "distinct_count")
            for f in fields
        ]
        distinct = parts[0]
        for p in parts[1:]:
            distinct = distinct.unionByName(p)
        long = long.drop("distinct_count").join(distinct, "column_name")
    ratio = F.when(F.col("row_count") > 0, F.col("distinct_count") / F.col("row_count"))
    return long.withColumn("unique_ratio", F.round(ratio, 6)).withColumn(
        "suggested_type", suggested_type(F.col("kind"), F.col("min_value"), F.col("max_value"), F.col("unique_ratio"),
                                         F.col("data_type"))
    ).drop("kind")


def suggested_type(kind: Column, lo: Column, hi: Column, ratio: Column, current: Column) -> Column:
    """Smallest integer type holding [min, max]; float for doubles;
    'category' (dictionary-encoded text) when fewer than half are unique."""
    lo_n, hi_n = lo.try_cast("long"), hi.try_cast("long")
    int_type = F.lit("bigint")
    for name, a, b in reversed(INT_RANGES):
        int_type = F.when((lo_n >= a) & (hi_n <= b), F.lit(name)).otherwise(int_type)
    return (
        F.when(kind == "int", F.when(lo_n.isNull(), current).otherwise(int_type))
        .when(kind == "float", F.lit("float"))
        .when((kind == "text") & (ratio < CATEGORY_RATIO), F.lit("category"))
        .otherwise(current)
    )


def narrow_types(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Rewrite the table with the suggested types (category stays text;
    Parquet dictionary-encodes it). The profile is a one-row-per-column
    result, so collecting it is bounded by the column count."""
    prof = profile if profile is not None else column_profile(df, exact=False)
    chosen = {r["column_name"]: r["suggested_type"] for r in prof.select("column_name", "suggested_type").collect()}
    cols = []
    for f in df.schema.fields:
        t = chosen.get(f.name)
        c = F.col(f"`{f.name}`")
        if t in ("tinyint", "smallint", "int", "bigint") and isinstance(f.dataType, _INTS):
            cols.append(c.cast(t).alias(f.name))
        elif t == "float" and isinstance(f.dataType, _FLOATS):
            cols.append(c.cast("float").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def size_profile(df: DataFrame) -> DataFrame:
    """Rows and text bytes per column plus a total row; flags the
    reference's limits (1M rows, 500 MB) instead of aborting."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`").cast("string"))), F.lit(0)).cast("long")
                    .alias(f"b{i}"))
    wide = df.agg(*aggs)
    parts = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"b{i}").alias("bytes"))
        for i, f in enumerate(df.schema.fields)
    ]
    total = sum((F.col(f"b{i}") for i in range(len(df.schema.fields))), F.lit(0).cast("long"))
    parts.append(F.struct(F.lit("__total__").alias("column_name"), total.alias("bytes")))
    long = wide.select(F.col("__rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
                       F.inline(F.array(*parts)))
    return long.withColumn(
        "over_limit",
        (F.col("column_name") == "__total__") & ((F.col("row_count") > MAX_ROWS) | (F.col("bytes") > MAX_BYTES)),
    )


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Run metrics without an extra job: rows and max risk collected as the
    DataFrame is consumed (``Observation.get`` after the action)."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("row_count")]
    if "risk_score" in df.columns:
        metrics.append(F.max("risk_score").alias("max_risk"))
    return df.observe(obs, *metrics), obs


def structured_events(df: DataFrame, fields: dict[str, Column], extras: dict[str, Column]) -> DataFrame:
    """One JSON record per row; extras appear only when not null."""
    record = F.struct(*[c.alias(k) for k, c in fields.items()], *[c.alias(k) for k, c in extras.items()])
    return df.select(F.to_json(record, {"ignoreNullFields": "true"}).alias("record"))
