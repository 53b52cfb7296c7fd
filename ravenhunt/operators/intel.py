"""Threat-intelligence operators: IOC extraction and validation, lookups,
feed status and totals, technique lookups (P10-P11, F16-F19, J3-J8, A15-A16).

Lookups are joins, never driver loops: a list of values to check is itself a
DataFrame. The IOC side is broadcast only after its size is checked; beyond
the bound Spark plans a shuffle (sort-merge) join on the lower-cased value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenhunt.functions import text as tx
from ravenhunt.functions.documents import readable
from ravenhunt.functions.validate import valid_ioc
from ravenhunt.operators.joins import sized_broadcast

# --- fixed values (must equal the reference's behaviour) -------------------
# First present key wins, in this order.
VALUE_KEYS = ["value", "indicator", "ioc", "ip", "domain", "hash", "url"]
TYPE_KEYS = ["type", "ioc_type", "indicator_type"]
DEFAULT_SOURCE = "unknown"
DEFAULT_CONFIDENCE = "medium"
DEFAULT_DESCRIPTION = ""
# ----------------------------------------------------------------------------

IOC_STRING_FIELDS = ["value", "type", "source", "confidence", "timestamp", "description"]


def first_present(m: Column, keys: list[str]) -> tuple[Column, Column]:
    """(found, value) of the first key present in map ``m`` (null values count
    as present and end the search, like a dict lookup loop with ``break``)."""
    found = F.lit(False)
    value = F.lit(None).cast("string")
    for k in reversed(keys):
        has = F.map_contains_key(m, F.lit(k))
        value = F.when(has, m[k]).otherwise(value)
        found = F.when(has, F.lit(True)).otherwise(found)
    return found, value


def extract_ioc(obj: Column, feed_type: Column, now: str) -> Column:
    """P10: feed object (``map<string,string>``) -> IOC struct, or null when
    no value, empty value, or invalid for its type."""
    _, value = first_present(obj, VALUE_KEYS)
    type_found, type_value = first_present(obj, TYPE_KEYS)
    ioc_type = F.when(type_found, type_value).otherwise(feed_type)

    def get(key, default):
        return F.when(F.map_contains_key(obj, F.lit(key)), obj[key]).otherwise(F.lit(default))

    tags = F.when(
        F.map_contains_key(obj, F.lit("tags")),
        F.from_json(obj["tags"], "array<string>"),
    ).otherwise(F.array().cast("array<string>"))
    record = F.struct(
        value.alias("value"),
        ioc_type.alias("type"),
        get("source", DEFAULT_SOURCE).alias("source"),
        get("confidence", DEFAULT_CONFIDENCE).alias("confidence"),
        get("timestamp", now).alias("timestamp"),
        tags.alias("tags"),
        get("description", DEFAULT_DESCRIPTION).alias("description"),
    )
    keep = F.coalesce(value != "", F.lit(False)) & valid_ioc(value, ioc_type)
    return F.when(keep, record)


def iocs_from_objects(objects: DataFrame, now: str, obj_col: str = "obj", feed_col: str = "feed",
                      feed_type_col: str = "feed_type") -> DataFrame:
    """Rows of (feed, feed_type, JSON object text) -> IOC rows (IOC_SCHEMA)."""
    m = F.from_json(F.col(obj_col), "map<string,string>")
    return (
        objects.select(F.col(feed_col).alias("feed"), extract_ioc(m, F.col(feed_type_col), now).alias("ioc"))
        .where(F.col("ioc").isNotNull())
        .select("ioc.*", "feed")
    )


def sanitize_iocs(iocs: DataFrame, max_length: int | None = None) -> DataFrame:
    """Every string field through the sanitiser (cut to ``max_length`` if
    given); keep rows with a non-empty value. The raw value is kept as
    ``lookup_value``."""
    out = iocs.withColumn("lookup_value", F.col("value")).withColumns(
        {c: tx.sanitize(F.col(c), max_length) for c in IOC_STRING_FIELDS if c in iocs.columns}
    )
    return out.where(F.coalesce(F.col("value") != "", F.lit(False)))


def validation_counts(candidates: DataFrame, value_col: str = "value", type_col: str = "type") -> DataFrame:
    """Valid and total candidates per type."""
    return candidates.groupBy(F.col(type_col).alias("type")).agg(
        F.count_if(valid_ioc(F.col(value_col), F.col(type_col))).alias("valid"),
        F.count(F.lit(1)).alias("total"),
    )


def iocs_by_type(iocs: DataFrame, ioc_type: str) -> DataFrame:
    """F16."""
    return iocs.where(F.col("type") == ioc_type)


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    """enabled feeds (missing flag -> enabled)."""
    return feeds.where(F.coalesce(F.col("enabled"), F.lit(True)))


def all_iocs(iocs: DataFrame, feeds: DataFrame) -> DataFrame:
    """IOCs of every enabled feed, concatenated without de-duplication."""
    names = enabled_feeds(feeds).select(F.col("name").alias("feed"))
    return iocs.join(sized_broadcast(names), "feed", "left_semi")


def ioc_lookup(values: DataFrame, iocs: DataFrame, value_col: str = "value", case_sensitive: bool = False,
               broadcast_rows: int | None = None) -> DataFrame:
    """Every (checked value, matching IOC) pair.

    Case-insensitive by default (J3); ``case_sensitive=True`` is the store
    lookup (J7). The IOC side is broadcast when its size allows.
    """
    key = (lambda c: c) if case_sensitive else F.lower
    left = values.select(F.col(value_col).alias("indicator")).withColumn("__k", key(F.col("indicator")))
    right = iocs.withColumn("__k", key(F.col("value")))
    if broadcast_rows is not None:
        right = sized_broadcast(right, broadcast_rows)
    return left.join(right, "__k", "inner").drop("__k")


def ioc_bulk_lookup(values: DataFrame, iocs: DataFrame, value_col: str = "value") -> DataFrame:
    """Indicators with at least one match, with the match count and the
    sorted list of feeds. Aggregation is per indicator after the join (the
    matches of one indicator are bounded by the IOC copies of that value)."""
    pairs = ioc_lookup(values.select(value_col).distinct(), iocs, value_col)
    return pairs.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.array_join(F.array_sort(F.collect_set("feed")), ",").alias("feeds"),
    )


def log_ioc_match(logs: DataFrame, iocs: DataFrame) -> DataFrame:
    """Log rows whose source or destination IP is a known IOC.

    Each log row gives one row per address it has, and those meet the
    indicators in one equi-join: logs and indicators are scanned once. The IOC
    side is reduced to distinct (value, feed) first, so a value repeated in
    many IOC rows cannot multiply the log rows that carry it.
    """
    ips = iocs.where(F.col("type") == "ip").select(F.col("value").alias("ioc_value"), "feed").distinct()
    sides = F.array(*[F.struct(F.lit(f).alias("matched_field"), F.col(f).alias("ip")) for f in ("source_ip", "destination_ip")])
    seen = logs.select("event_id", "timestamp", "hostname", F.inline(sides)).where(F.col("ip").isNotNull())
    return seen.join(ips, seen["ip"] == ips["ioc_value"], "inner").select(
        "event_id", "timestamp", "hostname", "matched_field", "ioc_value", "feed")


def feed_documents(documents: DataFrame, feed_col: str = "feed", text_col: str = "value", time_col: str = "modificationTime") -> DataFrame:
    """Per feed: its fetched JSON documents, how many cannot be read, and the
    last update (``documents``: one row per fetched file, with its whole text)."""
    bad = ~F.coalesce(readable(F.col(text_col)), F.lit(False))
    return documents.groupBy(F.col(feed_col).alias("__feed")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("unreadable"), F.max(time_col).alias("last_updated"))


def feed_status(feeds: DataFrame, iocs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per enabled feed its status, IOC count, type, last update and error.

    ``fetched`` is ``feed_documents``: a feed without documents, or with one
    that cannot be read, has failed."""
    counts = iocs.groupBy("feed").agg(F.count(F.lit(1)).alias("ioc_count"))
    f = enabled_feeds(feeds).select(F.col("name").alias("feed"), "feed_type")
    error = F.when(F.col("documents").isNull(), F.lit("no document")).when(
        F.col("unreadable") > 0, F.format_string("%d of %d documents unreadable", "unreadable", "documents"))
    return f.join(counts, "feed", "left").join(fetched, F.col("feed") == F.col("__feed"), "left").select(
        "feed",
        F.when(error.isNull(), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce(F.col("ioc_count"), F.lit(0).cast("long")).alias("ioc_count"),
        "feed_type",
        "last_updated",
        error.alias("error"),
    )


def cti_totals(status: DataFrame, techniques: DataFrame) -> DataFrame:
    """Technique count, total IOCs, feed count and errors."""
    t = techniques.agg(F.count_distinct("technique_id").alias("techniques_count"))
    s = status.agg(
        F.coalesce(F.sum("ioc_count"), F.lit(0)).cast("long").alias("total_iocs"),
        F.count(F.lit(1)).alias("feed_count"),
        F.count_if(F.col("status") != "success").alias("errors"),
    )
    return t.crossJoin(s)


def feeds_stale(feeds: DataFrame, manifest: DataFrame, now: str) -> DataFrame:
    """a feed needs an update when its cache file is missing or older
    than its interval (hours) at time ``now``."""
    m = manifest.select(F.col("feed").alias("__feed"), "modificationTime")
    f = enabled_feeds(feeds)
    joined = f.join(m, f["name"] == m["__feed"], "left")
    limit = F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.col("update_interval").cast("int"))
    return joined.select(
        F.col("name").alias("feed"),
        F.col("modificationTime").alias("last_updated"),
        (F.col("modificationTime").isNull() | (F.col("modificationTime") < limit)).alias("stale"),
    )


def technique_lookup(ids: DataFrame, techniques: DataFrame, id_col: str = "technique_id") -> DataFrame:
    """Requested ids that exist in the technique table (unknown ids left out)."""
    want = ids.select(F.col(id_col).alias("technique_id")).distinct()
    return want.join(sized_broadcast(techniques), "technique_id", "inner")
