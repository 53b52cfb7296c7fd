"""Threat-intelligence inputs read from files.

Feeds are files (fetching over HTTP is not part of the engine). Text and
JSON Lines feeds split across tasks; a JSON *document* (list or envelope) is
one record to the parser and is read by one task per file, like the ATT&CK
bundle. Everything after the parse is columnar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravenhunt.functions.documents import large_unparsed
from ravenhunt.functions.validate import valid_ioc
from ravenhunt.operators.intel import extract_ioc
from ravenhunt.schemas import FEED_SCHEMA, IOC_SCHEMA, TECHNIQUE_SCHEMA
from ravenhunt.sources.files import json_documents

# --- fixed values (must equal the reference's behaviour) -------------------
TEXT_FEED_COMMENTS = ["#", "//"]
TEXT_FEED_CONFIDENCE = "medium"
ATTACK_PATTERN = "attack-pattern"
MITRE_SOURCE = "mitre-attack"
TECHNIQUE_URL_PREFIX = "https://attack.mitre.org/techniques/"
# Feed configuration used when no configuration file exists.
DEFAULT_FEEDS = [
    ("feodotracker_ips", "https://feodotracker.abuse.ch/downloads/ipblocklist.txt", "ip", 6, True, None),
    ("malware_domains", "https://urlhaus.abuse.ch/downloads/text/", "domain", 12, True, None),
    ("threatfox_iocs", "https://threatfox.abuse.ch/export/json/recent/", "mixed", 4, True, None),
]
DEFAULT_MITRE_INTERVAL = 24
# ----------------------------------------------------------------------------

_WS = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def text_feed_lines(lines: DataFrame, feed: str, feed_type: str, now: str, col: str = "value") -> DataFrame:
    """S6 on a DataFrame of lines: strip, drop blank/comment lines, take the
    first whitespace-separated token, keep it when valid for the feed type."""
    stripped = lines.select(_strip(F.col(col)).alias("line"))
    kept = stripped.where(F.col("line") != "")
    for prefix in TEXT_FEED_COMMENTS:
        kept = kept.where(~F.col("line").startswith(prefix))
    token = F.split(F.col("line"), f"{_WS}+").getItem(0)
    return kept.select(token.alias("value")).where(valid_ioc(F.col("value"), F.lit(feed_type))).select(
        "value",
        F.lit(feed_type).alias("type"),
        F.lit(feed).alias("source"),
        F.lit(TEXT_FEED_CONFIDENCE).alias("confidence"),
        F.lit(now).alias("timestamp"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("description"),
        F.lit(feed).alias("feed"),
    )


def read_text_feed(spark: SparkSession, path: str, feed: str, feed_type: str, now: str) -> DataFrame:
    """One indicator per line (first column), comments skipped."""
    return text_feed_lines(spark.read.option("recursiveFileLookup", True).text(path), feed, feed_type, now)


def _is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def json_feed_items(docs: DataFrame, doc_col: str) -> DataFrame:
    """Unwrap parsed feed documents to (item): a list is used as is; an object
    is replaced by its ``data`` member, else its ``iocs`` member, however deep;
    anything else yields no items. Each round unwraps one level of all
    documents, until none is an object any more. (Aggregates and the outer
    explode keep the levels apart: a filter would be pushed below them and copy
    each level's expression into the next.)"""
    v = F.col(doc_col)
    while docs.agg(F.max(_is_kind(v, "OBJECT"))).first()[0]:
        inner = F.coalesce(
            F.try_variant_get(v, "$.data", "variant"), F.try_variant_get(v, "$.iocs", "variant")
        )
        docs = docs.withColumn(doc_col, F.when(_is_kind(v, "ARRAY"), v).when(_is_kind(v, "OBJECT"), inner))
    items = F.when(_is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    return docs.select(F.explode_outer(items).alias("item"))


def text_items(docs: DataFrame, doc_col: str) -> DataFrame:
    """``json_feed_items`` on JSON text, for documents beyond a variant's size:
    each level is unwrapped to the text of its member, and the list to the
    texts of its items (``item``)."""
    v = F.col(doc_col)
    first = F.substr(F.ltrim(v, F.lit(" \t\r\n")), F.lit(1), F.lit(1))
    while docs.agg(F.max(first == "{")).first()[0]:
        m = F.from_json(v, "map<string,string>")
        inner = F.when(F.map_contains_key(m, F.lit("data")), m["data"]).otherwise(m["iocs"])
        docs = docs.withColumn(doc_col, F.when(first == "[", v).when(first == "{", inner))
    return docs.select(F.explode_outer(F.when(first == "[", F.from_json(v, "array<string>"))).alias("item"))


def read_json_feed(spark: SparkSession, path: str, feed: str, feed_type: str, now: str,
                   lines: bool = False) -> DataFrame:
    """JSON feed -> IOC rows. ``lines=True`` reads one object per line
    (splittable); otherwise each file is one document (list or envelope)."""
    if lines:
        objs = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("obj"))
    else:
        docs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        items = json_feed_items(docs.select(F.try_parse_json("value").alias("doc")), "doc")
        objs = items.where(_is_kind(F.col("item"), "OBJECT")).select(F.to_json("item").alias("obj"))
        large = docs.filter(large_unparsed(F.col("value")))
        if not large.isEmpty():
            objs = objs.unionByName(text_items(large, "value").where(F.ltrim("item").startswith("{")).select(F.col("item").alias("obj")))
    m = F.from_json(F.col("obj"), "map<string,string>")
    out = objs.select(extract_ioc(m, F.lit(feed_type), now).alias("ioc")).where(F.col("ioc").isNotNull())
    return out.select("ioc.*", F.lit(feed).alias("feed"))


_ENVELOPE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("iocs", T.ArrayType(T.StructType([f for f in IOC_SCHEMA.fields if f.name != "feed"]))),
    ]
)


def read_ioc_cache(spark: SparkSession, path: str, feed: str | None = None) -> DataFrame:
    """IOCs from a cache. Reads the envelope document ``{timestamp,
    count, iocs:[...]}``; a missing path gives an empty table."""
    empty = spark.createDataFrame([], IOC_SCHEMA)
    try:
        env = json_documents(spark.read.schema(_ENVELOPE).option("recursiveFileLookup", True), path)
        out = env.select(F.explode("iocs").alias("i")).select("i.*", F.lit(feed).cast("string").alias("feed"))
        out.schema  # noqa: B018 - resolve now so a missing path is caught here
        return out
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return empty
        raise



_REF = T.StructType(
    [T.StructField("source_name", T.StringType()), T.StructField("external_id", T.StringType()),
     T.StructField("url", T.StringType())]
)
_OBJECT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("external_references", T.ArrayType(_REF)),
    ]
)


def techniques_from_objects(objects: DataFrame, obj_col: str = "obj", pos_col: str = "pos") -> DataFrame:
    """S9 after the scan: attack-pattern objects -> technique rows with the
    id of the *first* mitre-attack reference; empty ids dropped; ``pos`` kept
    for first-wins de-duplication (W1)."""
    o = F.col(obj_col)
    first_ref = F.try_element_at(
        F.filter(o["external_references"], lambda r: r["source_name"] == MITRE_SOURCE), F.lit(1)
    )
    tid = F.coalesce(first_ref["external_id"], F.lit(""))
    return (
        objects.where(o["type"] == ATTACK_PATTERN)
        .select(
            tid.alias("technique_id"),
            F.coalesce(o["name"], F.lit("")).alias("name"),
            F.coalesce(o["description"], F.lit("")).alias("description"),
            F.concat(F.lit(TECHNIQUE_URL_PREFIX), tid).alias("url"),
            F.col(pos_col).alias("pos"),
        )
        .where(F.col("technique_id") != "")
    )


def read_attack_bundle(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ATT&CK bundle ``{objects:[...]}`` (one document per file), or with
    ``lines=True`` one object per line. Result has TECHNIQUE_SCHEMA + pos."""
    if lines:
        objs = spark.read.schema(_OBJECT).json(path).select(
            F.struct(*[F.col(f.name) for f in _OBJECT.fields]).alias("obj"),
            F.input_file_name().alias("path"),
            F.monotonically_increasing_id().alias("pos"),
        )
    else:
        reader = spark.read.schema(T.StructType([T.StructField("objects", T.ArrayType(_OBJECT))]))
        bundle = json_documents(reader.option("recursiveFileLookup", True), path)
        objs = bundle.select(F.input_file_name().alias("path"), F.posexplode("objects").alias("pos", "obj"))
    return techniques_from_objects(objs)


_CONFIG = T.StructType(
    [
        T.StructField("mitre_update_interval", T.LongType()),
        T.StructField("cache_directory", T.StringType()),
        T.StructField("max_cache_age", T.LongType()),
        T.StructField(
            "ioc_feeds",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("feed_type", T.StringType()),
                        T.StructField("update_interval", T.LongType()),
                        T.StructField("enabled", T.BooleanType()),
                        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def read_feed_config(spark: SparkSession, path: str | None) -> DataFrame:
    """Feed table from the configuration document; defaults when the
    file is absent; a missing ``enabled`` means enabled."""
    default = spark.createDataFrame(DEFAULT_FEEDS, FEED_SCHEMA)
    if path is None:
        return default
    try:
        cfg = json_documents(spark.read.schema(_CONFIG).option("recursiveFileLookup", True), path)
        feeds = cfg.select(F.explode("ioc_feeds").alias("f")).select("f.*")
        feeds.schema  # noqa: B018
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return default
        raise
    return feeds.withColumn("enabled", F.coalesce(F.col("enabled"), F.lit(True))).select(*FEED_SCHEMA.names)
