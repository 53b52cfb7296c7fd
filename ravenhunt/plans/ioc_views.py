"""IOC stand-in inputs derived from the driver tables (Spark and DuckDB forms).

``feed_objects``: JSON feed objects built from ``pages`` (URLs and hosts, in
four object shapes) and ``documents`` (every IPv4-like text and 40-hex text).
The extraction, validation, joins and counts all run in the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.operators.intel import iocs_from_objects
from ravenhunt.schemas import FEED_SCHEMA
from ravenhunt.session import read_table

NOW = "2024-02-01T00:00:00"
IPV4_TEXT = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
HEX40_TEXT = r"[0-9a-f]{40}"
HOST_OF_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)"

# --- fixed values: the reference's feed configuration, plus one disabled feed
FEEDS = [
    ("feodotracker_ips", "https://feodotracker.abuse.ch/downloads/ipblocklist.txt", "ip", 6, True, None),
    ("urlhaus_domains", "https://urlhaus.abuse.ch/downloads/text_online/", "domain", 12, True, None),
    (
        "threatfox_iocs",
        "https://threatfox.abuse.ch/export/json/recent/",
        "mixed",
        4,
        True,
        {"User-Agent": "feed-reader"},
    ),
    ("retired_feed", "http://192.168.1.5/feed.txt", "ip", 24, False, None),
]
# ----------------------------------------------------------------------------

FEED_TYPES = {name: ftype for name, _, ftype, _, _, _ in FEEDS}


def feed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEEDS, FEED_SCHEMA)


def _j(c) -> F.Column:
    """JSON string literal of a text Column."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def feed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, feed_type, obj) with ``obj`` a JSON object text."""
    pages = read_table(spark, sf_dir, "pages")
    url = F.col("url")
    host = F.regexp_extract(url, HOST_OF_URL, 1)
    pid = F.col("page_id")
    shape = pid % 4
    obj = (
        F.when(
            shape == 0,
            F.concat(
                F.lit('{"value": '), _j(url), F.lit(', "type": "url", "source": "pages", "tags": ["web", "p'),
                (pid % 3).cast("string"), F.lit('"]}'),
            ),
        )
        .when(shape == 1, F.concat(F.lit('{"indicator": '), _j(host), F.lit(', "confidence": "high"}')))
        .when(shape == 2, F.concat(F.lit('{"value": null, "url": '), _j(url), F.lit("}")))
        .otherwise(
            F.concat(F.lit('{"url": '), _j(url), F.lit(', "description": "page '), pid.cast("string"), F.lit('"}'))
        )
    )
    feed = F.when(shape.isin(0, 2), F.lit("threatfox_iocs")).otherwise(F.lit("urlhaus_domains"))
    page_objs = pages.select(feed.alias("feed"), obj.alias("obj"))

    docs = read_table(spark, sf_dir, "documents")
    ip_objs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IPV4_TEXT), 0)).alias("ip")).select(
        F.lit("feodotracker_ips").alias("feed"),
        F.concat(
            F.lit('{"ip": '), _j(F.col("ip")),
            F.lit(', "ioc_type": "ip", "source": "documents", "timestamp": "2024-01-01T00:00:00"}'),
        ).alias("obj"),
    )
    hash_objs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(HEX40_TEXT), 0)).alias("h")).select(
        F.lit("threatfox_iocs").alias("feed"),
        F.concat(
            F.lit('{"hash": '), _j(F.col("h")), F.lit(', "indicator_type": "sha1", "description": "doc '),
            F.col("doc_id").cast("string"), F.lit('"}'),
        ).alias("obj"),
    )
    objs = page_objs.unionByName(ip_objs).unionByName(hash_objs)
    types = spark.createDataFrame(list(FEED_TYPES.items()), "feed string, feed_type string")
    return objs.join(F.broadcast(types), "feed", "left")


def ioc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs_from_objects(feed_objects(spark, sf_dir), NOW)


# ------------------------------------------------------------------ SQL side
def _sj(c: str) -> str:
    return f"'\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


FEED_OBJECTS_SQL = f"""
SELECT CASE WHEN page_id % 4 IN (0, 2) THEN 'threatfox_iocs' ELSE 'urlhaus_domains' END AS feed,
  CASE page_id % 4
    WHEN 0 THEN '{{"value": ' || {_sj('url')} || ', "type": "url", "source": "pages", "tags": ["web", "p'
                || CAST(page_id % 3 AS VARCHAR) || '"]}}'
    WHEN 1 THEN '{{"indicator": ' || {_sj(f"regexp_extract(url, '{HOST_OF_URL}', 1)")} || ', "confidence": "high"}}'
    WHEN 2 THEN '{{"value": null, "url": ' || {_sj('url')} || '}}'
    ELSE '{{"url": ' || {_sj('url')} || ', "description": "page ' || CAST(page_id AS VARCHAR) || '"}}' END AS obj
FROM pages
UNION ALL
SELECT 'feodotracker_ips', '{{"ip": ' || {_sj('ip')}
       || ', "ioc_type": "ip", "source": "documents", "timestamp": "2024-01-01T00:00:00"}}'
FROM (SELECT unnest(regexp_extract_all(text, '{IPV4_TEXT}')) AS ip FROM documents)
UNION ALL
SELECT 'threatfox_iocs', '{{"hash": ' || {_sj('h')} || ', "indicator_type": "sha1", "description": "doc '
       || CAST(doc_id AS VARCHAR) || '"}}'
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{HEX40_TEXT}')) AS h FROM documents)
"""

_FEED_TYPE_CASE = (
    "CASE feed " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in FEED_TYPES.items()) + " END"
)


def _first_present_sql(obj: str, keys: list[str]) -> str:
    whens = " ".join(f"WHEN json_exists({obj}, '$.{k}') THEN json_extract_string({obj}, '$.{k}')" for k in keys)
    return f"CASE {whens} END"


def _any_present_sql(obj: str, keys: list[str]) -> str:
    return "(" + " OR ".join(f"json_exists({obj}, '$.{k}')" for k in keys) + ")"


def _get_sql(obj: str, key: str, default: str) -> str:
    return f"CASE WHEN json_exists({obj}, '$.{key}') THEN json_extract_string({obj}, '$.{key}') ELSE '{default}' END"


VALID_IOC_SQL = """(coalesce(length({v}) >= 3, false) AND CASE
  WHEN {t} = 'ip' THEN coalesce(regexp_full_match({v}, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}'), false)
  WHEN {t} = 'domain' THEN coalesce(regexp_matches({v}, '^[a-zA-Z0-9]([a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?(\\.[a-zA-Z0-9]([a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?)*$'), false)
  WHEN {t} = 'url' THEN coalesce(regexp_matches({v}, '^https?://'), false)
  WHEN {t} = 'md5' THEN coalesce(regexp_matches({v}, '^[a-fA-F0-9]{{32}}$'), false)
  WHEN {t} = 'sha1' THEN coalesce(regexp_matches({v}, '^[a-fA-F0-9]{{40}}$'), false)
  WHEN {t} = 'sha256' THEN coalesce(regexp_matches({v}, '^[a-fA-F0-9]{{64}}$'), false)
  ELSE true END)"""


def valid_ioc_sql(v: str, t: str) -> str:
    return VALID_IOC_SQL.format(v=v, t=t)


def ioc_sql(objects_sql: str, feed_type_sql: str = _FEED_TYPE_CASE, with_tags: bool = False) -> str:
    """IOC rows from a (feed, obj) relation: first present key, defaults,
    validity - the SQL twin of ``operators.intel.iocs_from_objects``."""
    o = "obj"
    tags = (
        f", CASE WHEN json_exists({o}, '$.tags') THEN CAST(json_extract({o}, '$.tags') AS VARCHAR) "
        "ELSE '[]' END AS tags"
        if with_tags
        else ""
    )
    return f"""
SELECT value, type, source, confidence, timestamp, description{', tags' if with_tags else ''}, feed FROM (
  SELECT feed,
         {_first_present_sql(o, ['value', 'indicator', 'ioc', 'ip', 'domain', 'hash', 'url'])} AS value,
         CASE WHEN {_any_present_sql(o, ['type', 'ioc_type', 'indicator_type'])}
              THEN {_first_present_sql(o, ['type', 'ioc_type', 'indicator_type'])}
              ELSE {feed_type_sql} END AS type,
         {_get_sql(o, 'source', 'unknown')} AS source,
         {_get_sql(o, 'confidence', 'medium')} AS confidence,
         {_get_sql(o, 'timestamp', NOW)} AS timestamp,
         {_get_sql(o, 'description', '')} AS description{tags}
  FROM ({objects_sql})
) WHERE coalesce(value <> '', false) AND {valid_ioc_sql('value', 'type')}
"""


IOC_VIEW_SQL = ioc_sql(FEED_OBJECTS_SQL)

FEEDS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{u}', '{t}', {i}, {str(e).lower()})" for n, u, t, i, e, _ in FEEDS
) + ") f(name, url, feed_type, update_interval, enabled)"
