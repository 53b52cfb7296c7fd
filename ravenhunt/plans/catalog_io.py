"""Registered queries for normalisation, file scans, feeds, exports,
profiles, bursts and streams.

File-scan queries first write table-derived data to a fresh folder below the
shared checkpoint folder (``session.scratch_path``) with Spark, then read it
back through the library's readers, so the whole scan path runs.
"""

from __future__ import annotations

import itertools
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ravenhunt.operators import intel, profile
from ravenhunt.operators.bursts import burst_flags
from ravenhunt.plans import ioc_views as iv
from ravenhunt.plans.catalog import findings, register
from ravenhunt.plans.oracle_hunt import HUNT_WITH
from ravenhunt.plans.ruleset import rule_table, technique_table
from ravenhunt.plans.views import LOG_VIEW_SQL, log_view
from ravenhunt.schemas import LOG_COLUMNS, LOG_SCHEMA
from ravenhunt.session import read_table, scratch_path
from ravenhunt.sinks import exports
from ravenhunt.sources import intel as src_intel
from ravenhunt.sources import logs as src_logs
from ravenhunt.sources.rules import read_rules
from ravenhunt.streaming import jobs

CSV_WRITE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
JSON_WRITE = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
_LV = f"WITH lv AS ({LOG_VIEW_SQL}) "
_LV_COLS = "timestamp, hostname, username, process_name, event_id, message, source_ip, destination_ip"


def _as_source(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """Log rows under the source column names of a format (inverse map)."""
    return df.select(*[F.col(v).alias(k) for k, v in column_map.items()])


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def _write_files(rows: DataFrame, path: str, suffix: str) -> bool:
    """One file of lines per name of ``rows`` (name, value; rows of a name are
    neighbours in one partition), in a folder per partition. Spark's writer
    needs some tens of milliseconds a file; here tasks open the files. False,
    with nothing written: the shared folder is no mounted one."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        return False
    root = unquote(where.path)

    def write(part) -> None:
        folder = f"{root}/{TaskContext.get().partitionId()}"
        os.makedirs(folder, exist_ok=True)
        for name, lines in itertools.groupby(part, key=lambda r: r[0]):
            made = f"{folder}/.{uuid.uuid4().hex}"  # hidden until it is whole; a task that runs again writes the same files
            with open(made, "w", encoding="utf-8", newline="") as f:
                f.writelines((r[1] or "") + "\n" for r in lines)
            os.replace(made, f"{folder}/{name}{suffix}")

    os.makedirs(root, exist_ok=True)
    rows.select("name", "value").foreachPartition(write)
    return True


DOC_ITEMS = 100_000


def _doc_group():
    """Groups of at most DOC_ITEMS consecutive rows of one input partition
    (ids from ``monotonically_increasing_id`` are contiguous per partition),
    so no document or record grows with the table."""
    return F.floor(F.monotonically_increasing_id() / F.lit(DOC_ITEMS)).alias("g")


def _documents(df: DataFrame, json_col: str, prefix: str, suffix: str) -> DataFrame:
    """One JSON document text per group of at most DOC_ITEMS rows."""
    return df.groupBy(_doc_group()).agg(
        F.concat(F.lit(prefix), F.concat_ws(",", F.collect_list(json_col)), F.lit(suffix)).alias("value")
    )


# ----------------------------------------------------------- normalise group
@register("normalize_csv", _LV + f"SELECT {_LV_COLS}, action FROM lv")
def q_normalize_csv(spark, sf_dir):
    """CSV column names -> the fixed schema (an extra column is dropped)."""
    src = _as_source(log_view(spark, sf_dir), src_logs.CSV_COLUMN_MAP).withColumn("Extra", F.lit("x"))
    return src_logs.normalize(src, src_logs.CSV_COLUMN_MAP)


@register("normalize_json", _LV + f"SELECT {_LV_COLS}, CAST(NULL AS VARCHAR) AS action FROM lv")
def q_normalize_json(spark, sf_dir):
    """JSON key names -> the fixed schema; ``action`` has no key (null)."""
    src = _as_source(log_view(spark, sf_dir), src_logs.JSON_COLUMN_MAP)
    return src_logs.normalize(src, src_logs.JSON_COLUMN_MAP)


@register(
    "safe_casts",
    """SELECT event_id AS source_event_id,
       coalesce(TRY_CAST(eid AS BIGINT), CASE WHEN TRY_CAST(eid AS DOUBLE) = floor(TRY_CAST(eid AS DOUBLE))
                THEN CAST(TRY_CAST(eid AS DOUBLE) AS BIGINT) END) AS event_id,
       TRY_CAST(tss AS TIMESTAMP) AS timestamp
FROM (SELECT event_id,
             CAST(event_id AS VARCHAR) || CASE WHEN event_type = 'click' THEN '.0'
                                               WHEN event_type = 'error' THEN 'x' ELSE '' END AS eid,
             CASE WHEN event_type = 'view' THEN 'not a time' ELSE CAST(CAST(ts AS TIMESTAMP) AS VARCHAR) END AS tss
      FROM events)""",
)
def q_safe_casts(spark, sf_dir):
    """Text -> bigint / timestamp per value; bad values become null."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.concat(
        F.col("event_id").cast("string"),
        F.when(F.col("event_type") == "click", F.lit(".0")).when(F.col("event_type") == "error", F.lit("x"))
        .otherwise(F.lit("")),
    )
    tss = F.when(F.col("event_type") == "view", F.lit("not a time")).otherwise(
        F.col("ts").cast("timestamp").cast("string")
    )
    from pyspark.sql import types as T

    return ev.select(
        F.col("event_id").alias("source_event_id"),
        src_logs.safe_cast(eid, T.LongType()).alias("event_id"),
        src_logs.safe_cast(tss, T.TimestampType()).alias("timestamp"),
    )


@register("row_cap", _LV + "SELECT * FROM lv ORDER BY event_id LIMIT 1000")
def q_row_cap(spark, sf_dir):
    """the optional per-source row cap (the limit is the operator)."""
    return log_view(spark, sf_dir).orderBy("event_id").limit(1000)


_ISO_SQL = (
    "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(CAST(ts AS TIMESTAMP)) % 1000000 <> 0 "
    "THEN printf('.%06d', epoch_us(CAST(ts AS TIMESTAMP)) % 1000000) ELSE '' END"
)


@register(
    "structured_events",
    f"""SELECT CASE WHEN event_type IN ('error', 'signup')
  THEN json_object('timestamp', {_ISO_SQL}, 'level', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
                   'logger', 'events', 'message', event_type || ' ' || props, 'module', 'events',
                   'function', event_type, 'line', event_id, 'user_id', user_id, 'security_event', event_type)
  ELSE json_object('timestamp', {_ISO_SQL}, 'level', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
                   'logger', 'events', 'message', event_type || ' ' || props, 'module', 'events',
                   'function', event_type, 'line', event_id, 'user_id', user_id) END::VARCHAR AS record
FROM events""",
)
def q_structured_events(spark, sf_dir):
    """One JSON record per event; ``security_event`` only when present."""
    ev = read_table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    micros = F.unix_micros(ts) % 1_000_000
    iso = F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != 0, F.format_string(".%06d", micros)).otherwise(F.lit("")),
    )
    fields = {
        "timestamp": iso,
        "level": F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")),
        "logger": F.lit("events"),
        "message": F.concat(F.col("event_type"), F.lit(" "), F.col("props")),
        "module": F.lit("events"),
        "function": F.col("event_type"),
        "line": F.col("event_id"),
    }
    extras = {
        "user_id": F.col("user_id"),
        "security_event": F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")),
    }
    return profile.structured_events(ev, fields, extras)


# ---------------------------------------------------------- file-scan group
_EXTRA_CSV = [
    ",".join(src_logs.CSV_COLUMN_MAP),
    "2024-03-01 00:00:00,EXTRA-HOST,x,y.exe,1,,,a,b,c,d",
    "2024-03-02 00:00:00,SHORT-HOST,shortuser",
    '2024-03-03 00:00:00,QUOTED,u,p.exe,7,,,"has, comma",done',
    '2024-03-05 00:00:00,BROKEN,u,b.exe,9,,,"two\nlines",done',
    "2024-03-04 00:00:00,NA-HOST,NA,n.exe,8,NA,null,None,N/A",
]
_EXTRA_CSV_SQL = """SELECT * FROM (VALUES
  (TIMESTAMP '2024-03-02 00:00:00', 'SHORT-HOST', 'shortuser', NULL, NULL, NULL, NULL, NULL, NULL),
  (TIMESTAMP '2024-03-03 00:00:00', 'QUOTED', 'u', 'p.exe', 7, 'has, comma', NULL, NULL, 'done'),
  (TIMESTAMP '2024-03-05 00:00:00', 'BROKEN', 'u', 'b.exe', 9, 'two' || chr(10) || 'lines', NULL, NULL, 'done'),
  (TIMESTAMP '2024-03-04 00:00:00', 'NA-HOST', NULL, 'n.exe', 8, NULL, NULL, NULL, NULL))
  v(timestamp, hostname, username, process_name, event_id, message, source_ip, destination_ip, action)"""


_HALF_ACTION = "CASE WHEN event_id % 2 = 0 THEN action END AS action"


def _two_headers(spark, sf_dir, path):
    """The log view as CSV files of two kinds: one with all columns, one with
    the columns in reverse order and without the action."""
    src = _as_source(log_view(spark, sf_dir), src_logs.CSV_COLUMN_MAP)
    src.where("EventID % 2 = 0").write.options(**CSV_WRITE).csv(path)
    src.where("EventID % 2 <> 0").select(*[c for c in reversed(src.columns) if c != "Action"]) \
        .write.mode("append").options(**CSV_WRITE).csv(path)


def _csv_dir(spark, sf_dir, name):
    path = scratch_path(spark, name)
    _two_headers(spark, sf_dir, path)
    _write_lines(spark, _EXTRA_CSV, path)
    return path


@register(
    "scan_csv_logs",
    _LV + f"SELECT {_LV_COLS}, {_HALF_ACTION} FROM lv UNION ALL {_EXTRA_CSV_SQL}",
)
def q_scan_csv_logs(spark, sf_dir):
    """The log view written as CSV under two headers (+ a file with an
    over-long, a short, a quoted-comma, a quoted line break and an NA-text line),
    read back by column name and normalised."""
    return src_logs.read_csv_logs(spark, _csv_dir(spark, sf_dir, "scan-csv"))


_EXTRA_JSONL = [
    '{"host": "BAD", ',
    "",
    '{"host": "J1", "@timestamp": "2024-03-04 00:00:00", "event_id": "12.0", "process": "j.exe"}',
]
_EXTRA_JSONL_SQL = (
    "SELECT TIMESTAMP '2024-03-04 00:00:00', 'J1', NULL, 'j.exe', 12, NULL, NULL, NULL, NULL"
)


@register(
    "scan_jsonl_logs",
    _LV + f"SELECT {_LV_COLS}, CAST(NULL AS VARCHAR) AS action FROM lv UNION ALL {_EXTRA_JSONL_SQL}",
)
def q_scan_jsonl_logs(spark, sf_dir):
    """The log view as JSON Lines (+ a malformed and a blank line)."""
    path = scratch_path(spark, "scan-jsonl")
    _as_source(log_view(spark, sf_dir), src_logs.JSON_COLUMN_MAP).write.options(**JSON_WRITE).json(path)
    _write_lines(spark, _EXTRA_JSONL, path)
    return src_logs.read_jsonl_logs(spark, path)


@register(
    "scan_json_logs",
    _LV
    + f"""SELECT {_LV_COLS}, CAST(NULL AS VARCHAR) AS action FROM lv
UNION ALL SELECT NULL, 'SINGLE', NULL, NULL, 5, 'one object', NULL, NULL, NULL""",
)
def q_scan_json_logs(spark, sf_dir):
    """S3: JSON documents (a list of objects per file) and a single-object
    document, read in document mode."""
    path = scratch_path(spark, "scan-json")
    src = _as_source(log_view(spark, sf_dir), src_logs.JSON_COLUMN_MAP)
    objs = src.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in src.columns]), JSON_WRITE).alias("o"))
    _documents(objs, "o", "[", "]").write.partitionBy("g").text(path)
    _write_lines(spark, ['{"host": "SINGLE", "event_id": 5, "message": "one object"}'], path + "/single")
    return src_logs.read_json_logs(spark, path)


@register(
    "read_logs_mixed",
    _LV
    + f"""SELECT {_LV_COLS}, {_HALF_ACTION} FROM lv
UNION ALL SELECT {_LV_COLS}, CAST(NULL AS VARCHAR) FROM lv
UNION ALL SELECT {_LV_COLS}, CAST(NULL AS VARCHAR) FROM lv WHERE event_id % 200 = 0""",
)
def q_read_logs_mixed(spark, sf_dir):
    """One folder with CSV parts under two headers, JSON parts by line and
    JSON documents over several lines; dispatch by extension and content, union
    (the extra-lines file is .txt, so the extension filter leaves it out)."""
    path = _csv_dir(spark, sf_dir, "mixed")
    _as_source(log_view(spark, sf_dir), src_logs.JSON_COLUMN_MAP).write.mode("append").options(**JSON_WRITE).json(
        path + "/json"
    )
    docs = _as_source(log_view(spark, sf_dir), src_logs.JSON_COLUMN_MAP).where("event_id % 200 = 0")
    pretty = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), JSON_WRITE | {"pretty": "true"})
    texts = docs.select(F.monotonically_increasing_id().cast("string").alias("name"), pretty.alias("value"))
    if not _write_files(texts, path + "/documents", ".json"):
        docs.write.mode("append").options(**JSON_WRITE).option("pretty", True).option("maxRecordsPerFile", 1).json(path + "/documents")
    return src_logs.read_logs(spark, path)


_HOST_SQL = f"regexp_extract(url, '{iv.HOST_OF_URL}', 1)"


@register(
    "ioc_text_feed",
    f"""SELECT value, 'domain' AS type, 'urlhaus_domains' AS source, 'medium' AS confidence,
       '{iv.NOW}' AS timestamp, CAST(NULL AS VARCHAR) AS tags, CAST(NULL AS VARCHAR) AS description, 'urlhaus_domains' AS feed
FROM (SELECT {_HOST_SQL} AS value FROM pages) WHERE {iv.valid_ioc_sql('value', "'domain'")}""",
)
def q_ioc_text_feed(spark, sf_dir):
    """A text feed (host + extra column per page, comment and blank
    lines) parsed: first token, validated as a domain."""
    pages = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", iv.HOST_OF_URL, 1)
    lines = pages.select(
        F.explode(
            F.array(
                F.concat(F.lit("# page "), F.col("page_id").cast("string")),
                F.lit("   "),
                F.concat(F.lit("  "), host, F.lit("\t"), F.col("url")),
                F.lit("// end"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "text-feed")
    lines.write.text(path)
    out = src_intel.read_text_feed(spark, path, "urlhaus_domains", "domain", iv.NOW)
    return out.withColumn("tags", F.to_json("tags"))


@register(
    "ioc_json_feed",
    iv.ioc_sql(f"SELECT 'threatfox_iocs' AS feed, obj FROM ({iv.FEED_OBJECTS_SQL})", "'mixed'", with_tags=True),
)
def q_ioc_json_feed(spark, sf_dir):
    """JSON feed documents, the items six envelopes deep, read and unwrapped."""
    objs = iv.feed_objects(spark, sf_dir).select("obj")
    path = scratch_path(spark, "json-feed")
    deep = '{"data": {"iocs": {"data": {"data": {"iocs": {"data": ['
    _documents(objs, "obj", deep, "]" + "}" * 6).write.partitionBy("g").text(path)
    out = src_intel.read_json_feed(spark, path, "threatfox_iocs", "mixed", iv.NOW)
    return out.withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("[]")))


@register(
    "ioc_cache_read",
    f"WITH iv AS ({iv.ioc_sql(iv.FEED_OBJECTS_SQL, with_tags=True)}) SELECT value, type, source, confidence, timestamp, tags, description FROM iv",
)
def q_ioc_cache_read(spark, sf_dir):
    """IOC cache envelopes ``{timestamp, count, iocs}`` read back."""
    iocs = iv.ioc_view(spark, sf_dir)
    item = F.to_json(F.struct("value", "type", "source", "confidence", "timestamp", "tags", "description"))
    env = iocs.select(item.alias("j")).groupBy(_doc_group()).agg(
        F.concat(
            F.lit('{"timestamp": "'), F.lit(iv.NOW), F.lit('", "count": '), F.count(F.lit(1)).cast("string"),
            F.lit(', "iocs": ['), F.concat_ws(",", F.collect_list("j")), F.lit("]}"),
        ).alias("value")
    )
    path = scratch_path(spark, "ioc-cache")
    env.write.partitionBy("g").text(path)
    out = src_intel.read_ioc_cache(spark, path).drop("feed")  # one document holds several feeds
    return out.withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("[]")))


_TID_SQL = "'T' || CAST(1000 + p_partkey % 150 AS VARCHAR)"


@register(
    "attack_techniques",
    f"""SELECT {_TID_SQL} AS technique_id, p_name AS name, p_type AS description,
       'https://attack.mitre.org/techniques/' || {_TID_SQL} AS url
FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0""",
)
def q_attack_techniques(spark, sf_dir):
    """ATT&CK bundle documents scanned: attack-pattern objects only, id
    from the first mitre-attack reference, objects without one dropped."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tid = F.concat(F.lit("T"), (F.lit(1000) + k % 150).cast("string"))
    capec = F.struct(F.lit("capec").alias("source_name"), F.concat(F.lit("CAPEC-"), k.cast("string")).alias("external_id"))
    mitre = F.struct(F.lit("mitre-attack").alias("source_name"), tid.alias("external_id"))
    late = F.struct(F.lit("mitre-attack").alias("source_name"), F.lit("T0000").alias("external_id"))
    refs = F.when(k % 7 == 0, F.array(capec)).otherwise(F.array(capec, mitre, late))
    obj = F.struct(
        F.when(k % 10 == 0, F.lit("malware")).otherwise(F.lit("attack-pattern")).alias("type"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        refs.alias("external_references"),
    )
    objs = part.select(F.to_json(obj).alias("o"))
    path = scratch_path(spark, "bundle")
    _documents(objs, "o", '{"type": "bundle", "objects": [', "]}").write.partitionBy("g").text(path)
    return src_intel.read_attack_bundle(spark, path).drop("pos")


_LEVELS = ["low", "medium", "high", "critical"]


@register(
    "rule_table",
    f"""SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
       CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level,
       'selection and not filter' AS condition,
       CASE WHEN p_partkey % 13 = 0 THEN 'keyword selection ''keywords'' is not supported' END AS error,
       {_TID_SQL} AS technique_id,
       s.name AS selection_name, s.field, s.op,
       CASE s.k WHEN 0 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS value
FROM part, (VALUES ('selection', 'Image', 'contains', 0), ('filter', 'action', 'equals', 1)) s(name, field, op, k)""",
)
def q_rule_table(spark, sf_dir):
    """Rule files (several YAML documents per file, one per part) read
    and decoded; one row per (rule, selection, item value)."""
    from ravenhunt.operators.hunt import with_rule_attributes

    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    level = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("p_size") % 4 + 1).cast("int"))
    q = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    doc = F.concat(
        F.lit("title: "), q(F.col("p_name")), F.lit("\nid: part-"), k.cast("string"),
        F.lit("\nlevel: "), level,
        F.lit("\ntags:\n  - attack.discovery\n  - attack.t"), (F.lit(1000) + k % 150).cast("string"),
        F.lit("\ndetection:\n  selection:\n    Image|contains: "), q(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))),
        F.lit("\n  filter:\n    action: "), q(F.col("p_brand")),
        F.when(k % 13 == 0, F.lit("\n  keywords:\n    - a\n    - b")).otherwise(F.lit("")),
        F.lit("\n  condition: selection and not filter\n"),
    )
    files = part.groupBy(_doc_group()).agg(
        F.concat_ws("\n---\n", F.collect_list(doc)).alias("value")
    )
    path = scratch_path(spark, "rules")
    files.write.partitionBy("g").text(path)
    rules = with_rule_attributes(read_rules(spark, path, glob=None))
    sel = rules.select("id", "title", "level", "condition", "error", "technique_id", F.explode("selections").alias("s"))
    item = sel.select("*", F.explode("s.items").alias("i"))
    return item.select(
        "id", "title", "level", "condition", "error", "technique_id",
        F.col("s.name").alias("selection_name"), F.col("i.field").alias("field"), F.col("i.op").alias("op"),
        F.explode("i.values").alias("value"),
    )


_FEED_TYPE_BY_NATION = "CASE s_nationkey % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' ELSE 'mixed' END"


@register(
    "feed_config",
    f"""SELECT s_name AS name, 'https://feeds.example/' || CAST(s_suppkey AS VARCHAR) AS url,
       {_FEED_TYPE_BY_NATION} AS feed_type, CAST(s_suppkey % 24 + 1 AS BIGINT) AS update_interval,
       CASE WHEN s_suppkey % 5 = 0 THEN false ELSE true END AS enabled,
       CASE WHEN s_suppkey % 3 = 0 THEN '{{"X-Feed":"' || s_name || '"}}' END AS headers
FROM supplier""",
)
def q_feed_config(spark, sf_dir):
    """Feed configuration documents read and exploded; a feed without
    an ``enabled`` key is enabled."""
    sup = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    ftype = F.element_at(F.array(F.lit("ip"), F.lit("domain"), F.lit("mixed")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    feed = F.struct(
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://feeds.example/"), k.cast("string")).alias("url"),
        ftype.alias("feed_type"),
        (k % 24 + 1).alias("update_interval"),
        F.when(k % 5 == 0, F.lit(False)).alias("enabled"),
        F.when(k % 3 == 0, F.create_map(F.lit("X-Feed"), F.col("s_name"))).alias("headers"),
    )
    objs = sup.select(F.to_json(feed).alias("o"))
    path = scratch_path(spark, "feed-config")
    _documents(objs, "o", '{"mitre_update_interval": 24, "cache_directory": "data/cti/", "ioc_feeds": [', "]}") \
        .write.partitionBy("g").text(path)
    out = src_intel.read_feed_config(spark, path)
    return out.withColumn("headers", F.to_json("headers"))


@register(
    "file_manifest",
    """SELECT s_suppkey AS file_key, strlen(s_name || chr(10)) AS length, '.txt' AS extension,
       true AS extension_allowed, true AS size_ok, sha256(s_name || chr(10)) AS sha256 FROM supplier""",
)
def q_file_manifest(spark, sf_dir):
    """Size, type flags and SHA-256 of files: one text file per supplier is
    written and listed."""
    from ravenhunt.sources.files import file_manifest

    path = scratch_path(spark, "manifest")
    # a number of tasks of its own: the few bytes of the table would be put together into one
    tasks = spark.sparkContext.defaultParallelism * 4
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("value")).repartition(tasks, "s_suppkey")
    name = F.concat(F.lit("s_suppkey="), F.coalesce(F.col("s_suppkey").cast("string"), F.lit("none")))
    if not _write_files(rows.sortWithinPartitions("s_suppkey").select(name.alias("name"), "value"), path, ".txt"):
        rows.write.partitionBy("s_suppkey").text(path)
    return file_manifest(spark, path, glob="*.txt").select(
        F.regexp_extract("path", r"s_suppkey=(\d+)[/.]", 1).cast("long").alias("file_key"), "length", "extension",
        "extension_allowed", "size_ok", "sha256",
    )


# --------------------------------------------------------------- feed group
_IV = f"WITH iv AS ({iv.IOC_VIEW_SQL}) "


# One fetched document per page: feeds by page_id % 3, of which the third has
# none; every fortieth document breaks off.
_FETCHED_SQL = """SELECT CASE page_id % 3 WHEN 0 THEN 'feodotracker_ips' WHEN 1 THEN 'urlhaus_domains' ELSE 'retired_feed' END AS feed,
  page_id % 40 = 1 AS bad, TIMESTAMP '2024-01-30 00:00:00' + to_minutes(page_id % 1440) AS modified FROM pages"""
_STATUS_SQL = f"""SELECT f.name AS feed, CASE WHEN d.n IS NULL OR d.bad > 0 THEN 'failed' ELSE 'success' END AS status,
       coalesce(c.n, 0) AS ioc_count, f.feed_type, d.last_updated,
       CASE WHEN d.n IS NULL THEN 'no document'
            WHEN d.bad > 0 THEN CAST(d.bad AS VARCHAR) || ' of ' || CAST(d.n AS VARCHAR) || ' documents unreadable' END AS error
FROM ({iv.FEEDS_SQL}) f LEFT JOIN (SELECT feed, count(*) AS n FROM iv GROUP BY feed) c ON f.name = c.feed
LEFT JOIN (SELECT feed, count(*) AS n, CAST(sum(bad::INT) AS BIGINT) AS bad, max(modified) AS last_updated
           FROM ({_FETCHED_SQL}) GROUP BY feed) d ON f.name = d.feed
WHERE f.enabled"""


def _status(spark, sf_dir):
    pid = F.col("page_id")
    names = F.when(pid % 3 == 0, "feodotracker_ips").when(pid % 3 == 1, "urlhaus_domains").otherwise("retired_feed")
    text = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("value"))).alias("data")))
    fetched = read_table(spark, sf_dir, "pages").select(
        names.alias("feed"),
        F.when(pid % 40 == 1, F.left(text, F.length(text) - 2)).otherwise(text).alias("value"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp") + F.make_interval(mins=(pid % 1440).cast("int"))).alias("modificationTime"))
    return intel.feed_status(iv.feed_table(spark), iv.ioc_view(spark, sf_dir), intel.feed_documents(fetched))


@register("feed_status", _IV + _STATUS_SQL)
def q_feed_status(spark, sf_dir):
    """Status, IOC count, last update and error per enabled feed; one feed
    has unreadable documents, one has none."""
    return _status(spark, sf_dir)


@register(
    "cti_totals",
    _IV
    + f"""SELECT (SELECT count(DISTINCT 1000 + p_partkey % 150) FROM part) AS techniques_count,
       CAST((SELECT count(*) FROM iv WHERE feed IN (SELECT name FROM ({iv.FEEDS_SQL}) WHERE enabled)) AS BIGINT)
         AS total_iocs,
       (SELECT count(*) FROM ({iv.FEEDS_SQL}) WHERE enabled) AS feed_count,
       (SELECT count(*) FROM ({_STATUS_SQL}) WHERE status <> 'success') AS errors""",
)
def q_cti_totals(spark, sf_dir):
    """Technique count, total IOCs, feed count, failed feeds."""
    from ravenhunt.plans.catalog import part_techniques

    return intel.cti_totals(_status(spark, sf_dir), part_techniques(spark, sf_dir))


@register(
    "ioc_cache_envelope",
    _IV + f"SELECT feed, '{iv.NOW}' AS timestamp, count(*) AS count FROM iv GROUP BY feed",
)
def q_ioc_cache_envelope(spark, sf_dir):
    """K7: per-feed cache envelope (time, count); the IOC rows are written
    partitioned by feed next to it by ``sinks.write_ioc_cache``."""
    iocs = iv.ioc_view(spark, sf_dir)
    path = scratch_path(spark, "cache-write")
    exports.write_ioc_cache(iocs, path, iv.NOW)
    return spark.read.schema("feed string, timestamp string, count long").json(path + "/envelope")


_STALE_NOW = "2024-01-03 00:00:00"


@register(
    "feeds_stale",
    f"""WITH f AS (SELECT s_name AS feed, s_suppkey % 24 + 1 AS hours, s_suppkey % 5 <> 0 AS enabled,
  CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_minutes(s_suppkey * 37 % 1440) END AS last_updated
FROM supplier)
SELECT feed, last_updated, last_updated IS NULL OR last_updated < TIMESTAMP '{_STALE_NOW}' - to_hours(hours) AS stale
FROM f WHERE enabled""",
)
def q_feeds_stale(spark, sf_dir):
    """feeds whose cache is missing or older than their interval, on a
    manifest made from ``supplier`` (every fourth feed has no cache)."""
    k = F.col("s_suppkey")
    sup = read_table(spark, sf_dir, "supplier")
    feeds = sup.select(F.col("s_name").alias("name"), (k % 24 + 1).alias("update_interval"), (k % 5 != 0).alias("enabled"))
    start = F.lit("2024-01-02 00:00:00").cast("timestamp")
    manifest = sup.where(k % 4 != 0).select(
        F.col("s_name").alias("feed"), (start + F.make_interval(mins=(k * 37 % 1440).cast("int"))).alias("modificationTime"))
    return intel.feeds_stale(feeds, manifest, _STALE_NOW)


# ------------------------------------------------------------- exports group
def _ts_sql(c: str) -> str:
    return (
        f"strftime({c}, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 <> 0 "
        f"THEN printf('.%06d', epoch_us({c}) % 1000000) ELSE '' END"
    )


_FINDING_TEXT_SQL = ", ".join(
    f"coalesce({_ts_sql(c) if c == 'timestamp' else f'CAST({c} AS VARCHAR)'}, 'nan') AS {c}"
    for c in [
        "timestamp", "hostname", "username", "process_name", "hunting_rule_id", "hunting_rule_title", "rule_level",
        "mitre_technique_id", "mitre_technique_name", "risk_score", "mitre_technique_url", "event_id", "message",
        "source_ip", "destination_ip", "action",
    ]
)


@register("export_findings", HUNT_WITH + f"SELECT {_FINDING_TEXT_SQL} FROM hunt")
def q_export_findings(spark, sf_dir):
    """K1: the findings as CSV text columns, nulls as 'nan'."""
    return exports.findings_csv_frame(findings(spark, sf_dir))


@register(
    "siem_json",
    HUNT_WITH
    + f"""SELECT {_ts_sql('timestamp')} AS timestamp, 'threat_hunting_platform' AS source, 'threat_detection' AS event_type,
       rule_level AS severity, risk_score, hostname, username, process_name, hunting_rule_id AS rule_id,
       hunting_rule_title AS rule_title, mitre_technique_id AS technique_id, mitre_technique_name AS technique_name,
       mitre_technique_url AS technique_url, message AS raw_message, source_ip, destination_ip, action FROM hunt""",
)
def q_siem_json(spark, sf_dir):
    """K2: SIEM records written as JSON Lines and read back (the nested
    technique as columns)."""
    path = scratch_path(spark, "siem")
    frame = exports.siem_frame(findings(spark, sf_dir))
    exports.write_siem_json(findings(spark, sf_dir), path)
    back = spark.read.schema(frame.schema).json(path)
    return back.select(*[c for c in back.columns if c != "mitre_technique"],
                       *[F.col(f"mitre_technique.{c}").alias(f"technique_{c}") for c in ("id", "name", "url")])


@register(
    "summary_json",
    HUNT_WITH
    + """, top AS (SELECT mitre_technique_name AS name, count(*) AS n FROM hunt WHERE mitre_technique_name IS NOT NULL
               GROUP BY 1 ORDER BY n DESC, name LIMIT 5)
SELECT 'technique' AS part, name, CAST(n AS VARCHAR) AS value FROM top
UNION ALL SELECT 'stage', coalesce(m.tactic, 'Unknown'), CAST(count(*) AS VARCHAR)
FROM hunt LEFT JOIN (VALUES ('T1059', 'Execution'), ('T1003', 'Credential Access'), ('T1049', 'Discovery'),
  ('T1047', 'Execution'), ('T1083', 'Discovery'), ('T1082', 'Discovery')) m(base, tactic)
  ON split_part(coalesce(mitre_technique_id, 'None'), '.', 1) = m.base GROUP BY 2
UNION ALL SELECT 'total', 'findings', CAST(count(*) AS VARCHAR) FROM hunt
UNION ALL SELECT 'total', 'techniques', CAST(count(DISTINCT mitre_technique_id) AS VARCHAR) FROM hunt
UNION ALL SELECT 'total', 'hosts', CAST(count(DISTINCT hostname) AS VARCHAR) FROM hunt
UNION ALL SELECT 'total', 'users', CAST(count(DISTINCT username) AS VARCHAR) FROM hunt
UNION ALL SELECT 'risk', 'high', CAST(count_if(risk_score >= 80) AS VARCHAR) FROM hunt
UNION ALL SELECT 'risk', 'low', CAST(count_if(risk_score < 50) AS VARCHAR) FROM hunt""",
)
def q_summary_json(spark, sf_dir):
    """K5: the nested summary written as JSON and read back, its parts as rows."""
    path = scratch_path(spark, "summary-json")
    exports.write_summary_json(findings(spark, sf_dir), path)
    back = spark.read.schema(exports.SUMMARY_JSON).json(path)
    pairs = lambda part, entries: F.transform(entries, lambda e: F.struct(
        F.lit(part).alias("part"), e["key"].alias("name"), e["value"].cast("string").alias("value")))
    one = lambda part, name, c: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.col(c).cast("string").alias("value"))
    return back.select(F.inline(F.concat(
        pairs("technique", F.map_entries("attack_patterns.top_techniques")),
        pairs("stage", F.map_entries("attack_patterns.attack_stages")),
        F.array(one("total", "findings", "total_findings"), one("total", "techniques", "unique_techniques"),
                one("total", "hosts", "affected_infrastructure.hosts"), one("total", "users", "affected_infrastructure.users"),
                one("risk", "high", "risk_distribution.high"), one("risk", "low", "risk_distribution.low")))))


@register(
    "siem_cef",
    HUNT_WITH
    + """SELECT 'CEF:0|ThreatHunter|AutomatedHuntingPlatform|1.0|' || hunting_rule_id || '|' || hunting_rule_title
  || '|' || CAST(risk_score AS VARCHAR) || '|src=' || coalesce(source_ip, 'nan') || ' dst=' || coalesce(destination_ip, 'nan')
  || ' suser=' || coalesce(username, 'nan') || ' dhost=' || coalesce(hostname, 'nan')
  || ' cs1=' || coalesce(mitre_technique_id, 'nan') || ' cs1Label=MITRE_Technique cs2=' || coalesce(process_name, 'nan')
  || ' cs2Label=Process_Name msg=' || coalesce(message, 'nan') AS cef FROM hunt""",
)
def q_siem_cef(spark, sf_dir):
    """K3: CEF lines of the findings, written as text and read back."""
    path = scratch_path(spark, "cef")
    exports.write_cef(findings(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "cef")


@register(
    "extracted_iocs_file",
    HUNT_WITH
    + """SELECT DISTINCT kind, value FROM (
  SELECT 'ip_addresses' AS kind, source_ip AS value FROM hunt UNION ALL SELECT 'ip_addresses', destination_ip FROM hunt
  UNION ALL SELECT 'processes', process_name FROM hunt UNION ALL SELECT 'users', username FROM hunt
  UNION ALL SELECT 'hosts', hostname FROM hunt UNION ALL SELECT 'techniques', mitre_technique_id FROM hunt)
WHERE value IS NOT NULL""",
)
def q_extracted_iocs_file(spark, sf_dir):
    """K4: the extracted indicators written as JSON Lines by kind and read back."""
    path = scratch_path(spark, "extracted")
    exports.write_extracted_iocs(findings(spark, sf_dir), path)
    return spark.read.schema("value string, kind string").json(path)


@register(
    "ioc_store",
    f"""WITH iv AS ({iv.ioc_sql(iv.FEED_OBJECTS_SQL, with_tags=True)})
SELECT value, type, source, coalesce(confidence, 'medium') AS confidence, timestamp, tags,
       coalesce(description, '') AS description FROM iv""",
)
def q_ioc_store(spark, sf_dir):
    """K6: the IOC store (tags as JSON text), written in two appends
    partitioned by type, and read back."""
    path = scratch_path(spark, "store")
    iocs = iv.ioc_view(spark, sf_dir)
    exports.write_ioc_store(iocs.where("type = 'ip'"), path)
    exports.write_ioc_store(iocs.where("type <> 'ip' or type is null"), path)
    columns = exports.ioc_store_frame(iocs).columns
    return spark.read.parquet(path).select(*columns)


# ------------------------------------------------------------ profile group
_LINEITEM = [
    ("l_orderkey", "bigint", "int"), ("l_partkey", "bigint", "int"), ("l_suppkey", "bigint", "int"),
    ("l_linenumber", "int", "int"), ("l_quantity", "double", "float"), ("l_extendedprice", "double", "float"),
    ("l_discount", "double", "float"), ("l_tax", "double", "float"), ("l_returnflag", "string", "text"),
    ("l_linestatus", "string", "text"), ("l_shipdate", "timestamp_ntz", "other"),
]


def _suggest_sql(kind: str, dtype: str) -> str:
    if kind == "int":
        return ("CASE WHEN min(c) >= -128 AND max(c) <= 127 THEN 'tinyint' WHEN min(c) >= -32768 AND max(c) <= 32767 "
                "THEN 'smallint' WHEN min(c) >= -2147483648 AND max(c) <= 2147483647 THEN 'int' ELSE 'bigint' END")
    if kind == "float":
        return "'float'"
    if kind == "text":
        return f"CASE WHEN count(DISTINCT c) / count(*) < 0.5 THEN 'category' ELSE '{dtype}' END"
    return f"'{dtype}'"


_PROFILE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS column_name, '{dtype}' AS data_type, count(*) AS row_count,
       count(DISTINCT c) AS distinct_count, CAST(min(c) AS VARCHAR) AS min_value, CAST(max(c) AS VARCHAR) AS max_value,
       round(count(DISTINCT c) / count(*), 6) AS unique_ratio, {_suggest_sql(kind, dtype)} AS suggested_type
FROM (SELECT {name} AS c FROM lineitem)"""
    for name, dtype, kind in _LINEITEM
)


@register("column_profile", _PROFILE_SQL)
def q_column_profile(spark, sf_dir):
    """Per-column rows, exact distinct count, min/max, suggested type."""
    return profile.column_profile(read_table(spark, sf_dir, "lineitem"), exact=True)


@register(
    "size_profile",
    """WITH b AS (SELECT count(*) AS n,
  sum(strlen(CAST(event_id AS VARCHAR))) AS b0, sum(strlen(CAST(ts AS VARCHAR))) AS b1,
  sum(strlen(CAST(user_id AS VARCHAR))) AS b2, sum(strlen(event_type)) AS b3, sum(strlen(CAST(value AS VARCHAR))) AS b4,
  sum(strlen(props)) AS b5 FROM events)
SELECT n AS row_count, 6 AS column_count, c AS column_name, CAST(bytes AS BIGINT) AS bytes,
       c = '__total__' AND (n > 1000000 OR bytes > 524288000) AS over_limit
FROM b, LATERAL (VALUES ('event_id', b0), ('ts', b1), ('user_id', b2), ('event_type', b3), ('value', b4),
                        ('props', b5), ('__total__', b0 + b1 + b2 + b3 + b4 + b5)) t(c, bytes)""",
)
def q_size_profile(spark, sf_dir):
    """Text bytes per column and in total, with the limit flag."""
    return profile.size_profile(read_table(spark, sf_dir, "events"))


_NARROW_SQL = (
    "SELECT " + ", ".join(
        f"CAST(CAST({n} AS FLOAT) AS DOUBLE) AS {n}" if k == "float" else f"{n}" if k != "other" else f"CAST({n} AS VARCHAR) AS {n}"
        for n, _, k in _LINEITEM)
    + ", " + ", ".join(
        (f"(SELECT {_suggest_sql(k, d)} FROM (SELECT {n} AS c FROM lineitem)) AS {n}_type" if k == "int"
         else f"'{'float' if k == 'float' else d}' AS {n}_type")
        for n, d, k in _LINEITEM)
    + " FROM lineitem"
)


@register("narrow_types", _NARROW_SQL)
def q_narrow_types(spark, sf_dir):
    """Lineitem rewritten with the smallest fitting types: every value
    after the change, and each column's new type."""
    li = read_table(spark, sf_dir, "lineitem")
    out = profile.narrow_types(li, profile.column_profile(li, exact=False))
    wide = {"int": "long", "float": "double", "text": "string", "other": "string"}
    return out.select(*[F.col(n).cast(wide[k]).alias(n) for n, _, k in _LINEITEM],
                      *[F.typeof(F.col(n)).alias(f"{n}_type") for n, _, _ in _LINEITEM])


@register("observed_counts", HUNT_WITH + "SELECT count(*) AS row_count, max(risk_score) AS max_risk FROM hunt")
def q_observed_counts(spark, sf_dir):
    """Run metrics via ``observe`` while the findings are written: the metrics."""
    df, obs = profile.observed(findings(spark, sf_dir), "hunt")
    df.write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame([(obs.get["row_count"], obs.get["max_risk"])], "row_count long, max_risk int")


# -------------------------------------------------------------- burst group
BURST_MAX = 3
BURST_WINDOW_S = 2 * 86400


BURST_SQL = f"""WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_id) AS rn FROM events),
r AS (
  SELECT event_id, user_id, rn, true AS admitted, [t] AS st FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.rn,
         len(list_filter(r.st, lambda x: e.t - x < {BURST_WINDOW_S * 1_000_000})) < {BURST_MAX},
         CASE WHEN len(list_filter(r.st, lambda x: e.t - x < {BURST_WINDOW_S * 1_000_000})) < {BURST_MAX}
              THEN list_append(list_filter(r.st, lambda x: e.t - x < {BURST_WINDOW_S * 1_000_000}), e.t)
              ELSE list_filter(r.st, lambda x: e.t - x < {BURST_WINDOW_S * 1_000_000}) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, admitted FROM r"""


@register("burst_flags", BURST_SQL)
def q_burst_flags(spark, sf_dir):
    """Per user, admit an event when fewer than 3 admitted events lie in
    the previous 2 days; every event keeps its flag."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return burst_flags(ev, "user_id", "ts", BURST_MAX, BURST_WINDOW_S).select("event_id", "user_id", "admitted")


# ------------------------------------------------------------- stream group
def _log_files(spark, sf_dir, name):
    """(folder, how to read it): the log view as CSV files of one header, no more
    of them than cores, as each is split on reading and a micro-batch goes over
    all state; whether texts hold line breaks is seen as they are written."""
    path, seen = scratch_path(spark, name), Observation()
    logs = log_view(spark, sf_dir)
    text = F.concat_ws("", *[c for c, t in logs.dtypes if t == "string"])
    logs = logs.observe(seen, F.bool_or(text.rlike("[\r\n]")).alias("breaks")).coalesce(spark.sparkContext.defaultParallelism)
    _as_source(logs, src_logs.CSV_COLUMN_MAP).write.options(**CSV_WRITE).csv(path)
    return path, {"header": list(src_logs.CSV_COLUMN_MAP), "multi_line": bool(seen.get["breaks"])}


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover
        raise query.exception()


@register("stream_ingest", _LV + f"SELECT {_LV_COLS}, {_HALF_ACTION} FROM lv")
def q_stream_ingest(spark, sf_dir):
    """ST1: log files under two headers ingested as a stream (2 files per micro-batch)."""
    src = scratch_path(spark, "st-in")
    _two_headers(spark, sf_dir, src)
    out, ckpt = scratch_path(spark, "st-in-out"), scratch_path(spark, "st-in-ckpt")
    _run(jobs.start_ingest(src_logs.read_log_stream(spark, src, "csv", max_files_per_trigger=2), out, ckpt))
    return spark.read.parquet(out)


@register("stream_hunt", HUNT_WITH + "SELECT * FROM hunt")
def q_stream_hunt(spark, sf_dir):
    """ST2: the hunt on a log stream, de-duplicated within the watermark."""
    src, kind = _log_files(spark, sf_dir, "st-hunt")
    out, ckpt = scratch_path(spark, "st-hunt-out"), scratch_path(spark, "st-hunt-ckpt")
    stream = src_logs.read_log_stream(spark, src, "csv", max_files_per_trigger=2, **kind)
    _run(jobs.start_hunt(stream, rule_table(spark), technique_table(spark), out, ckpt, watermark="3650 days", untimed_path=out + "-untimed"))
    return jobs.read_epochs(spark, out).unionByName(jobs.read_untimed(spark, out + "-untimed"))


@register(
    "stream_hourly",
    HUNT_WITH
    + """SELECT date_trunc('hour', timestamp) AS window_start, date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS window_end,
       count(*) AS finding_count FROM hunt GROUP BY 1, 2""",
)
def q_stream_hourly(spark, sf_dir):
    """ST3: finding counts per one-hour event-time window on a stream."""
    src, kind = _log_files(spark, sf_dir, "st-hour")
    # the row that ends the stream: its time lets the watermark pass every hour before
    last = log_view(spark, sf_dir).agg((F.max("timestamp") + F.expr("INTERVAL 3700 DAYS")).alias("timestamp"))
    last = last.select(*[F.col(c) if c == "timestamp" else F.lit(None).cast(LOG_SCHEMA[c].dataType).alias(c) for c in LOG_COLUMNS])
    _as_source(last, src_logs.CSV_COLUMN_MAP).write.options(**CSV_WRITE).mode("append").csv(src)
    out, ckpt = scratch_path(spark, "st-hour-out"), scratch_path(spark, "st-hour-ckpt")
    stream = src_logs.read_log_stream(spark, src, "csv", max_files_per_trigger=2, **kind)
    findings_stream = jobs.hunt_stream(stream, rule_table(spark), technique_table(spark), watermark="3650 days")
    _run(jobs.start_hourly(findings_stream, out, ckpt, watermark=None))
    return jobs.read_epochs(spark, out)


@register("stream_burst", BURST_SQL)
def q_stream_burst(spark, sf_dir):
    """ST4: burst flags with per-user state on an event stream: four micro-batches
    out of time order, held until a watermark has passed them."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    src = scratch_path(spark, "st-burst")
    low, high, top = ev.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts")), F.max("event_id")).first()
    size = top // 4 + 1
    late = F.pmod(F.xxhash64("event_id"), F.lit(size))  # an event comes up to a quarter of the table late
    for k in range(5):  # a file, and so a micro-batch, each
        ev.where(F.floor((F.col("event_id") + late) / size) == k).coalesce(1).write.mode("append").parquet(src)
    delay = high - low
    last = spark.range(1).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(ev.schema["user_id"].dataType).alias("user_id"),
                                 F.timestamp_seconds(F.lit(high + delay + 2 * BURST_WINDOW_S)).alias("ts"))
    last.write.mode("append").parquet(src)  # ends the stream
    out, ckpt = scratch_path(spark, "st-burst-out"), scratch_path(spark, "st-burst-ckpt")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    _run(jobs.start_burst(stream, "user_id", "ts", BURST_MAX, BURST_WINDOW_S, out, ckpt, watermark=f"{delay} seconds"))
    return spark.read.parquet(out).filter("event_id is not null").select("event_id", "user_id", "admitted")

