"""Fixed schemas of the engine: normalised log, finding, rule, technique, IOC."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.names

# Columns the rules see as text (event_id included, as text).
RULE_VISIBLE_COLUMNS = [
    "process_name",
    "event_id",
    "message",
    "source_ip",
    "destination_ip",
    "hostname",
    "username",
]

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("hunting_rule_id", T.StringType()),
        T.StructField("hunting_rule_title", T.StringType()),
        T.StructField("rule_level", T.StringType()),
        T.StructField("mitre_technique_id", T.StringType()),
        T.StructField("mitre_technique_name", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("mitre_technique_url", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)
FINDING_COLUMNS = FINDING_SCHEMA.names

DETECTION_ITEM = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
    ]
)
SELECTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("items", T.ArrayType(DETECTION_ITEM)),
    ]
)
RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("selections", T.ArrayType(SELECTION)),
        T.StructField("condition", T.StringType()),
        T.StructField("logsource", T.MapType(T.StringType(), T.StringType())),
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

TECHNIQUE_SCHEMA = T.StructType(
    [
        T.StructField("technique_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

IOC_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("feed", T.StringType()),
    ]
)

FEED_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("feed_type", T.StringType()),
        T.StructField("update_interval", T.LongType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
