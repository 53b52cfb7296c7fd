"""Stand-in inputs derived from the driver tables.

The driver tables hold no security log, so ``log_view`` maps ``events`` onto
the log schema with deterministic expressions (valid in Spark and DuckDB);
``ioc_view`` draws indicators from ``pages`` (URLs, hosts) and ``documents``
(IPv4 texts, 40-hex hashes). These views only give rows in the expected
schema; all detection, enrichment and reporting runs in the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.session import read_table

# --- fixed values: process names by event_id % 8 and command lines by
# event_id % 5 used to give the event table a log shape -------------------
PROCESSES = [
    "powershell.exe",
    "cmd.exe",
    "calc.exe",
    "explorer.exe",
    "netstat.exe",
    "wmic.exe",
    "pwsh.exe",
    "rundll32.exe",
]
COMMANDS = [
    "powershell.exe -enc base64content",
    "wmic process list shadowcopy",
    "netstat -an",
    "Process started",
    "rundll32 comsvcs.dll MiniDump lsass.exe",
]
# ----------------------------------------------------------------------------


def _case(expr: F.Column, values: list[str]) -> F.Column:
    out = F.lit(None).cast("string")
    for i in reversed(range(len(values))):
        out = F.when(expr == i, F.lit(values[i])).otherwise(out)
    return out


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("HOST-"), (uid % 20).cast("string")).alias("hostname"),
        F.concat(F.lit("user"), uid.cast("string")).alias("username"),
        _case(eid % 8, PROCESSES).alias("process_name"),
        eid.alias("event_id"),
        F.concat(_case(eid % 5, COMMANDS), F.lit(" "), F.col("props")).alias("message"),
        F.when(
            eid % 3 != 0,
            F.concat_ws(".", F.lit("10"), F.lit("0"), (uid % 256).cast("string"), (eid % 256).cast("string")),
        ).alias("source_ip"),
        F.when(
            eid % 4 != 0,
            F.concat_ws(".", F.lit("192"), F.lit("168"), (uid % 7).cast("string"), (eid % 200).cast("string")),
        ).alias("destination_ip"),
        F.col("event_type").alias("action"),
    )


LOG_VIEW_SQL = """
SELECT CAST(ts AS TIMESTAMP) AS timestamp,
       'HOST-' || CAST(user_id % 20 AS VARCHAR) AS hostname,
       'user' || CAST(user_id AS VARCHAR) AS username,
       CASE event_id % 8 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'calc.exe'
            WHEN 3 THEN 'explorer.exe' WHEN 4 THEN 'netstat.exe' WHEN 5 THEN 'wmic.exe'
            WHEN 6 THEN 'pwsh.exe' WHEN 7 THEN 'rundll32.exe' END AS process_name,
       event_id,
       CASE event_id % 5 WHEN 0 THEN 'powershell.exe -enc base64content'
            WHEN 1 THEN 'wmic process list shadowcopy' WHEN 2 THEN 'netstat -an'
            WHEN 3 THEN 'Process started' WHEN 4 THEN 'rundll32 comsvcs.dll MiniDump lsass.exe' END
         || ' ' || props AS message,
       CASE WHEN event_id % 3 <> 0 THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.'
            || CAST(event_id % 256 AS VARCHAR) END AS source_ip,
       CASE WHEN event_id % 4 <> 0 THEN '192.168.' || CAST(user_id % 7 AS VARCHAR) || '.'
            || CAST(event_id % 200 AS VARCHAR) END AS destination_ip,
       event_type AS action
FROM events
"""
