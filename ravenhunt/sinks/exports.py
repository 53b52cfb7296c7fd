"""K1-K7: exports. Each ``*_frame`` function returns the DataFrame that is
written (so it can be checked), each ``write_*`` writes it with Spark.

Outputs are written as part files by every task in parallel. Where the
reference writes one JSON array or one object holding whole lists (SIEM
array, extracted-IOC lists, IOC cache envelope), we write JSON Lines / a
table partitioned by kind or feed instead, so no record holds an unbounded
list and no single task writes everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenhunt.operators import report
from ravenhunt.session import scratch_table
from ravenhunt.schemas import FINDING_COLUMNS

# --- fixed values (must equal the reference's behaviour) -------------------
NULL_TOKEN = "nan"
SIEM_SOURCE = "threat_hunting_platform"
SIEM_EVENT_TYPE = "threat_detection"
CEF_HEADER = "CEF:0|ThreatHunter|AutomatedHuntingPlatform|1.0|"
CEF_TECHNIQUE_LABEL = "MITRE_Technique"
CEF_PROCESS_LABEL = "Process_Name"
DEFAULT_IOC_CONFIDENCE = "medium"
# ----------------------------------------------------------------------------


def ts_text(c: Column) -> Column:
    """Timestamp as pandas prints it: seconds, plus micros only when non-zero."""
    base = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    micros = F.unix_micros(c) % 1_000_000
    return F.when(micros != 0, F.concat(base, F.format_string(".%06d", micros))).otherwise(base)


def _text(c: str, null_token: str) -> Column:
    col = F.col(c)
    if c == "timestamp":
        col = ts_text(col)
    return F.coalesce(col.cast("string"), F.lit(null_token))


def findings_csv_frame(findings: DataFrame, null_token: str = NULL_TOKEN) -> DataFrame:
    """K1: the 16 finding columns as text, nulls shown as ``nan``."""
    return findings.select(*[_text(c, null_token).alias(c) for c in FINDING_COLUMNS])


def write_findings_csv(findings: DataFrame, path: str, null_token: str = NULL_TOKEN, sort: bool = True) -> None:
    out = findings.orderBy("timestamp", "hunting_rule_id") if sort else findings
    findings_csv_frame(out, null_token).write.mode("overwrite").option("header", True).csv(path)


def siem_frame(findings: DataFrame) -> DataFrame:
    """K2: SIEM records with fixed source/event type and nested technique."""
    return findings.select(
        ts_text(F.col("timestamp")).alias("timestamp"),
        F.lit(SIEM_SOURCE).alias("source"),
        F.lit(SIEM_EVENT_TYPE).alias("event_type"),
        F.col("rule_level").alias("severity"),
        "risk_score",
        "hostname",
        "username",
        "process_name",
        F.col("hunting_rule_id").alias("rule_id"),
        F.col("hunting_rule_title").alias("rule_title"),
        F.struct(
            F.col("mitre_technique_id").alias("id"),
            F.col("mitre_technique_name").alias("name"),
            F.col("mitre_technique_url").alias("url"),
        ).alias("mitre_technique"),
        F.col("message").alias("raw_message"),
        "source_ip",
        "destination_ip",
        "action",
    )


def write_siem_json(findings: DataFrame, path: str) -> None:
    siem_frame(findings).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cef_escape(c: Column, header: bool) -> Column:
    """CEF escaping: backslash first; '|' in header fields, '=' in extension
    values; newlines as \\n."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    if header:
        out = F.replace(out, F.lit("|"), F.lit("\\|"))
    else:
        out = F.replace(out, F.lit("="), F.lit("\\="))
    return F.replace(F.replace(out, F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))


def cef_frame(findings: DataFrame, null_token: str = NULL_TOKEN, escape: bool = False) -> DataFrame:
    """K3: one CEF line per finding (no escaping unless ``escape=True``)."""

    def f(c, header=False):
        v = _text(c, null_token)
        return cef_escape(v, header) if escape else v

    line = F.concat(
        F.lit(CEF_HEADER),
        f("hunting_rule_id", True), F.lit("|"),
        f("hunting_rule_title", True), F.lit("|"),
        f("risk_score", True), F.lit("|"),
        F.lit("src="), f("source_ip"),
        F.lit(" dst="), f("destination_ip"),
        F.lit(" suser="), f("username"),
        F.lit(" dhost="), f("hostname"),
        F.lit(" cs1="), f("mitre_technique_id"),
        F.lit(f" cs1Label={CEF_TECHNIQUE_LABEL} cs2="), f("process_name"),
        F.lit(f" cs2Label={CEF_PROCESS_LABEL} msg="), f("message"),
    )
    return findings.select(line.alias("cef"))


def write_cef(findings: DataFrame, path: str, escape: bool = False) -> None:
    cef_frame(findings, escape=escape).write.mode("overwrite").text(path)


def write_extracted_iocs(findings: DataFrame, path: str) -> None:
    """K4: distinct (kind, value) as JSON Lines, one folder per kind."""
    report.extracted_iocs(findings).write.mode("overwrite").partitionBy("kind").json(path)


SUMMARY_JSON = (
    "total_findings long, unique_techniques long, risk_assessment string, risk_distribution struct<high: long, medium: long, low: long>, "
    "affected_infrastructure struct<hosts: long, users: long, total_events: long>, "
    "attack_patterns struct<top_techniques: map<string, long>, attack_stages: map<string, long>>, recommendations array<string>"
)
SUMMARY_COLUMNS = ["timestamp", "hostname", "username", "risk_score", "mitre_technique_id", "mitre_technique_name"]


def summary_frame(findings: DataFrame) -> DataFrame:
    """K5: the nested executive summary as one row. The nested parts are
    small by construction (<= 5 techniques, one row per tactic, <= 8
    recommendations), so collecting them into the row is bounded. The findings'
    six columns are written once and all parts read that, so the hunt behind
    them runs once."""
    findings = scratch_table(findings.select(*SUMMARY_COLUMNS), "summary")
    s = report.executive_summary(findings)
    top = report.top_techniques(findings).agg(
        F.map_from_entries(F.collect_list(F.struct("technique_name", "finding_count"))).alias("top_techniques")
    )
    stages = report.attack_stages(findings).agg(
        F.map_from_entries(F.collect_list(F.struct("tactic", "finding_count"))).alias("attack_stages")
    )
    recs = report.recommendations(findings).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rec_order", "recommendation"))), lambda x: x["recommendation"])
        .alias("recommendations")
    )
    row = s.crossJoin(top).crossJoin(stages).crossJoin(recs)
    return row.select(
        "status",
        "total_findings",
        "unique_techniques",
        "risk_assessment",
        F.struct(F.col("risk_high").alias("high"), F.col("risk_medium").alias("medium"),
                 F.col("risk_low").alias("low")).alias("risk_distribution"),
        F.struct("hosts", "users", "total_events").alias("affected_infrastructure"),
        F.struct("top_techniques", "attack_stages").alias("attack_patterns"),
        F.struct(
            ts_text(F.col("earliest_detection")).alias("earliest_detection"),
            ts_text(F.col("latest_detection")).alias("latest_detection"),
            F.col("duration"),
        ).alias("timeline"),
        "recommendations",
        "recommendation",
    )


def write_summary_json(findings: DataFrame, path: str) -> None:
    summary_frame(findings).coalesce(1).write.mode("overwrite").json(path)


def ioc_store_frame(iocs: DataFrame, dedupe: bool = False) -> DataFrame:
    """K6: store rows - confidence defaults to medium, tags as JSON text,
    description defaults to ''. Duplicates pile up unless ``dedupe``."""
    out = iocs.select(
        "value",
        "type",
        "source",
        F.coalesce(F.col("confidence"), F.lit(DEFAULT_IOC_CONFIDENCE)).alias("confidence"),
        "timestamp",
        F.to_json(F.coalesce(F.col("tags"), F.array().cast("array<string>"))).alias("tags"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )
    return out.dropDuplicates(["value", "type", "source"]) if dedupe else out


def write_ioc_store(iocs: DataFrame, path: str, dedupe: bool = False) -> None:
    ioc_store_frame(iocs, dedupe).write.mode("append").partitionBy("type").parquet(path)


def ioc_cache_envelope(iocs: DataFrame, now: str) -> DataFrame:
    """K7 metadata: per feed the cache time and IOC count."""
    return iocs.groupBy("feed").agg(F.count(F.lit(1)).alias("count")).select(
        "feed", F.lit(now).alias("timestamp"), "count"
    )


def write_ioc_cache(iocs: DataFrame, path: str, now: str) -> None:
    """K7: envelope table + the IOC rows as JSON Lines partitioned by feed."""
    ioc_cache_envelope(iocs, now).write.mode("overwrite").json(f"{path.rstrip('/')}/envelope")
    iocs.write.mode("overwrite").partitionBy("feed").json(f"{path.rstrip('/')}/iocs")
