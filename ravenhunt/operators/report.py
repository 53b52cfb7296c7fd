"""Summaries and rankings over a findings DataFrame.

All are ordinary aggregations: one global ``agg`` (partial aggregation on
every partition, one tiny final merge) or a ``groupBy`` on a low-cardinality
key. Arrays are returned in long form (one row per element) so that results
compare as sets. Top-k results order ties by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravenhunt.operators.joins import sized_broadcast

# --- fixed values (must equal the reference's behaviour) -------------------
HIGH_RISK = 80
MEDIUM_RISK = 50
MEDIUM_COUNT_FOR_MEDIUM = 3  # overall MEDIUM when more than 3 medium findings
EMPTY_STATUS = "No threats detected"
EMPTY_RECOMMENDATION = "Continue routine monitoring"
RECOMMENDATIONS = [
    ("powershell", "Implement PowerShell logging and monitoring (Event ID 4104)"),
    ("powershell", "Consider PowerShell Constrained Language Mode for non-admin users"),
    ("credential", "Review privileged account security and implement credential guard"),
    ("credential", "Audit recent password changes and suspicious logon activity"),
    ("discovery", "Monitor network scanning and reconnaissance activities"),
    ("discovery", "Implement network segmentation to limit lateral movement"),
]
HIGH_RISK_RECOMMENDATION = "Immediate investigation required for {n} high-risk findings"
ISOLATE_RECOMMENDATION = "Consider isolating affected systems pending investigation"
DEFAULT_RECOMMENDATIONS = [
    "Continue routine threat hunting activities",
    "Review and update detection rules based on current findings",
    "Validate findings through additional log analysis",
]
EMPTY_IOC_VALUES = ["nan", "none", ""]
TACTICS = {
    "T1059": "Execution",
    "T1003": "Credential Access",
    "T1049": "Discovery",
    "T1047": "Execution",
    "T1083": "Discovery",
    "T1082": "Discovery",
}
UNKNOWN_TACTIC = "Unknown"
TOP_TECHNIQUES = 5
TOP_SHARE = 8
TOP_PER_SCENARIO = 3
#: What daily sketches count, and the bits of their registers' number (an error of about 1.6 %).
COUNTED = {"techniques": "mitre_technique_id", "hosts": "hostname", "users": "username"}
SKETCH_BITS = 12
# ----------------------------------------------------------------------------


def _risk() -> Column:
    return F.col("risk_score").cast("double")


def duration_text(micros: Column) -> Column:
    """Elapsed time as ``D days HH:MM:SS[.ffffff]`` (pandas Timedelta text)."""
    total_s = F.floor(micros / F.lit(1_000_000))
    frac = micros - total_s * F.lit(1_000_000)
    days = F.floor(total_s / F.lit(86400))
    rem = total_s - days * F.lit(86400)
    base = F.format_string(
        "%d days %02d:%02d:%02d",
        days.cast("long"),
        F.floor(rem / 3600).cast("long"),
        F.floor((rem % 3600) / 60).cast("long"),
        (rem % 60).cast("long"),
    )
    return F.when(frac > 0, F.concat(base, F.format_string(".%06d", frac.cast("long")))).otherwise(base)


def risk_counts(findings: DataFrame) -> list[Column]:
    return [
        F.count_if(_risk() >= HIGH_RISK).alias("risk_high"),
        F.count_if((_risk() >= MEDIUM_RISK) & (_risk() < HIGH_RISK)).alias("risk_medium"),
        F.count_if(_risk() < MEDIUM_RISK).alias("risk_low"),
    ]


def overall_risk_col(high: Column, medium: Column) -> Column:
    return (
        F.when(high > 0, F.lit("HIGH"))
        .when(medium > MEDIUM_COUNT_FOR_MEDIUM, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def executive_summary(findings: DataFrame) -> DataFrame:
    """A0: one row with A1-A5, A8 and the recommendation count.

    Empty input gives total 0, ``LOW``, and the 'no threats' status and
    recommendation; the other columns are then null/0.
    """
    s = findings.agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_distinct("mitre_technique_id").alias("unique_techniques"),
        *risk_counts(findings),
        F.count_distinct("hostname").alias("hosts"),
        F.count_distinct("username").alias("users"),
        F.min("timestamp").alias("earliest_detection"),
        F.max("timestamp").alias("latest_detection"),
    )
    micros = F.unix_micros(F.col("latest_detection")) - F.unix_micros(F.col("earliest_detection"))
    empty = F.col("total_findings") == 0
    return s.select(
        F.when(empty, F.lit(EMPTY_STATUS)).alias("status"),
        "total_findings",
        "unique_techniques",
        overall_risk_col(F.col("risk_high"), F.col("risk_medium")).alias("risk_assessment"),
        "risk_high",
        "risk_medium",
        "risk_low",
        "hosts",
        "users",
        F.col("total_findings").alias("total_events"),
        "earliest_detection",
        "latest_detection",
        (micros / F.lit(1_000_000.0)).alias("duration_seconds"),
        duration_text(micros).alias("duration"),
        F.when(empty, F.lit(EMPTY_RECOMMENDATION)).alias("recommendation"),
    )


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(column, SKETCH_BITS))


def distinct_techniques(findings: DataFrame, exact: bool = True) -> DataFrame:
    """A2: number of distinct technique ids (nulls excluded); ``exact=False``
    estimates it by a sketch, without a shuffle of the ids."""
    return findings.agg(_distinct("mitre_technique_id", exact).alias("unique_techniques"))


def daily_sketches(findings: DataFrame) -> DataFrame:
    """One row per day (null: without a time): the finding count and a
    HyperLogLog sketch of each thing counted. A table of these can be merged
    over any set of days, and appended to day by day, without the findings."""
    return findings.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("finding_count"), *[F.hll_sketch_agg(c, SKETCH_BITS).alias(n) for n, c in COUNTED.items()])


def roll_up(sketches: DataFrame, *by: Column) -> DataFrame:
    """Finding counts and estimated distinct counts of ``daily_sketches`` rows, by anything of their days."""
    return sketches.groupBy(*by).agg(
        F.sum("finding_count").alias("finding_count"), *[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in COUNTED])


def risk_distribution(findings: DataFrame) -> DataFrame:
    """A3: findings with score >= 80, 50-79 and < 50."""
    return findings.agg(*risk_counts(findings))


def overall_risk(findings: DataFrame) -> DataFrame:
    """A4: HIGH / MEDIUM / LOW from the risk distribution."""
    d = risk_distribution(findings)
    return d.select(overall_risk_col(F.col("risk_high"), F.col("risk_medium")).alias("risk_assessment"))


def affected_infrastructure(findings: DataFrame, exact: bool = True) -> DataFrame:
    """A5: distinct hosts, distinct users, and the finding count (``exact`` as in ``distinct_techniques``)."""
    return findings.agg(
        _distinct("hostname", exact).alias("hosts"),
        _distinct("username", exact).alias("users"),
        F.count(F.lit(1)).alias("total_events"),
    )


def _technique_counts(findings: DataFrame) -> DataFrame:
    return (
        findings.where(F.col("mitre_technique_name").isNotNull())
        .groupBy(F.col("mitre_technique_name").alias("technique_name"))
        .agg(F.count(F.lit(1)).alias("finding_count"))
    )


def top_techniques(findings: DataFrame, k: int = TOP_TECHNIQUES) -> DataFrame:
    """The k technique names with most findings (ties by name)."""
    return _technique_counts(findings).orderBy(F.desc("finding_count"), "technique_name").limit(k)


def technique_share(findings: DataFrame, k: int = TOP_SHARE) -> DataFrame:
    """A10: top-k techniques with their percent share of the top k."""
    top = top_techniques(findings, k)
    return top.withColumn(
        "share_pct",
        F.round(F.col("finding_count") * 100.0 / F.sum("finding_count").over(Window.partitionBy()), 6),
    )


def base_technique(tid: Column) -> Column:
    """Text before the first '.', with a missing id read as the text 'None'."""
    return F.split_part(F.coalesce(tid, F.lit("None")), F.lit("."), F.lit(1))


def tactic_of(tid: Column, tactic_map: dict[str, str] | None = None) -> Column:
    """Base technique -> tactic by a literal map (bounded, fixed size)."""
    mapping = TACTICS if tactic_map is None else tactic_map
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(m, base_technique(tid)), F.lit(UNKNOWN_TACTIC))


def with_tactic(findings: DataFrame, tactic_map: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``findings`` with ``_tactic``. The map may be a table (technique_id,
    tactic): then it is joined, broadcast only after its size is checked; of
    several tactics of a technique the first in order counts."""
    if not isinstance(tactic_map, DataFrame):
        return findings.withColumn("_tactic", tactic_of(F.col("mitre_technique_id"), tactic_map))
    table = tactic_map.groupBy(F.col("technique_id").alias("_base")).agg(F.min("tactic").alias("_mapped"))
    joined = findings.join(sized_broadcast(table), base_technique(F.col("mitre_technique_id")) == F.col("_base"), "left")
    return joined.withColumn("_tactic", F.coalesce("_mapped", F.lit(UNKNOWN_TACTIC))).drop("_base", "_mapped")


def attack_stages(findings: DataFrame, tactic_map: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Findings per ATT&CK tactic (unknown ids -> 'Unknown')."""
    return with_tactic(findings, tactic_map).groupBy(F.col("_tactic").alias("tactic")).agg(F.count(F.lit(1)).alias("finding_count"))


def timeline(findings: DataFrame) -> DataFrame:
    """Earliest and latest detection and the time between them."""
    s = findings.agg(
        F.min("timestamp").alias("earliest_detection"), F.max("timestamp").alias("latest_detection")
    )
    micros = F.unix_micros(F.col("latest_detection")) - F.unix_micros(F.col("earliest_detection"))
    return s.select(
        "earliest_detection",
        "latest_detection",
        (micros / F.lit(1_000_000.0)).alias("duration_seconds"),
        duration_text(micros).alias("duration"),
    )


def level_counts(findings: DataFrame) -> DataFrame:
    """Findings per rule level."""
    return findings.groupBy("rule_level").agg(F.count(F.lit(1)).alias("finding_count"))


def hourly_activity(findings: DataFrame) -> DataFrame:
    """Findings per hour of day, in hour order."""
    return (
        findings.where(F.col("timestamp").isNotNull())
        .groupBy(F.hour("timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("finding_count"))
        .orderBy("hour")
    )


def host_risk(findings: DataFrame) -> DataFrame:
    """Per host the finding count and mean risk, by count ascending."""
    return (
        findings.where(F.col("hostname").isNotNull())
        .groupBy("hostname")
        .agg(
            F.count(F.lit(1)).alias("finding_count"),
            F.round(F.avg(_risk()), 6).alias("avg_risk"),
        )
        .orderBy("finding_count", "hostname")
    )


def rankings(findings: DataFrame, tactic_map: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """A6, A7, A9, A11 and A12 in one pass: (ranking, name, finding_count,
    avg_risk) by technique, tactic, level, hour and host.

    Grouping sets expand each finding into five narrow rows, which are
    aggregated on the spot, so the findings are read once and one shuffle
    carries the partial counts of all five."""
    keys = {"technique": F.col("mitre_technique_name"), "tactic": F.col("_tactic"), "level": F.col("rule_level"),
            "hour": F.hour("timestamp").cast("string"), "host": F.col("hostname")}
    narrow = with_tactic(findings, tactic_map).select(*[k.alias(f"_{n}") for n, k in keys.items()], _risk().alias("_risk"))
    cols = [f"_{n}" for n in keys]
    sets = narrow.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("finding_count"), F.round(F.avg("_risk"), 6).alias("avg_risk"))
    # the id has a 0 where the set has the column
    every = (1 << len(cols)) - 1
    which, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(keys):
        here = F.col("_id") == (every & ~(1 << (len(cols) - 1 - i)))
        which, name = F.when(here, n).otherwise(which), F.when(here, F.col(f"_{n}")).otherwise(name)
    out = sets.select(which.alias("ranking"), name.alias("name"), "finding_count", "avg_risk")
    return out.where(F.col("name").isNotNull() | (F.col("ranking") == "level"))


def extracted_iocs(findings: DataFrame) -> DataFrame:
    """Distinct (kind, value) for IPs, processes, users, hosts, techniques."""
    pairs = F.array(
        F.struct(F.lit("ip_addresses").alias("kind"), F.col("source_ip").alias("value")),
        F.struct(F.lit("ip_addresses").alias("kind"), F.col("destination_ip").alias("value")),
        F.struct(F.lit("processes").alias("kind"), F.col("process_name").alias("value")),
        F.struct(F.lit("users").alias("kind"), F.col("username").alias("value")),
        F.struct(F.lit("hosts").alias("kind"), F.col("hostname").alias("value")),
        F.struct(F.lit("techniques").alias("kind"), F.col("mitre_technique_id").alias("value")),
    )
    long = findings.select(F.explode(pairs).alias("p")).select("p.kind", "p.value")
    return long.where(
        F.col("value").isNotNull() & ~F.lower(F.col("value")).isin(EMPTY_IOC_VALUES)
    ).distinct()


def recommendations(findings: DataFrame) -> DataFrame:
    """Recommendation texts in their fixed order (long form)."""
    name = F.lower(F.coalesce(F.col("mitre_technique_name"), F.lit("None")))
    flags = findings.agg(
        F.bool_or(name.contains("powershell")).alias("powershell"),
        F.bool_or(name.contains("credential")).alias("credential"),
        F.bool_or(name.contains("discovery")).alias("discovery"),
        F.count_if(_risk() >= HIGH_RISK).alias("n_high"),
    )
    items = []
    for key, text in RECOMMENDATIONS:
        items.append(F.when(F.coalesce(F.col(key), F.lit(False)), F.lit(text)))
    high_text = F.replace(F.lit(HIGH_RISK_RECOMMENDATION), F.lit("{n}"), F.col("n_high").cast("string"))
    items.append(F.when(F.col("n_high") > 0, high_text))
    items.append(F.when(F.col("n_high") > 0, F.lit(ISOLATE_RECOMMENDATION)))
    chosen = F.filter(F.array(*items), lambda x: x.isNotNull())
    final = F.when(F.size(chosen) > 0, chosen).otherwise(
        F.array(*[F.lit(t) for t in DEFAULT_RECOMMENDATIONS])
    )
    return flags.select(F.posexplode(final).alias("pos", "recommendation")).select(
        (F.col("pos") + 1).alias("rec_order"), "recommendation"
    )


def scenario_summary(findings: DataFrame, scenario_col: str = "action", k: int = TOP_PER_SCENARIO) -> DataFrame:
    """Per scenario the totals and its top-k techniques (one row each)."""
    totals = findings.groupBy(F.col(scenario_col).alias("scenario")).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(_risk() >= HIGH_RISK).alias("high_risk"),
        F.count_distinct("hostname").alias("hosts"),
    )
    per_tech = (
        findings.where(F.col("mitre_technique_name").isNotNull())
        .groupBy(F.col(scenario_col).alias("scenario"), F.col("mitre_technique_name").alias("technique_name"))
        .agg(F.count(F.lit(1)).alias("technique_findings"))
    )
    w = Window.partitionBy("scenario").orderBy(F.desc("technique_findings"), "technique_name")
    ranked = per_tech.withColumn("technique_rank", F.row_number().over(w)).where(F.col("technique_rank") <= k)
    return totals.join(ranked, "scenario", "left").select(
        "scenario", "total_findings", "high_risk", "hosts", "technique_rank", "technique_name", "technique_findings"
    )


def high_risk(findings: DataFrame) -> DataFrame:
    """findings with score >= 80."""
    return findings.where(F.col("risk_score") >= HIGH_RISK)
