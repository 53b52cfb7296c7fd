"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
matching DuckDB oracle SQL in ``ORACLE_SQL[name]`` (omitted where no SQL twin
exists; those keys get a rows-only check plus unit tests).

Every query reads the driver tables (or data Spark derives from them) in
full; none runs on fixed input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.functions import matching
from ravenhunt.operators import report
from ravenhunt.operators.conditions import condition_column
from ravenhunt.operators.hunt import (
    enrich_technique,
    hunt,
    prepare_logs,
    selection_column,
)
from ravenhunt.plans.oracle_hunt import HUNT_WITH
from ravenhunt.plans.ruleset import rule_table, technique_table
from ravenhunt.plans.views import LOG_VIEW_SQL, log_view
from ravenhunt.session import ensure_on_workers, read_table, scratch_path, scratch_table
from ravenhunt.sinks import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_on_workers(spark)
            return fn(spark, sf_dir)

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


def findings(spark: SparkSession, sf_dir: str, strategy: str = "auto", dedupe: bool = True) -> DataFrame:
    return hunt(
        log_view(spark, sf_dir), rule_table(spark), technique_table(spark), strategy=strategy, dedupe=dedupe
    )


# ---------------------------------------------------------------- hunt group
@register("hunt", HUNT_WITH + "SELECT * FROM hunt")
def q_hunt(spark, sf_dir):
    """F8: all catalog rules over the whole log view, enriched and de-duplicated."""
    return findings(spark, sf_dir)


@register("pattern_theta_join", HUNT_WITH + "SELECT * FROM hunt")
def q_pattern_theta_join(spark, sf_dir):
    """The same hunt with every rule compiled to a Column (the other physical form)."""
    return findings(spark, sf_dir, strategy="compiled")


# One rule per part, in four shapes (rule text in Spark, predicates in SQL).
_MANY_SQL = f"""WITH lc AS (SELECT *, lower(message) AS m, lower(source_ip) AS s, lower(destination_ip) AS d FROM ({LOG_VIEW_SQL})),
many AS (SELECT lc.*, p.p_partkey AS k, p.p_name AS title, p.p_size AS size FROM lc, part p WHERE
  (p.p_partkey % 4 = 0 AND lc.username = 'user' || CAST(p.p_partkey AS VARCHAR) AND NOT coalesce(lc.action = 'click', false))
  OR (p.p_partkey % 4 = 1 AND coalesce(starts_with(lc.s, '10.0.' || CAST(p.p_partkey % 256 AS VARCHAR) || '.'), false)
      AND lower(lc.hostname) = 'host-' || CAST(p.p_partkey % 20 AS VARCHAR))
  OR (p.p_partkey % 4 = 2 AND contains(lc.m, '"k": ' || CAST(p.p_partkey % 100 AS VARCHAR) || '}}') AND contains(lc.process_name, 'cmd'))
  OR (p.p_partkey % 4 = 3 AND coalesce(ends_with(lc.d, '.' || CAST(p.p_partkey % 200 AS VARCHAR)), false)
      AND regexp_matches(lc.process_name, 'p.*sh')))
SELECT DISTINCT timestamp, hostname, username, process_name, event_id, message, source_ip, destination_ip, action,
       'part-' || CAST(k AS VARCHAR) AS hunting_rule_id, title AS hunting_rule_title,
       CASE WHEN size % 2 = 0 THEN 'low' ELSE 'high' END AS rule_level, 'T1049' AS mitre_technique_id,
       CASE WHEN size % 2 = 0 THEN 40 ELSE 90 END AS risk_score FROM many"""


@register("hunt_many_rules", _MANY_SQL)
def q_hunt_many_rules(spark, sf_dir):
    """A rule for every row of ``part`` (thousands) over the whole log view."""
    k = F.col("p_partkey")
    text = k.cast("string")

    def item(field, op, value):
        return F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.array(value).alias("values"))

    def selections(a, b):
        return F.array(F.struct(F.lit("a").alias("name"), F.array(a).alias("items")), F.struct(F.lit("b").alias("name"), F.array(b).alias("items")))

    shapes = [
        selections(item("username", "equals", F.concat(F.lit("user"), text)), item("action", "equals", F.lit("click"))),
        selections(item("source_ip", "startswith", F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit("."))),
                   item("hostname", "equals", F.concat(F.lit("HOST-"), (k % 20).cast("string")))),
        selections(item("CommandLine", "contains", F.concat(F.lit('"k": '), (k % 100).cast("string"), F.lit("}"))), item("Image", "contains", F.lit("cmd"))),
        selections(item("destination_ip", "endswith", F.concat(F.lit("."), (k % 200).cast("string"))), item("Image", "contains", F.lit("p*sh"))),
    ]
    chosen = shapes[3]
    for i in (2, 1, 0):
        chosen = F.when(k % 4 == i, shapes[i]).otherwise(chosen)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rules = part.repartition(spark.sparkContext.defaultParallelism).select(  # a file of many rows is one task otherwise
        F.concat(F.lit("part-"), text).alias("id"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.lit("low")).otherwise(F.lit("high")).alias("level"),
        F.array(F.lit("attack.t1049")).alias("tags"), chosen.alias("selections"),
        F.when(k % 4 == 0, F.lit("a and not b")).otherwise(F.lit("a and b")).alias("condition"),
        F.lit(None).cast("string").alias("error"),
    )
    found = hunt(log_view(spark, sf_dir), rules, technique_table(spark), event_id="long")
    return found.drop("mitre_technique_name", "mitre_technique_url")


@register(
    "enrich_technique",
    HUNT_WITH
    + """SELECT hunting_rule_id, mitre_technique_id, mitre_technique_name, mitre_technique_url,
       count(*) AS finding_count FROM enriched GROUP BY ALL""",
)
def q_enrich_technique(spark, sf_dir):
    """Raw matches left-joined with the technique table, counted per technique."""
    raw = findings(spark, sf_dir, dedupe=False)
    return raw.groupBy("hunting_rule_id", "mitre_technique_id", "mitre_technique_name", "mitre_technique_url").agg(
        F.count(F.lit(1)).alias("finding_count")
    )


@register(
    "risk_score",
    HUNT_WITH
    + "SELECT hunting_rule_id, rule_level, risk_score, count(*) AS finding_count FROM hunt GROUP BY ALL",
)
def q_risk_score(spark, sf_dir):
    """Risk score per rule level (0 when the technique is unknown)."""
    return findings(spark, sf_dir).groupBy("hunting_rule_id", "rule_level", "risk_score").agg(
        F.count(F.lit(1)).alias("finding_count")
    )


@register(
    "technique_from_tags",
    HUNT_WITH
    + "SELECT hunting_rule_id, mitre_technique_id, count(*) AS finding_count FROM enriched GROUP BY ALL",
)
def q_technique_from_tags(spark, sf_dir):
    """Technique id taken from each rule's tags, per rule over all matches."""
    raw = findings(spark, sf_dir, dedupe=False)
    return raw.groupBy("hunting_rule_id", "mitre_technique_id").agg(F.count(F.lit(1)).alias("finding_count"))


@register("dedupe_findings", HUNT_WITH + "SELECT * FROM hunt")
def q_dedupe_findings(spark, sf_dir):
    """Hunting the log view twice over gives each finding once."""
    lv = log_view(spark, sf_dir)
    return hunt(lv.unionByName(lv), rule_table(spark), technique_table(spark))


@register("high_risk", HUNT_WITH + "SELECT * FROM hunt WHERE risk_score >= 80")
def q_high_risk(spark, sf_dir):
    """findings with risk score >= 80."""
    return report.high_risk(findings(spark, sf_dir))


# ---------------------------------------------------------- predicate group
_LV = f"WITH lv AS ({LOG_VIEW_SQL}) "


@register(
    "match_contains",
    _LV + "SELECT event_id, message FROM lv WHERE contains(lower(message), 'shadowcopy') "
    "OR contains(lower(message), 'lsass')",
)
def q_match_contains(spark, sf_dir):
    """substring match of any listed value, ignoring case."""
    lv = log_view(spark, sf_dir)
    return lv.where(matching.match_contains(F.col("message"), ["ShadowCopy", "LSASS"])).select("event_id", "message")


@register(
    "match_wildcard",
    _LV + "SELECT event_id, message FROM lv WHERE regexp_matches(lower(message), 'power.*-enc.*\"k\": 1')",
)
def q_match_wildcard(spark, sf_dir):
    """contains with inner '*' (regex search; '*' does not cross lines)."""
    lv = log_view(spark, sf_dir)
    return lv.where(matching.match_contains(F.col("message"), ['power*-enc*"k": 1'])).select("event_id", "message")


@register(
    "match_startswith",
    _LV + "SELECT event_id, process_name FROM lv WHERE starts_with(lower(process_name), 'cmd') "
    "OR starts_with(lower(process_name), 'pow')",
)
def q_match_startswith(spark, sf_dir):
    """prefix match, ignoring case."""
    lv = log_view(spark, sf_dir)
    return lv.where(matching.match_startswith(F.col("process_name"), ["CMD", "pow"])).select("event_id", "process_name")


@register(
    "match_endswith",
    _LV + "SELECT event_id, hostname FROM lv WHERE ends_with(lower(hostname), '-1') "
    "OR ends_with(lower(hostname), '-12')",
)
def q_match_endswith(spark, sf_dir):
    """suffix match, ignoring case."""
    lv = log_view(spark, sf_dir)
    return lv.where(matching.match_endswith(F.col("hostname"), ["-1", "-12"])).select("event_id", "hostname")


@register(
    "match_equals",
    _LV + "SELECT event_id, action FROM lv WHERE lower(action) IN ('error', 'view')",
)
def q_match_equals(spark, sf_dir):
    """equality with any listed value, ignoring case."""
    lv = log_view(spark, sf_dir)
    return lv.where(matching.match_equals(F.col("action"), ["error", "VIEW"])).select("event_id", "action")


@register(
    "selection_and",
    _LV + "SELECT event_id FROM lv WHERE coalesce(contains(lower(process_name), 'exe'), false) "
    "AND coalesce(lower(action) = 'click', false) AND coalesce(ends_with(lower(hostname), '3'), false)",
)
def q_selection_and(spark, sf_dir):
    """AND over items of one selection (unknown/null -> false)."""
    items = [
        {"field": "Image", "op": "contains", "values": ["EXE"]},
        {"field": "action", "op": "equals", "values": ["click"]},
        {"field": "hostname", "op": "endswith", "values": ["3"]},
    ]
    prepared = prepare_logs(log_view(spark, sf_dir))
    return prepared.where(selection_column(items, {"image": "process_name"})).select("event_id")


@register(
    "condition_boolean",
    _LV
    + """SELECT event_id,
       ((coalesce(contains(lower(process_name), 'shell'), false) OR coalesce(lower(action) = 'error', false))
        AND NOT coalesce(contains(lower(message), 'started'), false)) AS matched
FROM lv""",
)
def q_condition_boolean(spark, sf_dir):
    """'(a or b) and not c' folded into one Column, per row of the log view."""
    items = {
        "a": [{"field": "image", "op": "contains", "values": ["shell"]}],
        "b": [{"field": "action", "op": "equals", "values": ["error"]}],
        "c": [{"field": "commandline", "op": "contains", "values": ["started"]}],
    }
    fmap = {"image": "process_name", "commandline": "message"}
    sels = {k: selection_column(v, fmap) for k, v in items.items()}
    prepared = prepare_logs(log_view(spark, sf_dir))
    return prepared.select("event_id", condition_column("(A or b) and not c", sels).alias("matched"))


# ------------------------------------------------------------ report group
def _h(spark, sf_dir):
    return findings(spark, sf_dir)


_DURATION_SQL = """
  CASE WHEN {us} IS NULL THEN NULL ELSE
    printf('%d days %02d:%02d:%02d', {us} // 86400000000, ({us} // 1000000 % 86400) // 3600,
           ({us} // 1000000 % 3600) // 60, {us} // 1000000 % 60)
    || CASE WHEN {us} % 1000000 > 0 THEN printf('.%06d', {us} % 1000000) ELSE '' END END"""


def _duration(us: str) -> str:
    return _DURATION_SQL.format(us=us)


_SPAN = "(epoch_us(max(timestamp)) - epoch_us(min(timestamp)))"


@register(
    "executive_summary",
    HUNT_WITH
    + f"""SELECT CASE WHEN count(*) = 0 THEN 'No threats detected' END AS status,
       count(*) AS total_findings,
       count(DISTINCT mitre_technique_id) AS unique_techniques,
       CASE WHEN count_if(risk_score >= 80) > 0 THEN 'HIGH'
            WHEN count_if(risk_score >= 50 AND risk_score < 80) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_assessment,
       CAST(count_if(risk_score >= 80) AS BIGINT) AS risk_high,
       CAST(count_if(risk_score >= 50 AND risk_score < 80) AS BIGINT) AS risk_medium,
       CAST(count_if(risk_score < 50) AS BIGINT) AS risk_low,
       count(DISTINCT hostname) AS hosts, count(DISTINCT username) AS users, count(*) AS total_events,
       min(timestamp) AS earliest_detection, max(timestamp) AS latest_detection,
       {_SPAN} / 1000000.0 AS duration_seconds,
       {_duration(_SPAN)} AS duration,
       CASE WHEN count(*) = 0 THEN 'Continue routine monitoring' END AS recommendation
FROM hunt""",
)
def q_executive_summary(spark, sf_dir):
    """A0: the executive summary row."""
    return report.executive_summary(_h(spark, sf_dir))


@register(
    "distinct_techniques",
    HUNT_WITH + "SELECT count(DISTINCT mitre_technique_id) AS unique_techniques FROM hunt",
)
def q_distinct_techniques(spark, sf_dir):
    """A2: distinct technique ids among the findings."""
    return report.distinct_techniques(_h(spark, sf_dir))


@register(
    "risk_distribution",
    HUNT_WITH
    + """SELECT CAST(count_if(risk_score >= 80) AS BIGINT) AS risk_high,
       CAST(count_if(risk_score >= 50 AND risk_score < 80) AS BIGINT) AS risk_medium,
       CAST(count_if(risk_score < 50) AS BIGINT) AS risk_low FROM hunt""",
)
def q_risk_distribution(spark, sf_dir):
    """A3: risk bands."""
    return report.risk_distribution(_h(spark, sf_dir))


@register(
    "overall_risk",
    HUNT_WITH
    + """SELECT CASE WHEN count_if(risk_score >= 80) > 0 THEN 'HIGH'
            WHEN count_if(risk_score >= 50 AND risk_score < 80) > 3 THEN 'MEDIUM' ELSE 'LOW' END
       AS risk_assessment FROM hunt""",
)
def q_overall_risk(spark, sf_dir):
    """A4: overall risk."""
    return report.overall_risk(_h(spark, sf_dir))


@register(
    "affected_infrastructure",
    HUNT_WITH
    + """SELECT count(DISTINCT hostname) AS hosts, count(DISTINCT username) AS users,
       count(*) AS total_events FROM hunt""",
)
def q_affected_infrastructure(spark, sf_dir):
    """A5: hosts, users, events."""
    return report.affected_infrastructure(_h(spark, sf_dir))


@register(
    "top_techniques",
    HUNT_WITH
    + """SELECT mitre_technique_name AS technique_name, count(*) AS finding_count FROM hunt
WHERE mitre_technique_name IS NOT NULL GROUP BY 1 ORDER BY finding_count DESC, technique_name LIMIT 5""",
)
def q_top_techniques(spark, sf_dir):
    """Top-5 technique names (a top-k report: the limit is the feature)."""
    return report.top_techniques(_h(spark, sf_dir))


@register(
    "attack_stages",
    HUNT_WITH
    + """SELECT coalesce(m.tactic, 'Unknown') AS tactic, count(*) AS finding_count
FROM hunt LEFT JOIN (VALUES ('T1059', 'Execution'), ('T1003', 'Credential Access'), ('T1049', 'Discovery'),
  ('T1047', 'Execution'), ('T1083', 'Discovery'), ('T1082', 'Discovery')) m(base, tactic)
  ON split_part(coalesce(mitre_technique_id, 'None'), '.', 1) = m.base
GROUP BY 1""",
)
def q_attack_stages(spark, sf_dir):
    """Findings per tactic."""
    return report.attack_stages(_h(spark, sf_dir))


@register(
    "timeline",
    HUNT_WITH
    + f"""SELECT min(timestamp) AS earliest_detection, max(timestamp) AS latest_detection,
       {_SPAN} / 1000000.0 AS duration_seconds, {_duration(_SPAN)} AS duration FROM hunt""",
)
def q_timeline(spark, sf_dir):
    """Detection time span."""
    return report.timeline(_h(spark, sf_dir))


@register(
    "level_counts",
    HUNT_WITH + "SELECT rule_level, count(*) AS finding_count FROM hunt GROUP BY 1",
)
def q_level_counts(spark, sf_dir):
    """Findings per level."""
    return report.level_counts(_h(spark, sf_dir))


@register(
    "technique_share",
    HUNT_WITH
    + """, top AS (SELECT mitre_technique_name AS technique_name, count(*) AS finding_count FROM hunt
WHERE mitre_technique_name IS NOT NULL GROUP BY 1 ORDER BY finding_count DESC, technique_name LIMIT 8)
SELECT technique_name, finding_count,
       round(finding_count * 100.0 / sum(finding_count) OVER (), 6) AS share_pct FROM top""",
)
def q_technique_share(spark, sf_dir):
    """A10: top-8 techniques with share of the top 8."""
    return report.technique_share(_h(spark, sf_dir))


@register(
    "hourly_activity",
    HUNT_WITH
    + """SELECT hour(timestamp) AS hour, count(*) AS finding_count FROM hunt
WHERE timestamp IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def q_hourly_activity(spark, sf_dir):
    """Findings per hour of day."""
    return report.hourly_activity(_h(spark, sf_dir))


@register(
    "host_risk",
    HUNT_WITH
    + """SELECT hostname, count(*) AS finding_count, round(avg(CAST(risk_score AS DOUBLE)), 6) AS avg_risk
FROM hunt WHERE hostname IS NOT NULL GROUP BY 1 ORDER BY 2, 1""",
)
def q_host_risk(spark, sf_dir):
    """Per-host count and mean risk."""
    return report.host_risk(_h(spark, sf_dir))


_RANK_COLS = "count(*) AS finding_count, round(avg(CAST(risk_score AS DOUBLE)), 6) AS avg_risk FROM hunt"


@register(
    "finding_rankings",
    HUNT_WITH
    + f"""SELECT 'technique' AS ranking, mitre_technique_name AS name, {_RANK_COLS} WHERE mitre_technique_name IS NOT NULL GROUP BY 2
UNION ALL SELECT 'tactic', coalesce(m.tactic, 'Unknown'), {_RANK_COLS} LEFT JOIN (VALUES ('T1059', 'Execution'), ('T1003', 'Credential Access'),
  ('T1049', 'Discovery'), ('T1047', 'Execution'), ('T1083', 'Discovery'), ('T1082', 'Discovery')) m(base, tactic)
  ON split_part(coalesce(mitre_technique_id, 'None'), '.', 1) = m.base GROUP BY 2
UNION ALL SELECT 'level', rule_level, {_RANK_COLS} GROUP BY 2
UNION ALL SELECT 'hour', CAST(hour(timestamp) AS VARCHAR), {_RANK_COLS} WHERE timestamp IS NOT NULL GROUP BY 2
UNION ALL SELECT 'host', hostname, {_RANK_COLS} WHERE hostname IS NOT NULL GROUP BY 2""",
)
def q_finding_rankings(spark, sf_dir):
    """A6, A7, A9, A11, A12 from one pass over the findings."""
    return report.rankings(_h(spark, sf_dir))


@register(
    "sketched_counts",
    HUNT_WITH
    + """, m AS (SELECT unnest(['techniques', 'hosts', 'users']) AS counted),
e AS (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS finding_count, count(DISTINCT mitre_technique_id) AS t, count(DISTINCT hostname) AS h,
      count(DISTINCT username) AS u FROM hunt WHERE timestamp IS NOT NULL GROUP BY 1)
SELECT month, counted, finding_count, CASE counted WHEN 'techniques' THEN t WHEN 'hosts' THEN h ELSE u END AS exact, TRUE AS within_5_pct FROM e, m""",
)
def q_sketched_counts(spark, sf_dir):
    """A2 / A5: distinct techniques, hosts and users per month, rolled up from daily
    sketches without the findings, beside the exact counts."""
    f = _h(spark, sf_dir).where("timestamp is not null")
    daily = scratch_table(report.daily_sketches(f), "sketches")
    month = F.date_format("day", "yyyy-MM").alias("month")
    sketched = report.roll_up(daily, month)
    exact = f.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(*[F.count_distinct(c).alias(f"exact_{n}") for n, c in report.COUNTED.items()])
    both = sketched.join(exact, "month")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("counted"), F.col(n).alias("about"), F.col(f"exact_{n}").alias("exact")) for n in report.COUNTED])).alias("c")
    rows = both.select("month", "finding_count", each)
    return rows.select("month", "c.counted", "finding_count", "c.exact", (F.abs(F.col("c.about") - F.col("c.exact")) <= 0.05 * F.col("c.exact")).alias("within_5_pct"))


@register(
    "extracted_iocs",
    HUNT_WITH
    + """SELECT DISTINCT kind, value FROM (
  SELECT 'ip_addresses' AS kind, source_ip AS value FROM hunt
  UNION ALL SELECT 'ip_addresses', destination_ip FROM hunt
  UNION ALL SELECT 'processes', process_name FROM hunt
  UNION ALL SELECT 'users', username FROM hunt
  UNION ALL SELECT 'hosts', hostname FROM hunt
  UNION ALL SELECT 'techniques', mitre_technique_id FROM hunt)
WHERE value IS NOT NULL AND lower(value) NOT IN ('nan', 'none', '')""",
)
def q_extracted_iocs(spark, sf_dir):
    """Distinct indicators by kind."""
    return report.extracted_iocs(_h(spark, sf_dir))


@register(
    "recommendations",
    HUNT_WITH
    + """, f AS (SELECT bool_or(contains(lower(coalesce(mitre_technique_name, 'None')), 'powershell')) AS ps,
                   bool_or(contains(lower(coalesce(mitre_technique_name, 'None')), 'credential')) AS cr,
                   bool_or(contains(lower(coalesce(mitre_technique_name, 'None')), 'discovery')) AS di,
                   CAST(count_if(risk_score >= 80) AS BIGINT) AS n_high FROM hunt),
r AS (
  SELECT 1 AS o, 'Implement PowerShell logging and monitoring (Event ID 4104)' AS t FROM f WHERE ps
  UNION ALL SELECT 2, 'Consider PowerShell Constrained Language Mode for non-admin users' FROM f WHERE ps
  UNION ALL SELECT 3, 'Review privileged account security and implement credential guard' FROM f WHERE cr
  UNION ALL SELECT 4, 'Audit recent password changes and suspicious logon activity' FROM f WHERE cr
  UNION ALL SELECT 5, 'Monitor network scanning and reconnaissance activities' FROM f WHERE di
  UNION ALL SELECT 6, 'Implement network segmentation to limit lateral movement' FROM f WHERE di
  UNION ALL SELECT 7, 'Immediate investigation required for ' || n_high || ' high-risk findings' FROM f WHERE n_high > 0
  UNION ALL SELECT 8, 'Consider isolating affected systems pending investigation' FROM f WHERE n_high > 0),
d AS (SELECT * FROM (VALUES (1, 'Continue routine threat hunting activities'),
  (2, 'Review and update detection rules based on current findings'),
  (3, 'Validate findings through additional log analysis')) v(o, t) WHERE NOT EXISTS (SELECT 1 FROM r))
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rec_order, t AS recommendation
FROM (SELECT * FROM r UNION ALL SELECT * FROM d)""",
)
def q_recommendations(spark, sf_dir):
    """Recommendations in fixed order."""
    return report.recommendations(_h(spark, sf_dir))


@register(
    "scenario_summary",
    HUNT_WITH
    + """, totals AS (SELECT action AS scenario, count(*) AS total_findings, CAST(count_if(risk_score >= 80) AS BIGINT) AS high_risk,
                        count(DISTINCT hostname) AS hosts FROM hunt GROUP BY 1),
pt AS (SELECT action AS scenario, mitre_technique_name AS technique_name, count(*) AS technique_findings
       FROM hunt WHERE mitre_technique_name IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY scenario ORDER BY technique_findings DESC, technique_name)
                      AS INTEGER) AS technique_rank FROM pt)
SELECT t.scenario, t.total_findings, t.high_risk, t.hosts, r.technique_rank, r.technique_name, r.technique_findings
FROM totals t LEFT JOIN rk r ON t.scenario = r.scenario AND r.technique_rank <= 3""",
)
def q_scenario_summary(spark, sf_dir):
    """Per scenario (the event action) totals and top-3 techniques."""
    return report.scenario_summary(_h(spark, sf_dir))


# -------------------------------------------------------------- text group
from ravenhunt.functions import text as tx  # noqa: E402
from ravenhunt.plans import text_views as tv  # noqa: E402

_TV = f"WITH tv AS ({tv.TEXT_VIEW_SQL}) "


@register("sanitize_text", _TV + f"SELECT src, id, {tv.sql_sanitize('text')} AS clean_text FROM tv")
def q_sanitize_text(spark, sf_dir):
    """Sanitise every whole text (patterns, control chars, escapes)."""
    v = tv.text_view(spark, sf_dir)
    return tx.sanitize_frame(v, "text", "clean_text").select("src", "id", "clean_text")


@register(
    "clean_log_entry",
    _TV + "SELECT src, id, regexp_replace(text, '[<>\"'']', '', 'g') AS clean_text FROM tv",
)
def q_clean_log_entry(spark, sf_dir):
    """Delete < > " ' from every whole text."""
    v = tv.text_view(spark, sf_dir)
    return v.select("src", "id", tx.clean_log_entry(F.col("text")).alias("clean_text"))


@register(
    "redact_secrets",
    _TV
    + f"SELECT src, id, redacted, redacted <> text AS changed FROM (SELECT src, id, text, {tv.sql_redact('text')} AS redacted FROM tv)",
)
def q_redact_secrets(spark, sf_dir):
    """Every whole text with its secrets redacted, and whether it changed."""
    v = tx.redact_frame(tv.text_view(spark, sf_dir), "text", "redacted")
    return v.select("src", "id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


@register("truncate_text", _TV + "SELECT src, id, left(text, 1000) AS head, length(text) > 1000 AS cut FROM tv")
def q_truncate_text(spark, sf_dir):
    """The cut to a given number of characters, where a caller asks for one."""
    v = tv.text_view(spark, sf_dir)
    return v.select("src", "id", tx.truncate("text", 1000).alias("head"), (F.length("text") > 1000).alias("cut"))


@register(
    "dangerous_content",
    _TV
    + "\nUNION ALL\n".join(
        f"SELECT src, id, '{name}' AS pattern_class FROM tv WHERE {cond}"
        for name, cond in tv.sql_dangerous_hits("text")
    ),
)
def q_dangerous_content(spark, sf_dir):
    """(text, pattern class) for every class a whole text hits."""
    v = tv.text_view(spark, sf_dir)
    return tx.dangerous_frame(v, "text").select("src", "id", "pattern_class")


# --------------------------------------------------------------- IOC group
from ravenhunt.functions import validate as va  # noqa: E402
from ravenhunt.operators import intel  # noqa: E402
from ravenhunt.operators.hunt import first_technique  # noqa: E402
from ravenhunt.plans import ioc_views as iv  # noqa: E402
from ravenhunt.session import read_table  # noqa: E402

# Literal candidates (ours, after the reference's test values) that the
# tables do not contain.
EDGE_VALUES = [
    "192.168.1.1", "example.com", "999.999.999.999", "", "001.002.003.255", "abc",
    "http://x.example.com/a", "1.2.3", "1.2.3.4.5", "256.1.1.1", "ab", "-bad.example", "a..b",
    "https://ok.example", "0.0.0.0", "d41d8cd98f00b204e9800998ecf8427e",
]
_EDGE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in EDGE_VALUES) + ") e(value)"
_IV = f"WITH iv AS ({iv.IOC_VIEW_SQL}) "


_IV_TAGS = f"WITH iv AS ({iv.ioc_sql(iv.FEED_OBJECTS_SQL, with_tags=True)}) "


def _with_tags_text(iocs: DataFrame) -> DataFrame:
    """Tags as JSON text, so that arrays compare as one value."""
    return iocs.withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("[]")))


def _edges(spark):
    return spark.createDataFrame([(v,) for v in EDGE_VALUES], "value string")


def _ip_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(iv.IPV4_TEXT), 0)).alias("value"))


def _hosts_and_urls(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(F.regexp_extract("url", iv.HOST_OF_URL, 1).alias("value")).unionByName(
        pages.select(F.col("url").alias("value"))
    )


_IP_TEXTS_SQL = f"SELECT unnest(regexp_extract_all(text, '{iv.IPV4_TEXT}')) AS value FROM documents"
_HOSTS_URLS_SQL = (
    f"SELECT regexp_extract(url, '{iv.HOST_OF_URL}', 1) AS value FROM pages UNION ALL SELECT url FROM pages"
)


@register(
    "ioc_extract",
    _IV_TAGS + "SELECT * FROM iv",
)
def q_ioc_extract(spark, sf_dir):
    """P10: IOC records from JSON feed objects (first present key, defaults, validity)."""
    return _with_tags_text(iv.ioc_view(spark, sf_dir))


@register(
    "ioc_sanitize",
    _IV_TAGS
    + "SELECT "
    + ", ".join(f"{tv.sql_sanitize(c)} AS {c}" for c in intel.IOC_STRING_FIELDS)
    + ", tags, feed, value AS lookup_value FROM iv WHERE coalesce(" + tv.sql_sanitize("value") + " <> '', false)",
)
def q_ioc_sanitize(spark, sf_dir):
    """Every IOC string field sanitised; raw value kept for lookups."""
    return intel.sanitize_iocs(_with_tags_text(iv.ioc_view(spark, sf_dir)))


@register(
    "ioc_valid_ip",
    f"SELECT DISTINCT value, {iv.valid_ioc_sql('value', chr(39) + 'ip' + chr(39))} AS valid "
    f"FROM ({_IP_TEXTS_SQL} UNION ALL {_EDGE_SQL})",
)
def q_ioc_valid_ip(spark, sf_dir):
    """IPv4 validity of every IPv4-like text in the documents (+ edge values)."""
    c = _ip_texts(spark, sf_dir).unionByName(_edges(spark)).distinct()
    return c.select("value", va.valid_ioc(F.col("value"), F.lit("ip")).alias("valid"))


@register(
    "ioc_valid_domain",
    f"SELECT DISTINCT value, {iv.valid_ioc_sql('value', chr(39) + 'domain' + chr(39))} AS valid "
    f"FROM ({_HOSTS_URLS_SQL} UNION ALL {_EDGE_SQL})",
)
def q_ioc_valid_domain(spark, sf_dir):
    """domain validity of every page host and URL (+ edge values)."""
    c = _hosts_and_urls(spark, sf_dir).unionByName(_edges(spark)).distinct()
    return c.select("value", va.valid_ioc(F.col("value"), F.lit("domain")).alias("valid"))


@register(
    "ioc_valid_url",
    f"SELECT DISTINCT value, {iv.valid_ioc_sql('value', chr(39) + 'url' + chr(39))} AS valid "
    f"FROM ({_HOSTS_URLS_SQL} UNION ALL {_EDGE_SQL})",
)
def q_ioc_valid_url(spark, sf_dir):
    """URL validity of every page host and URL (+ edge values)."""
    c = _hosts_and_urls(spark, sf_dir).unionByName(_edges(spark)).distinct()
    return c.select("value", va.valid_ioc(F.col("value"), F.lit("url")).alias("valid"))


_HASH_CANDIDATES_SQL = (
    f"SELECT h AS value FROM (SELECT unnest(regexp_extract_all(text, '{iv.HEX40_TEXT}')) AS h FROM documents) "
    f"UNION ALL SELECT left(h, 32) FROM (SELECT unnest(regexp_extract_all(text, '{iv.HEX40_TEXT}')) AS h FROM documents) "
    f"UNION ALL SELECT h || left(h, 24) FROM (SELECT unnest(regexp_extract_all(text, '{iv.HEX40_TEXT}')) AS h FROM documents) "
    f"UNION ALL {_EDGE_SQL}"
)


@register(
    "ioc_valid_hash",
    "SELECT DISTINCT value, kind, "
    + iv.valid_ioc_sql("value", "kind")
    + f" AS valid FROM ({_HASH_CANDIDATES_SQL}) CROSS JOIN (VALUES ('md5'), ('sha1'), ('sha256')) k(kind)",
)
def q_ioc_valid_hash(spark, sf_dir):
    """md5/sha1/sha256 validity of every hex text in the documents (cut/extended)."""
    docs = read_table(spark, sf_dir, "documents")
    h = docs.select(F.explode(F.regexp_extract_all("text", F.lit(iv.HEX40_TEXT), 0)).alias("h"))
    c = (
        h.select(F.col("h").alias("value"))
        .unionByName(h.select(F.left("h", F.lit(32)).alias("value")))
        .unionByName(h.select(F.concat("h", F.left("h", F.lit(24))).alias("value")))
        .unionByName(_edges(spark))
        .distinct()
    )
    kinds = F.array(*[F.lit(k) for k in ("md5", "sha1", "sha256")])
    c = c.select("value", F.explode(kinds).alias("kind"))
    return c.select("value", "kind", va.valid_ioc(F.col("value"), F.col("kind")).alias("valid"))


@register(
    "ioc_validate",
    f"""SELECT type, CAST(count_if({iv.valid_ioc_sql('value', 'type')}) AS BIGINT) AS valid, count(*) AS total
FROM (SELECT {iv._first_present_sql('obj', intel.VALUE_KEYS)} AS value,
             CASE WHEN {iv._any_present_sql('obj', intel.TYPE_KEYS)}
                  THEN {iv._first_present_sql('obj', intel.TYPE_KEYS)} ELSE {iv._FEED_TYPE_CASE} END AS type
      FROM ({iv.FEED_OBJECTS_SQL})) GROUP BY type""",
)
def q_ioc_validate(spark, sf_dir):
    """Valid out of total candidate IOCs per type, over all feed objects."""
    objs = iv.feed_objects(spark, sf_dir)
    m = F.from_json(F.col("obj"), "map<string,string>")
    _, value = intel.first_present(m, intel.VALUE_KEYS)
    tfound, tvalue = intel.first_present(m, intel.TYPE_KEYS)
    cands = objs.select(value.alias("value"), F.when(tfound, tvalue).otherwise(F.col("feed_type")).alias("type"))
    return intel.validation_counts(cands)


@register("iocs_by_type", _IV_TAGS + "SELECT * FROM iv WHERE type = 'ip'")
def q_iocs_by_type(spark, sf_dir):
    """F16: IOCs of type ip."""
    return intel.iocs_by_type(_with_tags_text(iv.ioc_view(spark, sf_dir)), "ip")


_SAFE_SQL = """(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) = 'https' AND NOT (
  contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), 'localhost')
  OR contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '127.0.0.1')
  OR contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '0.0.0.0')
  OR contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '10.')
  OR contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '192.168.')
  OR contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '172.16.')))"""


@register(
    "url_safety",
    f"SELECT DISTINCT u AS url, coalesce({_SAFE_SQL}, false) AS safe FROM ("
    f"SELECT url AS u FROM pages UNION ALL SELECT url FROM ({iv.FEEDS_SQL}) UNION ALL "
    "SELECT * FROM (VALUES ('https://host10.example/x'), ('https://LOCALHOST/'), ('HTTPS://ok.example'), "
    "('https://user@192.168.0.1:8443/f'), ('ftp://x.example'))) ",
)
def q_url_safety(spark, sf_dir):
    """https-only, no private/loopback authority; every page URL and feed URL."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("url"))
    extra = spark.createDataFrame(
        [("https://host10.example/x",), ("https://LOCALHOST/",), ("HTTPS://ok.example",),
         ("https://user@192.168.0.1:8443/f",), ("ftp://x.example",)],
        "url string",
    )
    feeds = iv.feed_table(spark).select("url")
    c = pages.unionByName(feeds).unionByName(extra).distinct()
    return c.select("url", va.url_is_safe(F.col("url")).alias("safe"))


@register("all_iocs", _IV_TAGS + f"SELECT iv.* FROM iv WHERE feed IN (SELECT name FROM ({iv.FEEDS_SQL}) WHERE enabled)")
def q_all_iocs(spark, sf_dir):
    """IOCs of all enabled feeds, no de-duplication."""
    return intel.all_iocs(_with_tags_text(iv.ioc_view(spark, sf_dir)), iv.feed_table(spark))


def _lookup_values(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.upper("url").alias("value"))
    return pages.unionByName(_ip_texts(spark, sf_dir)).unionByName(
        log_view(spark, sf_dir).select(F.col("source_ip").alias("value"))
    ).where(F.col("value").isNotNull())


_LOOKUP_VALUES_SQL = (
    f"SELECT upper(url) AS value FROM pages UNION ALL {_IP_TEXTS_SQL} UNION ALL "
    f"SELECT source_ip FROM ({LOG_VIEW_SQL}) WHERE source_ip IS NOT NULL"
)


@register(
    "ioc_lookup",
    _IV + f"""SELECT l.value AS indicator, iv.value, iv.type, iv.source, iv.feed
FROM (SELECT DISTINCT value FROM ({_LOOKUP_VALUES_SQL})) l JOIN iv ON lower(l.value) = lower(iv.value)""",
)
def q_ioc_lookup(spark, sf_dir):
    """Each distinct value to check against all IOCs, ignoring case."""
    pairs = intel.ioc_lookup(_lookup_values(spark, sf_dir).distinct(), iv.ioc_view(spark, sf_dir))
    return pairs.select("indicator", "value", "type", "source", "feed")


@register(
    "ioc_bulk_lookup",
    _IV + f"""SELECT l.value AS indicator, count(*) AS match_count, string_agg(DISTINCT iv.feed, ',' ORDER BY iv.feed) AS feeds
FROM (SELECT DISTINCT value FROM ({_LOOKUP_VALUES_SQL})) l JOIN iv ON lower(l.value) = lower(iv.value)
GROUP BY 1""",
)
def q_ioc_bulk_lookup(spark, sf_dir):
    """Indicators with matches, their match count and feeds."""
    return intel.ioc_bulk_lookup(_lookup_values(spark, sf_dir), iv.ioc_view(spark, sf_dir))


@register(
    "ioc_store_lookup",
    _IV + f"""SELECT l.value AS indicator, iv.type, iv.feed
FROM (SELECT DISTINCT value FROM ({_LOOKUP_VALUES_SQL})) l JOIN iv ON l.value = iv.value""",
)
def q_ioc_store_lookup(spark, sf_dir):
    """Case-sensitive lookup in the IOC store: written as a bucketed table in
    two appends, declared again over its folder, and joined without moving it."""
    iocs = iv.ioc_view(spark, sf_dir).select("value", "type", "feed")
    path = scratch_path(spark, "ioc-store")
    name = "ioc_store_" + path.rsplit("-", 1)[1]
    ip = F.coalesce(F.col("type") == "ip", F.lit(False))
    store.append_store(iocs.where(ip), name, path)
    store.append_store(iocs.where(~ip), name, path)
    opened = store.open_store(spark, f"{name}_again", path)
    pairs = store.lookup(_lookup_values(spark, sf_dir).distinct(), opened)
    return pairs.select("indicator", "type", "feed")


_EVENT_IPS_SQL = """SELECT '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS value,
       'event_ips' AS feed FROM events WHERE value > 45"""


def _event_ip_feed(spark, sf_dir):
    """A stand-in IP feed: addresses seen on high-value events."""
    ev = read_table(spark, sf_dir, "events").where(F.col("value") > 45)
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"),
                     (F.col("event_id") % 256).cast("string"))
    return ev.select(ip.alias("value"), F.lit("ip").alias("type"), F.lit("event_ips").alias("feed"))


@register(
    "log_ioc_match",
    _IV + f""", lv AS ({LOG_VIEW_SQL}),
ips AS (SELECT DISTINCT ioc_value, feed FROM (
  SELECT value AS ioc_value, feed FROM iv WHERE type = 'ip'
  UNION ALL SELECT value, feed FROM ({_EVENT_IPS_SQL})))
SELECT event_id, timestamp, hostname, 'source_ip' AS matched_field, ioc_value, feed FROM lv JOIN ips ON lv.source_ip = ips.ioc_value
UNION ALL
SELECT event_id, timestamp, hostname, 'destination_ip', ioc_value, feed FROM lv JOIN ips ON lv.destination_ip = ips.ioc_value""",
)
def q_log_ioc_match(spark, sf_dir):
    """Log rows whose source or destination IP is a known IOC (document
    IPs plus an IP feed taken from high-value events)."""
    iocs = iv.ioc_view(spark, sf_dir).select("value", "type", "feed").unionByName(_event_ip_feed(spark, sf_dir))
    return intel.log_ioc_match(log_view(spark, sf_dir), iocs)


@register(
    "technique_lookup",
    HUNT_WITH
    + """SELECT DISTINCT r.mitre_technique_id AS technique_id, t.name,
       'https://attack.mitre.org/techniques/' || t.technique_id AS url
FROM raw r JOIN tech t ON r.mitre_technique_id = t.technique_id""",
)
def q_technique_lookup(spark, sf_dir):
    """Technique ids the rules hit, looked up (unknown ids left out)."""
    raw = findings(spark, sf_dir, dedupe=False)
    return intel.technique_lookup(raw.select(F.col("mitre_technique_id").alias("technique_id")),
                                  technique_table(spark)).select("technique_id", "name", "url")


def part_techniques(spark, sf_dir):
    """Technique rows in bundle order built from ``part`` (ids repeat)."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("T"), (F.lit(1000) + F.col("p_partkey") % 150).cast("string")).alias("technique_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_partkey").alias("pos"),
    ).withColumn("url", F.concat(F.lit("https://attack.mitre.org/techniques/"), F.col("technique_id")))


@register(
    "first_technique",
    """SELECT technique_id, name, description, url FROM (
  SELECT 'T' || CAST(1000 + p_partkey % 150 AS VARCHAR) AS technique_id, p_name AS name, p_type AS description,
         'https://attack.mitre.org/techniques/T' || CAST(1000 + p_partkey % 150 AS VARCHAR) AS url,
         row_number() OVER (PARTITION BY 1000 + p_partkey % 150 ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def q_first_technique(spark, sf_dir):
    """First technique row per id in bundle order."""
    return first_technique(part_techniques(spark, sf_dir))


__all__ = ["QUERIES", "ORACLE_SQL", "register", "findings", "enrich_technique"]


# Register the I/O, feed, export, profile, burst and stream queries.
from ravenhunt.plans import catalog_io  # noqa: E402,F401
