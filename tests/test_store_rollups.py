"""The IOC store's lookups and compaction, sketches that merge, rankings in one pass."""

import pytest
from pyspark.sql import functions as F

from ravenhunt.operators import report
from ravenhunt.plans.catalog import findings
from ravenhunt.session import scratch_path
from ravenhunt.sinks import store

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _iocs(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("V"), (F.col("id") % 500).cast("string")).alias("value"), F.lit("ip").alias("type"), (F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("seen"))


def test_lookup_does_not_move_the_store(spark):
    path = scratch_path(spark, "store")
    store.append_store(_iocs(spark, 0, 1500), "t_store", path, buckets=8)
    whole = store.append_store(_iocs(spark, 1500, 3000), "t_store", path, buckets=8)
    assert whole.count() == 3000
    opened = store.open_store(spark, "t_store_again", path, buckets=8)  # as another session would
    asked = spark.range(0, 60).select(F.concat(F.lit("V"), (F.col("id") * 20).cast("string")).alias("value"), F.lit("x").alias("type"))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.lookup(asked, opened)
        plan = _plan(found)
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the values asked for
        assert found.count() == 25 * 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert store.lookup(asked.selectExpr("lower(value) as value"), opened).count() == 0  # case matters


def test_compaction(spark):
    path = scratch_path(spark, "store")
    for _ in range(3):
        piled = store.append_store(_iocs(spark, 0, 1500), "t_piled", path, buckets=4)
    assert piled.count() == 4500
    new = scratch_path(spark, "store")
    small = store.compact(piled, "t_compact", new, ["value", "type", "source"], buckets=4)
    assert small.count() == 1500 and small.columns == piled.columns
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in piled.distinct().collect()}
    assert len(spark.read.parquet(new).inputFiles()) <= 4
    one = store.compact(piled, "t_least", scratch_path(spark, "store"), ["value"], buckets=4)
    least = {}
    for r in piled.collect():
        least[r.value] = min(least.get(r.value, (r.type, r.source, r.seen)), (r.type, r.source, r.seen))
    assert {r.value: (r.type, r.source, r.seen) for r in one.collect()} == least and len(least) == 500


@pytest.fixture(scope="module")
def found(spark):
    return findings(spark, SF).cache()


def test_sketches_merge(spark):
    n = 200_000
    many = spark.range(n).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("timestamp"),
                                 F.concat(F.lit("T"), (F.col("id") % 700).cast("string")).alias("mitre_technique_id"),
                                 (F.col("id") % 50_000).cast("string").alias("hostname"), F.lit("u").alias("username"))
    daily = report.daily_sketches(many)
    assert daily.count() == 40
    month = {r.month: r for r in report.roll_up(daily, F.date_format("day", "yyyy-MM").alias("month")).collect()}
    whole = report.roll_up(daily).first()
    assert whole.finding_count == n and sum(r.finding_count for r in month.values()) == n
    for got, exact in ((whole.techniques, 700), (whole.hosts, 50_000), (whole.users, 1)):
        assert abs(got - exact) <= 0.05 * exact
    assert abs(report.distinct_techniques(many, exact=False).first()[0] - 700) <= 35
    assert abs(report.affected_infrastructure(many, exact=False).first().hosts - 50_000) <= 2500
    assert report.distinct_techniques(many).first()[0] == 700
    assert report.roll_up(report.daily_sketches(many.filter("false"))).first().finding_count is None


def test_rankings_equal_their_own_queries(found):
    got = {}
    for r in report.rankings(found).collect():
        got.setdefault(r.ranking, {})[r.name] = (r.finding_count, r.avg_risk)
    counts = {k: {n: c for n, (c, _) in v.items()} for k, v in got.items()}
    assert counts["level"] == {r.rule_level: r.finding_count for r in report.level_counts(found).collect()}
    assert counts["tactic"] == {r.tactic: r.finding_count for r in report.attack_stages(found).collect()}
    assert counts["hour"] == {str(r.hour): r.finding_count for r in report.hourly_activity(found).collect()}
    assert got["host"] == {r.hostname: (r.finding_count, r.avg_risk) for r in report.host_risk(found).collect()}
    top = [(r.technique_name, r.finding_count) for r in report.top_techniques(found).collect()]
    assert sorted(counts["technique"].items(), key=lambda x: (-x[1], x[0]))[:5] == top


def test_rankings_are_one_pass(spark):
    plan = _plan(report.rankings(findings(spark, SF)))
    assert plan.count("Expand") == 1 and plan.count("FileScan parquet") <= 2  # the events, and no more than one side table


def test_tactics_from_a_table(spark, found):
    table = spark.createDataFrame([*report.TACTICS.items(), ("T1003", "Zzz")], "technique_id string, tactic string")
    assert sorted(report.attack_stages(found, table).collect()) == sorted(report.attack_stages(found).collect())
    ranked = [sorted(map(repr, report.rankings(found, m).collect())) for m in (None, table)]
    assert ranked[0] == ranked[1]
    assert {r.tactic for r in report.attack_stages(found, {"T1003": "X"}).collect()} == {"X", "Unknown"}
