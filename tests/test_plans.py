"""Physical-plan shape of the flagship queries (what .explain shows)."""

from ravenhunt.plans.catalog import findings
from ravenhunt.plans.views import log_view

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_view_scan_is_pruned(spark):
    plan = _plan(log_view(spark, SF).select("hostname", "process_name"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_compiled_hunt_plan(spark):
    plan = _plan(findings(spark, SF, strategy="compiled"))
    assert "Generate stack(" in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan  # technique table, size-checked
    log_side = plan.split("BroadcastExchange")[0]
    # the only shuffle over log data is the distinct of findings, with a
    # partial (map-side) aggregate below it
    assert log_side.count("Exchange hashpartitioning") == 1 and log_side.count("HashAggregate") == 2


def test_table_hunt_plan(spark):
    plan = _plan(findings(spark, SF, strategy="table"))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("BroadcastHashJoin") >= 3  # keys, rules, techniques
    assert "events.parquet" in plan.split("BroadcastExchange")[0]


def test_index_hunt_plan(spark):
    """One scan of the log, one shuffle of matched log rows, and joins with the rules' metadata and the techniques only."""
    plan = _plan(findings(spark, SF, strategy="index"))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("MapInArrow") == 1 and plan.count("events.parquet") == 1
    log_side = plan.split("BroadcastExchange")[0]
    assert log_side.count("Exchange hashpartitioning") == 1 and log_side.count("HashAggregate") == 2
    assert plan.count("BroadcastHashJoin") == 2
