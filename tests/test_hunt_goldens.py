"""Hunt on the small logs of ``fixtures``: 4 / 3 / 3 / 0 findings."""

import os

import pytest

from ravenhunt.operators.hunt import hunt
from ravenhunt.plans.ruleset import REFERENCE_RULES, rule_table, technique_table
from ravenhunt.sources.logs import read_csv_logs
from tests import fixtures as fx


def _write(tmp_dir, name, text):
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def _triples(df):
    return {(r.timestamp.strftime("%Y-%m-%d %H:%M:%S"), r.hostname, r.hunting_rule_title) for r in df.collect()}


@pytest.mark.parametrize("strategy", ["auto", "compiled", "table", "index"])
@pytest.mark.parametrize(
    "text,expected",
    [
        (fx.SAMPLE_CSV, fx.EXPECTED_SAMPLE),
        (fx.ATTACK_CSV, fx.EXPECTED_ATTACK),
        (fx.MIXED_CSV, fx.EXPECTED_ATTACK),
        (fx.QUIET_CSV, set()),
    ],
)
def test_scenarios(spark, tmp_dir, text, expected, strategy):
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", text))
    f = hunt(logs, rule_table(spark, REFERENCE_RULES), technique_table(spark), strategy=strategy)
    assert _triples(f) == expected


def test_sample_finding_values(spark, tmp_dir):
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", fx.SAMPLE_CSV))
    f = hunt(logs, rule_table(spark, REFERENCE_RULES), technique_table(spark))
    rows = {r.hunting_rule_title: r for r in f.collect()}
    wm = rows[fx.WM]
    assert wm.rule_level == "high" and wm.risk_score == 90
    assert wm.mitre_technique_id == "T1003" and wm.mitre_technique_name == "OS Credential Dumping"
    assert wm.mitre_technique_url == "https://attack.mitre.org/techniques/T1003"
    assert wm.event_id == "4688" and wm.source_ip is None
    ns = rows[fx.NS]
    assert ns.risk_score == 40 and ns.mitre_technique_id == "T1049"
    assert len(f.columns) == 16


def test_compat_nulls_reproduce_nan_tokens(spark, tmp_dir):
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", fx.SAMPLE_CSV))
    f = hunt(logs, rule_table(spark, REFERENCE_RULES), technique_table(spark), compat_nulls=True)
    netstat = [r for r in f.collect() if r.hunting_rule_title == fx.NS][0]
    assert netstat.source_ip == "nan" and netstat.destination_ip == "nan"


def test_unknown_technique_scores_zero(spark, tmp_dir):
    rule = dict(REFERENCE_RULES[1], tags=["attack.t9999"], id="x")
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", fx.SAMPLE_CSV))
    f = hunt(logs, rule_table(spark, [rule]), technique_table(spark))
    r = f.collect()[0]
    assert r.risk_score == 0 and r.mitre_technique_name is None and r.mitre_technique_id == "T9999"


def test_empty_rules_give_finding_schema(spark, tmp_dir):
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", fx.SAMPLE_CSV))
    f = hunt(logs, rule_table(spark, []), technique_table(spark))
    assert f.count() == 0 and len(f.columns) == 16


def test_duplicate_rows_deduplicated(spark, tmp_dir):
    logs = read_csv_logs(spark, _write(tmp_dir, "log.csv", fx.SAMPLE_CSV))
    f = hunt(logs.unionByName(logs), rule_table(spark, REFERENCE_RULES), technique_table(spark))
    assert f.count() == 4


@pytest.mark.parametrize("strategy", ["table", "index"])
def test_catalog_rules_equal_between_strategies(spark, strategy):
    from ravenhunt.plans.views import log_view

    lv = log_view(spark, "/root/testdata/sf0.001")
    a = hunt(lv, rule_table(spark), technique_table(spark), strategy="compiled")
    b = hunt(lv, rule_table(spark), technique_table(spark), strategy=strategy)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _many_rules(n):
    """Rules of all shapes over the log view's values."""
    out = []
    for k in range(n):
        detection = [
            {"selection": {"username": f"user{k}"}, "condition": "selection"},
            {"a": {"source_ip|startswith": f"10.0.{k % 256}."}, "b": {"hostname": [f"HOST-{k % 20}", "x"]}, "condition": "a and b"},
            {"a": {"CommandLine|contains": f'"k": {k % 100}}}'}, "b": {"action": "click"}, "condition": "a and not b"},
            {"a": {"destination_ip|endswith": f".{k % 200}"}, "b": {"Image|contains": "c*d"}, "condition": "a and b or b and c"},
            {"a": {"Image|contains": ["cmd", "calc"]}, "b": {"event_id": str(k)}, "condition": "(b or a) and b"},
            {"a": {"Image|contains": "cmd"}, "b": {"nofield": "x"}, "condition": "a and not b and not (a and b)"},
            {"a": {"event_id|endswith": f"{k:04d}"}, "condition": "a"},
        ][k % 7]
        out.append({"id": f"r{k}", "title": f"t{k}", "level": ["low", "high"][k % 2], "tags": ["attack.t1049"], "detection": detection})
    out.append({"id": "not", "title": "not", "detection": {"a": {"action": "click"}, "condition": "not a"}})
    return out


@pytest.mark.parametrize("strategy", ["table", "index"])
def test_hundreds_of_rules_equal_the_compiled_form(spark, strategy):
    from ravenhunt.plans.views import log_view

    lv = log_view(spark, "/root/testdata/sf0.001")
    rules = rule_table(spark, _many_rules(300))
    for dedupe in (True, False):
        a = hunt(lv, rules, technique_table(spark), strategy="compiled", dedupe=dedupe)
        b = hunt(lv, rules, technique_table(spark), dedupe=dedupe, strategy=strategy)
        assert a.count() == b.count() > 300
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_thousands_of_rules_run(spark):
    from ravenhunt.plans.views import log_view

    f = hunt(log_view(spark, "/root/testdata/sf0.001"), rule_table(spark, _many_rules(5000)), technique_table(spark))
    assert f.select("hunting_rule_id").distinct().count() > 500
