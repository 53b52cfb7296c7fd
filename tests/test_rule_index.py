"""The rule index against the compiled form and a plain loop, on odd rules and odd values."""

import random

import pytest

from ravenhunt.operators import hunt as H
from ravenhunt.operators import ruleindex
from ravenhunt.plans.ruleset import technique_table
from ravenhunt.schemas import LOG_COLUMNS, LOG_SCHEMA, RULE_SCHEMA

VALUES = ["cmd.exe", "CMD", "a", "", None, "aXb", "axxb\nc", "\x02cmd\x03", "cmd\x03.exe", "x.y*z", "powershell -enc AAA=", "ÄÖ straße", "\x02", "user1", "user11", "10.0.1.5", "10.0.11.5"]
LITERALS = ["cmd", "", "a", "a*b", "*", "x.y*z", "p*shell*=", "ß", "user1", "10.0.1.", ".5", "CMD", "exe", "\x02cmd", "c*\x03", "ä"]
CONDITIONS = ["a", "not a", "a and b", "a or b", "a and not b", "b or missing", "missing or b", "not (a or b)", "(a or b) and c", "a and b or c", "not missing", "a or b or c", "1 of them", "", None]
FIELDS = ["Image", "commandline", "hostname", "username", "event_id", "source_ip", "action", "nofield"]


def odd_logs(spark, n=120, seed=3):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice(VALUES)
    rows = [(None, pick(), pick(), pick(), rnd.choice([None, 1, 11, 4688]), pick(), pick(), pick(), pick()) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:20], LOG_SCHEMA).repartition(3)


def odd_rules(n, seed=5):
    rnd, out = random.Random(seed), []
    for k in range(n):
        selections = []
        for name in "abc":
            items = [{"field": rnd.choice(FIELDS), "op": rnd.choice(["contains", "startswith", "endswith", "equals", "equals", "contains", "regex"] if rnd.random() < 0.2 else ["contains", "startswith", "endswith", "equals"]),
                      "values": [rnd.choice(LITERALS) for _ in range(rnd.randint(1, 3))]} for _ in range(rnd.choice([0, 1, 1, 1, 2]))]
            selections.append({"name": rnd.choice([name, name.upper()]), "items": items})
        out.append({"id": f"r{k % (n - 5)}", "title": f"t{k % 7}", "level": rnd.choice([None, "low", "HIGH"]), "tags": rnd.choice([None, ["attack.t1049"], ["x", "attack.T1003.001"]]),
                    "selections": selections, "condition": rnd.choice(CONDITIONS), "error": "bad" if k % 40 == 7 else None})
    many = [{"name": f"s{i}", "items": [{"field": "action", "op": "contains", "values": [v]}]} for i, v in enumerate(LITERALS[2:14])]
    out.append({"id": "wide", "title": "wide", "selections": many, "condition": " or ".join(s["name"] for s in many)})
    out.append({"id": "many", "title": "many", "selections": many, "condition": "s1 and not s2"})
    return [{f: r.get(f) for f in RULE_SCHEMA.names} for r in out]


def same(a, b):
    rows = [sorted(map(repr, df.collect())) for df in (a, b)]
    assert rows[0] == rows[1]
    return len(rows[0])


@pytest.mark.parametrize("dedupe", [True, False])
@pytest.mark.parametrize("compat", [True, False])
def test_equal_to_the_compiled_form(spark, dedupe, compat):
    logs, rules = odd_logs(spark), spark.createDataFrame(odd_rules(150), RULE_SCHEMA).repartition(3)
    kw = {"dedupe": dedupe, "compat_nulls": compat}
    assert same(H.hunt(logs, rules, technique_table(spark), strategy="compiled", **kw), H.hunt(logs, rules, technique_table(spark), strategy="index", **kw)) > 500


def test_blocks_and_steps_give_the_same(spark, monkeypatch):
    logs, rules = odd_logs(spark, 60), spark.createDataFrame(odd_rules(60), RULE_SCHEMA)
    whole = H.hunt(logs, rules, None, strategy="index").cache()
    whole.count()
    monkeypatch.setattr(ruleindex, "STEP", 1)
    monkeypatch.setattr(ruleindex.matches, "__defaults__", (2000,))
    same(whole, H.hunt(logs, rules, None, strategy="index"))


def test_no_rules_and_no_rows(spark):
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert H.hunt(odd_logs(spark), none, None, strategy="index").collect() == []
    rules = spark.createDataFrame(odd_rules(20), RULE_SCHEMA)
    assert H.hunt(odd_logs(spark).filter("false"), rules, None, strategy="index").collect() == []


def test_default_reads_few_rules(spark):
    """Beyond the bound the default takes the index; a given list of rules works too."""
    logs, rules = odd_logs(spark, 30), odd_rules(H.COMPILED_RULES + 20)
    frame = spark.createDataFrame(rules, RULE_SCHEMA)
    default = H.hunt(logs, frame, None)
    assert "MapInArrow" in default._jdf.queryExecution().toString()
    assert "MapInArrow" not in H.hunt(logs, frame.limit(50), None)._jdf.queryExecution().toString()
    assert same(default, H.hunt(logs, frame, None, strategy="compiled")) > 100


def plain(op, values, text):
    import re

    if text is None:
        return False
    text, values = text.lower(), [v.lower() for v in values]
    return any({"contains": lambda v: bool(re.search(".*".join(map(re.escape, v.split("*"))), text)), "startswith": text.startswith, "endswith": text.endswith, "equals": text.__eq__}[op](v) for v in values)


def test_literals_find_every_item():
    items = {(5, op, (v.lower(), "never there")): None for op in ("contains", "startswith", "endswith", "equals") for v in LITERALS}
    items = {k: i for i, k in enumerate(items)}
    literals = ruleindex.Literals(items)
    for value in VALUES:
        found = literals.of(value and value.lower())
        assert found == sorted(i for (_, op, vs), i in items.items() if plain(op, vs, value)), value


def test_covers():
    from ravenhunt.operators.conditions import parse_condition

    def options(text, known):
        return [sorted(c) for c in ruleindex.covers(parse_condition(text), known)]

    known = {"a": [1], "b": [1], "never": None, "always": []}
    assert options("a and b", known) == [["a"], ["b"]]
    assert options("a or b", known) == [["a", "b"]]
    assert options("a and not b", known) == [["a"]] and options("not a", known) == []
    assert options("a or never", known) == [["a"]] and options("a and never", known) == [[], ["a"]]
    assert options("a or always", known) == [] and options("a and always", known) == [["a"]]
    assert options("a and (a or b)", known) == [["a"], ["a", "b"]]


def test_rules_that_fire_alike_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(ruleindex, "PIECE", 40)
    item = lambda f, v: [{"field": f, "op": "contains", "values": [v]}]
    rules = [{"id": f"r{k}", "title": "t", "level": "low", "tags": ["attack.t1049"], "condition": "a and not b",
              "selections": [{"name": "a", "items": item("Image", "a")}, {"name": "b", "items": item("action", "cmd" if k % 2 else "exe")}]} for k in range(200)]
    rules.append(rules[0] | {"condition": "a"})  # the metadata of r0, in other rows
    rules = spark.createDataFrame([{f: r.get(f) for f in RULE_SCHEMA.names} for r in rules], RULE_SCHEMA)
    table = ruleindex.compiled(H.with_rule_attributes(rules), lambda name: H._resolve_field(name, H.DEFAULT_FIELD_MAP | {"image": "process_name"}))
    index, pieces = ruleindex.rule_classes(table, True, lambda df: df)
    assert index.select("number").distinct().count() == 3 and index.count() == 4
    assert sorted(r.n for r in index.groupBy("number").agg({"pieces": "max"}).toDF("number", "n").collect()) == [1, 3, 3]
    assert pieces.selectExpr("sum(size(rules))").first()[0] == 200
    logs = odd_logs(spark)
    assert same(H.hunt(logs, rules, technique_table(spark), strategy="compiled"), H.hunt(logs, rules, technique_table(spark), strategy="index")) > 500


def compiled_rules(n):
    import pyarrow as pa

    item = lambda f, v: [{"field": LOG_COLUMNS.index(f), "op": "equals", "values": [v]}]
    rows = [(k, 1, "0010", [item("username", f"user{k}"), item("action", "click")], [[0]]) for k in range(n)]
    types = {"number": pa.int64(), "pieces": pa.int32(), **{c: ruleindex._COMPILED_ARROW[c] for c in ("truth", "selections", "options")}}
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def test_work_on_a_row_does_not_grow_with_the_rules(monkeypatch):
    """A batch that few rules may match is one step, however many rules there are."""
    import pyarrow as pa

    index, steps, step = ruleindex.RuleIndex(compiled_rules(5000)), [], ruleindex.RuleIndex.step
    monkeypatch.setattr(ruleindex.RuleIndex, "step", lambda self, lo, hi, *a: steps.append(hi - lo) or step(self, lo, hi, *a))
    rows = [(f"user{k}", "click" if k % 3 == 0 else "view" if k % 3 == 1 else None) for k in range(10_000)]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["username", "action"])
    row, number = index.matches(batch, lambda c: c)
    assert list(zip(row, number, strict=True)) == [(k, k) for k in range(5000) if k % 3]
    assert steps == [10_000]


def test_listed_is_to_pylist():
    import pyarrow as pa

    rows = [{"a": [{"b": ["x", None], "c": 1}, {"b": [], "c": None}], "d": "t"}, {"a": None, "d": None}, {"a": [], "d": "u"}, {"a": [{"b": None, "c": 2}, None], "d": ""}, None]
    column = pa.array(rows, pa.struct([("a", pa.list_(pa.struct([("b", pa.list_(pa.string())), ("c", pa.int32())]))), ("d", pa.string())]))
    for part in (column, column[1:], column[2:4], column[:0]):
        assert ruleindex.listed(part) == part.to_pylist()


def test_findings_of_many_rules_are_dealt_finely(spark):
    """Rules that fire alike are unfolded by several tasks, and event_id is not cast for each finding."""
    rules = [{"id": f"r{k}", "title": "t", "level": "low", "tags": ["attack.t1049"], "condition": "a",
              "selections": [{"name": "a", "items": [{"field": "Image", "op": "contains", "values": ["cmd"]}]}]} for k in range(1100)]
    rules = spark.createDataFrame([{f: r.get(f) for f in RULE_SCHEMA.names} for r in rules], RULE_SCHEMA)
    table = ruleindex.compiled(H.with_rule_attributes(rules), lambda name: H._resolve_field(name, H.DEFAULT_FIELD_MAP | {"image": "process_name"}))
    _, pieces = ruleindex.rule_classes(table, True, lambda df: df)
    sizes = [r.n for r in pieces.selectExpr("size(rules) n").collect()]
    assert sum(sizes) == 1100 and len(sizes) == 5 and max(sizes) < 400
    found = H.hunt(odd_logs(spark, 40), rules, technique_table(spark), event_id="long")
    assert dict(found.dtypes)["event_id"] == "bigint"
    assert "as string" not in found._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[0]
    assert same(found, H.hunt(odd_logs(spark, 40), rules, technique_table(spark), strategy="table").selectExpr(*[f"cast({c} as long) {c}" if c == "event_id" else c for c in found.columns])) >= 1100
