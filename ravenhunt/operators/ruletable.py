"""The hunt's rules as data: J1 for thousands of rules.

Every rule whose matches all hold one of some literals is found through those
literals. For each of them one *key* goes into a table: the hash of a whole
value (``equals``), of a beginning or an end (``startswith``, ``endswith``), or
of a short gram of a ``contains`` literal, chosen to be rare among the rules. A
log row makes the same hashes of its own values, so that one hash join on a
long finds the (row, rule) pairs that may match, whatever the number of rules.
A second join brings the whole rule (selections, items, values and the truth
table of its condition) to the pair, and the rule is evaluated as data.

Left for the compiled form are rules that no literal can find: conditions such
as ``not a``, and those of more than ``MAX_SELECTIONS`` selections.
"""

from __future__ import annotations

import ast
import itertools
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenhunt.functions.matching import KNOWN_OPS, wildcard_regex
from ravenhunt.operators.conditions import UnsupportedCondition, evaluate_python, parse_condition
from ravenhunt.operators.joins import sized_local
from ravenhunt.schemas import LOG_COLUMNS

GRAM, MAX_SELECTIONS = 4, 10
EQUALS, STARTS, ENDS, HAS = range(4)
_KINDS = {"equals": EQUALS, "startswith": STARTS, "endswith": ENDS, "contains": HAS}
Item = tuple[str | None, str, list[str]]


@dataclass
class IndexedRule:
    meta: tuple
    selections: list[list[Item] | None]  # None: never true
    truth: str  # by the selections' bits, the first highest
    literals: list[tuple[str, int, str]] = field(default_factory=list)  # (field, kind, literal)


@dataclass
class Parsed:
    indexed: list[IndexedRule]
    everywhere: list[int]  # rules that need every row


def parse(rule_rows: list[dict], resolve: Callable[[str], str | None]) -> Parsed:
    """Rules as data; rules with an error or an unsupported condition never fire."""
    out = Parsed([], [])
    for i, d in enumerate(rule_rows):
        if d.get("error"):
            continue
        try:
            tree = parse_condition(d.get("condition"))
        except UnsupportedCondition:
            continue
        known = {s["name"].lower(): items_of(s["items"], resolve) for s in d.get("selections") or []}
        names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} & known.keys())
        cover = _cover(tree, known)
        if cover is None or len(names) > MAX_SELECTIONS:
            out.everywhere.append(i)
            continue
        truth = "".join("01"[evaluate_python(d["condition"], dict(zip(names, bits, strict=True)))] for bits in itertools.product((False, True), repeat=len(names)))
        if cover and "1" in truth:
            meta = (d.get("id"), d.get("title"), d.get("rule_level"), d.get("technique_id"))
            out.indexed.append(IndexedRule(meta, [known[n] for n in names], truth, sorted({x for n in cover for x in _literals(known[n])})))
    return out


def items_of(items: list[dict], resolve: Callable[[str], str | None]) -> list[Item] | None:
    """A selection's items, lower-cased; None where one of them can never hold."""
    out = []
    for it in items:
        name = resolve(it["field"])
        values = [str(v).lower() for v in it["values"]]
        if name is None or it["op"] not in KNOWN_OPS or not values:
            return None
        out.append((name, it["op"], values))
    return out


def _literals(items: list[Item] | None) -> list[tuple[str, int, str]] | None:
    """Literals of one item, one of which every match holds; None: there are none to go by."""
    best = None
    for name, op, values in items or []:
        parts = [max(v.split("*"), key=len) if op == "contains" else v for v in values]
        if all(parts) or op == "equals":
            rank = (op == "equals", min(map(len, parts)), -len(parts))
            if best is None or rank > best[0]:
                best = rank, [(name, _KINDS[op], p) for p in parts]
    return best and best[1]


def _cover(node: ast.AST, known: dict[str, list[Item] | None]) -> set[str] | None:
    """Selections of which every match of the condition holds one; None: no such set."""
    if isinstance(node, ast.Name):
        if known.get(node.id) is None:
            return set()  # undefined or never true
        return {node.id} if _literals(known[node.id]) else None
    if isinstance(node, ast.BoolOp):
        covers = [_cover(v, known) for v in node.values]
        if isinstance(node.op, ast.And):
            return min((c for c in covers if c is not None), key=len, default=None)
        return None if None in covers else set().union(*covers)
    return None


def _tag(name: str, kind: int, size: int) -> int:
    """What a key's literal is compared with."""
    return (LOG_COLUMNS.index(name) * 4 + kind) * 4096 + min(size, 4095)


def _keys(rules: list[IndexedRule]) -> list[tuple[int, int, str]]:
    """(rule, tag, text) of every literal."""
    seen = Counter(lit[i : i + GRAM] for r in rules for _, kind, lit in r.literals if kind == HAS for i in range(max(1, len(lit) - GRAM + 1)))
    out = []
    for k, r in enumerate(rules):
        for name, kind, lit in r.literals:
            if kind == HAS:
                lit = min((lit[i : i + GRAM] for i in range(max(1, len(lit) - GRAM + 1))), key=seen.__getitem__)
            elif kind in (STARTS, ENDS):  # longer ones share the keys of this size
                lit = lit[:4095] if kind == STARTS else lit[-4095:]
            out.append((k, _tag(name, kind, 0 if kind == EQUALS else len(lit)), lit))
    return list(dict.fromkeys(out))


def _bytes(rule: IndexedRule) -> int:
    """About how large a rule is in a broadcast."""
    return 300 + len(rule.truth) + sum(64 + sum(32 + 2 * len(v) for v in vs) for s in rule.selections for _, _, vs in s or [])


def _gram_keys(value: Column, size: int, tag: int) -> Column:
    """The keys of all grams of a value."""
    grams = F.transform(F.sequence(F.lit(1), F.length(value) - size + 1), lambda i: F.substr(value, i, F.lit(size)))
    keys = F.transform(F.array_distinct(grams), lambda g: F.xxhash64(F.lit(tag), g))
    return F.coalesce(F.when(F.length(value) >= size, keys), F.array().cast("array<bigint>"))


def matches(prepared: DataFrame, rules: list[IndexedRule], lowered: Callable[[str], str]) -> DataFrame:
    """(log row, rule) pairs that match, with the rules' four columns."""
    spark = prepared.sparkSession
    keys = _keys(rules)
    table = spark.createDataFrame(keys or [(0, 0, "")], "rule int, tag int, text string")
    table = table.select("rule", F.xxhash64("tag", "text").alias("key")).filter(F.lit(bool(keys)))
    asked = []
    for tag in sorted({t for _, t, _ in keys}):
        (name, kind), size = divmod(tag // 4096, 4), tag % 4096
        value = F.col(lowered(LOG_COLUMNS[name]))
        if kind == HAS:
            asked.append(_gram_keys(value, size, tag))
        else:
            part = value if kind == EQUALS else F.left(value, F.lit(size)) if kind == STARTS else F.right(value, F.lit(size))
            asked.append(F.when(value.isNotNull(), F.array(F.xxhash64(F.lit(tag), part))).otherwise(F.array().cast("array<bigint>")))
    asked = F.concat(*asked) if asked else F.array().cast("array<bigint>")
    rows = prepared.withColumn("asked", asked)
    pairs = rows.select("*", F.explode("asked").alias("key")).join(sized_local(table, 24 * len(keys)), "key")
    by_rule = table.groupBy("rule").agg(F.collect_list("key").alias("keys"))
    whole = spark.createDataFrame(
        [(k, *r.meta, r.truth, [[(LOG_COLUMNS.index(n), op, [v for v in vs if "*" not in v or op != "contains"],
                                  [wildcard_regex(v) for v in vs if "*" in v and op == "contains"]) for n, op, vs in s] if s is not None
                                else [(0, "never", [], [])] for s in r.selections]) for k, r in enumerate(rules)] or [(-1, None, None, None, None, "0", [])],
        "rule int, hunting_rule_id string, hunting_rule_title string, rule_level string, mitre_technique_id string, truth string, "
        "selections array<array<struct<field: int, op: string, literals: array<string>, patterns: array<string>>>>")
    values = F.array(*[F.col(lowered(c)) for c in LOG_COLUMNS])

    def holds(item: Column) -> Column:
        value = F.get(values, item["field"])
        one = F.exists(item["literals"], lambda x: F.when(item["op"] == "contains", F.contains(value, x)).when(item["op"] == "startswith", F.startswith(value, x))
                       .when(item["op"] == "endswith", F.endswith(value, x)).when(item["op"] == "equals", value == x).otherwise(F.lit(False)))
        return value.isNotNull() & F.coalesce(one | F.exists(item["patterns"], lambda x: F.rlike(value, x)), F.lit(False))

    bits = F.array_join(F.transform("selections", lambda s: F.when(F.forall(s, holds), "1").otherwise("0")), "")
    fires = F.substr("truth", F.conv(bits, 2, 10).cast("int") + 1, F.lit(1)) == "1"
    whole = sized_local(whole.join(by_rule, "rule"), sum(map(_bytes, rules)) + 24 * len(keys))
    # a row that holds several of a rule's literals meets it once, by the least key
    once = F.col("key") == F.array_min(F.array_intersect("asked", "keys"))
    return pairs.join(whole, "rule").where(once).where(fires)
