"""F8 hunt: every rule over every log row -> enriched, de-duplicated findings.

Three physical forms with equal results:

* ``compiled`` - each rule becomes one boolean Column; in a single scan each
  row gets rule-hit bitmasks (inside a one-row ``stack`` generator, so every
  predicate is evaluated once), matched rows are de-duplicated, and a second
  ``stack`` expands the set bits into findings whose metadata comes from a
  literal array. No join; planning cost grows with the rules.
* ``index`` - the rules are compiled on the executors, and the log rows pass
  one automaton over all their literals (``operators.ruleindex``). The plan is
  the same for a hundred rules and for hundreds of thousands, and no rule is
  collected but those of more than ``MAX_SELECTIONS`` selections.
* ``table`` - the rules are data, found by hash joins of literals and grams
  (``operators.ruletable``), without Python on the workers.

The default, ``auto``, is ``compiled`` for up to ``COMPILED_RULES`` rules and
``index`` beyond; only so many rules are read to find out. Log data never
leaves the executors. All forms then take a size-checked broadcast join with
the technique table (whose columns are functions of the rule), the risk score
and the 16-column projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravenhunt.functions.matching import KNOWN_OPS, item_predicate
from ravenhunt.operators.conditions import UnsupportedCondition, condition_column
from ravenhunt.operators.joins import sized_broadcast
from ravenhunt.schemas import FINDING_COLUMNS, LOG_COLUMNS, RULE_SCHEMA, RULE_VISIBLE_COLUMNS

# --- fixed values (must equal the reference's behaviour) -------------------
# Rule field aliases (compared ignoring case); other fields must name a log
# column exactly.
DEFAULT_FIELD_MAP = {"image": "process_name", "commandline": "message"}
# Level -> risk score when the technique is known; 0 when it is not.
LEVEL_SCORES = {"critical": 100, "high": 90, "medium": 70, "low": 40}
OTHER_LEVEL_SCORE = 20
UNKNOWN_TECHNIQUE_SCORE = 0
DEFAULT_LEVEL = "informational"
TECHNIQUE_TAG_PATTERN = r"attack\.t(\d+(?:\.\d+)?)"
NULL_TOKEN = "nan"
# ----------------------------------------------------------------------------

def technique_from_tags(tags: Column) -> Column:
    """First tag matching ``attack.t<id>`` (lower-cased) -> ``T<id>``."""
    ids = F.transform(tags, lambda t: F.regexp_extract(F.lower(t), TECHNIQUE_TAG_PATTERN, 1))
    first = F.try_element_at(F.filter(ids, lambda x: x != ""), F.lit(1))
    return F.when(first.isNotNull(), F.concat(F.lit("T"), first))


def rule_level(level: Column) -> Column:
    """Lower-case level; absent or empty -> ``informational``."""
    return F.when(F.coalesce(level, F.lit("")) == "", F.lit(DEFAULT_LEVEL)).otherwise(F.lower(level))


def risk_score(level: Column, technique_found: Column) -> Column:
    """Score by level, only when the technique is known; else 0."""
    score = F.lit(OTHER_LEVEL_SCORE)
    for name, value in reversed(list(LEVEL_SCORES.items())):
        score = F.when(level == name, F.lit(value)).otherwise(score)
    return F.when(F.coalesce(technique_found, F.lit(False)), score).otherwise(
        F.lit(UNKNOWN_TECHNIQUE_SCORE)
    ).cast(T.IntegerType())


def with_rule_attributes(rules: DataFrame) -> DataFrame:
    return rules.withColumn("technique_id", technique_from_tags(F.col("tags"))).withColumn(
        "rule_level", rule_level(F.col("level"))
    )


@dataclass
class CompiledRule:
    index: int
    rule_id: str | None
    title: str | None
    level: str
    technique_id: str | None
    predicate: Column | None
    selections: dict = field(default_factory=dict)
    condition: str | None = None
    reason: str | None = None


def _lc(name: str) -> str:
    return f"__lc_{name}"


def _resolve_field(raw: str, field_map: dict[str, str]) -> str | None:
    mapped = field_map.get(raw.lower())
    if mapped is not None:
        return mapped
    return raw if raw in LOG_COLUMNS else None


def selection_column(items, field_map: dict[str, str]) -> Column | bool:
    """AND over items, OR over values; unknown field/op -> false."""
    out: Column | bool = True
    for item in items:
        col_name = _resolve_field(item["field"], field_map)
        if col_name is None or item["op"] not in KNOWN_OPS:
            return False
        pred = F.coalesce(item_predicate(F.col(_lc(col_name)), item["op"], item["values"]), F.lit(False))
        out = pred if out is True else (out & pred)
    return F.lit(True) if out is True else out


_COMPILED: dict = {}


def compile_rules(rule_rows, field_map: dict[str, str] | None = None) -> list[CompiledRule]:
    """Rule rows -> CompiledRule list. Columns are immutable expressions, so
    the result is reused for the same rules, field map and SparkContext."""
    fmap = {k.lower(): v for k, v in (field_map or DEFAULT_FIELD_MAP).items()}
    from pyspark import SparkContext

    dicts = [r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r) for r in rule_rows]
    key = (SparkContext._active_spark_context.applicationId, repr(dicts), tuple(sorted(fmap.items())))
    cached = _COMPILED.get(key)
    if cached is not None:
        return cached
    if len(_COMPILED) > 64:
        _COMPILED.clear()
    _COMPILED[key] = out = _compile_rules(dicts, fmap)
    return out


def _compile_rules(rule_rows: list[dict], fmap: dict[str, str]) -> list[CompiledRule]:
    compiled = []
    for i, d in enumerate(rule_rows):
        cr = CompiledRule(
            index=i,
            rule_id=d.get("id"),
            title=d.get("title"),
            level=d.get("rule_level") or DEFAULT_LEVEL,
            technique_id=d.get("technique_id"),
            predicate=None,
            condition=d.get("condition"),
        )
        if d.get("error"):
            cr.reason = d["error"]
            compiled.append(cr)
            continue
        sels = {}
        for s in d.get("selections") or []:
            # Selection names are matched ignoring case.
            sels[s["name"].lower()] = selection_column(s["items"], fmap)
        cr.selections = {s["name"].lower(): s["items"] for s in d.get("selections") or []}
        try:
            cr.predicate = condition_column(d.get("condition"), sels)
        except UnsupportedCondition as exc:
            cr.reason = str(exc)
        compiled.append(cr)
    return compiled


def prepare_logs(logs: DataFrame, compat_nulls: bool = False) -> DataFrame:
    """Fixed log columns + one lower-cased text copy of each (computed once)."""
    base = logs.select(*LOG_COLUMNS)
    lowered = {}
    for c in LOG_COLUMNS:
        text = F.col(c).cast("string")
        if compat_nulls and c in RULE_VISIBLE_COLUMNS:
            text = F.coalesce(text, F.lit(NULL_TOKEN))
        lowered[_lc(c)] = F.lower(text)
    out = base.withColumns(lowered)
    if compat_nulls:
        out = out.withColumns(
            {c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)) for c in RULE_VISIBLE_COLUMNS}
        )
    return out


def first_technique(techniques: DataFrame) -> DataFrame:
    """One row per technique id, the first by bundle file and place in it
    (``path``, ``pos``), then by its other columns, so that the result never
    depends on how the rows are dealt."""
    order = [c for c in ("path", "pos") if c in techniques.columns]
    rest = [c for c in techniques.columns if c not in ("technique_id", "path", "pos")]
    w = Window.partitionBy("technique_id").orderBy(*order, *rest)
    return techniques.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "path", "pos")


def enrich_technique(raw: DataFrame, techniques: DataFrame | None) -> DataFrame:
    """J2 + P12: left join the technique table on id, then the risk score."""
    if techniques is None:
        tech = raw.sparkSession.createDataFrame(
            [], "technique_id string, name string, url string"
        )
    else:
        tech = first_technique(techniques).select("technique_id", "name", "url")
    tech = tech.select(
        F.col("technique_id").alias("__tid"),
        F.col("name").alias("mitre_technique_name"),
        F.col("url").alias("mitre_technique_url"),
        F.lit(True).alias("__tech_found"),
    )
    # driver-local rows are bounded by the driver's memory; others are measured
    local = techniques is None or techniques.isLocal()
    joined = raw.join(F.broadcast(tech) if local else sized_broadcast(tech), raw["mitre_technique_id"] == F.col("__tid"), "left")
    return joined.withColumn("risk_score", risk_score(F.col("rule_level"), F.col("__tech_found")))


def _meta_struct(cr: CompiledRule) -> Column:
    return F.struct(
        F.lit(cr.rule_id).cast("string").alias("hunting_rule_id"),
        F.lit(cr.title).cast("string").alias("hunting_rule_title"),
        F.lit(cr.level).cast("string").alias("rule_level"),
        F.lit(cr.technique_id).cast("string").alias("mitre_technique_id"),
    )


def merge_same_meta(rules: list[CompiledRule]) -> list[CompiledRule]:
    """Rules with identical (id, title, level, technique) give identical
    findings: keep one per metadata with the OR of their predicates, so one
    log row yields each finding at most once."""
    merged: dict = {}
    for r in rules:
        if r.predicate is None:
            continue
        key = (r.rule_id, r.title, r.level, r.technique_id)
        if key in merged:
            first = merged[key]
            merged[key] = CompiledRule(first.index, *key[:2], first.level, first.technique_id,
                                       first.predicate | r.predicate)
        else:
            merged[key] = r
    return list(merged.values())


MASK_BITS = 62


def _raw_compiled_dedup(prepared: DataFrame, groups: list[CompiledRule], distinct: Callable[[DataFrame], DataFrame] = DataFrame.distinct) -> DataFrame:
    """Compiled hunt with the de-duplication on *matched log rows*.

    Duplicate findings can only come from identical log rows (rules with
    identical metadata are merged first). Each row gets one bitmask per 62
    rules, computed inside a one-row ``stack`` generator so every predicate
    is evaluated once (a filter on generator output cannot be pushed below
    it). Rows with any bit set are de-duplicated - at most one row per
    matching event is shuffled, instead of one per finding - and the set
    bits are then expanded into findings by a second ``stack``."""
    meta_cols = ["hunting_rule_id", "hunting_rule_title", "rule_level", "mitre_technique_id"]
    if not groups:
        return prepared.where(F.lit(False)).select(
            *LOG_COLUMNS, *[F.lit(None).cast("string").alias(c) for c in meta_cols]
        )
    chunks = [groups[i:i + MASK_BITS] for i in range(0, len(groups), MASK_BITS)]
    masks = []
    for chunk in chunks:
        m = F.lit(0).cast("long")
        for j, r in enumerate(chunk):
            m = m.bitwiseOR(F.when(r.predicate, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
        masks.append(m)
    names = [f"__m{i}" for i in range(len(masks))]
    any_bit = F.lit(False)
    for n in names:
        any_bit = any_bit | (F.col(n) != 0)
    matched = distinct(prepared.select(*LOG_COLUMNS, F.stack(F.lit(1), *masks).alias(*names)).where(any_bit))
    args = []
    for i, chunk in enumerate(chunks):
        for j, _ in enumerate(chunk):
            args += [(F.col(names[i]).bitwiseAND(F.lit(1 << j).cast("long"))) != 0, F.lit(i * MASK_BITS + j + 1)]
    meta = F.array(*[_meta_struct(r) for r in groups])
    return (
        matched.select(*LOG_COLUMNS, F.stack(F.lit(len(groups)), *args).alias("__hit", "__k"))
        .where(F.col("__hit"))
        .select(*LOG_COLUMNS, F.element_at(meta, F.col("__k")).alias("__meta"))
        .select(*LOG_COLUMNS, *[F.col(f"__meta.{c}").alias(c) for c in meta_cols])
    )


def _raw_compiled(prepared: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """One pass: a ``stack`` generator yields (matched, rule number) for every
    rule of every row, the matched pairs are kept and the rule's metadata is
    looked up in a literal array. ``stack`` stays in whole-stage codegen and,
    unlike ``explode``, gets no inferred pre-filter that Catalyst would push
    below the projection (which would evaluate every rule twice)."""
    active = [r for r in rules if r.predicate is not None]
    meta_cols = ["hunting_rule_id", "hunting_rule_title", "rule_level", "mitre_technique_id"]
    if not active:
        return prepared.where(F.lit(False)).select(
            *LOG_COLUMNS, *[F.lit(None).cast("string").alias(c) for c in meta_cols]
        )
    args = []
    for k, r in enumerate(active):
        args += [r.predicate, F.lit(k + 1)]
    meta = F.array(*[_meta_struct(r) for r in active])
    return (
        prepared.select(*LOG_COLUMNS, F.stack(F.lit(len(active)), *args).alias("__hit", "__k"))
        .where(F.col("__hit"))
        .select(*LOG_COLUMNS, F.element_at(meta, F.col("__k")).alias("__meta"))
        .select(*LOG_COLUMNS, *[F.col(f"__meta.{c}").alias(c) for c in meta_cols])
    )


# Rules that no literal can find are evaluated on every row, so many per scan.
RULES_PER_SCAN = 4 * MASK_BITS


COMPILED_RULES = 2 * MASK_BITS  # as many rules as two masks hold


def _enriched_index(prepared: DataFrame, rules: DataFrame, techniques: DataFrame | None, field_map: dict[str, str] | None, dedupe: bool) -> DataFrame:
    """Findings by the index; the technique columns are added to the rules, of
    which there are fewer than findings."""
    from ravenhunt.operators import ruleindex

    fmap = {k.lower(): v for k, v in (field_map or DEFAULT_FIELD_MAP).items()}

    def resolve(name: str) -> str | None:
        return _resolve_field(name, fmap)

    table = ruleindex.compiled(with_rule_attributes(rules), resolve)

    def enrich(rows: DataFrame) -> DataFrame:
        return enrich_technique(rows, techniques).select(*rows.columns, "mitre_technique_name", "mitre_technique_url", "risk_score")

    raw = ruleindex.matches(prepared, table, _lc, dedupe, enrich=enrich)
    if not table.filter(F.col("kind") == ruleindex.WIDE).isEmpty():  # rules of very many selections: one Column each
        wide = collect_rules(rules.filter(F.size("selections") > ruleindex.MAX_SELECTIONS))
        wide = [d for d in wide if (ruleindex.compile_rule(d, resolve) or [None])[0] == ruleindex.WIDE]
        for i in range(0, len(wide), RULES_PER_SCAN):
            rest = merge_same_meta(compile_rules(wide[i : i + RULES_PER_SCAN], field_map)) if dedupe else compile_rules(wide[i : i + RULES_PER_SCAN], field_map)
            raw = raw.unionByName(enrich((_raw_compiled_dedup if dedupe else _raw_compiled)(prepared, rest)).select(*raw.columns))
        raw = raw.distinct() if dedupe else raw
    return raw


def _raw_table(prepared: DataFrame, rule_rows: list[dict], field_map: dict[str, str] | None) -> DataFrame:
    from ravenhunt.operators import ruletable

    fmap = {k.lower(): v for k, v in (field_map or DEFAULT_FIELD_MAP).items()}
    parsed = ruletable.parse(rule_rows, lambda name: _resolve_field(name, fmap))
    columns = [*LOG_COLUMNS, "hunting_rule_id", "hunting_rule_title", "rule_level", "mitre_technique_id"]
    raw = ruletable.matches(prepared, parsed.indexed, _lc).select(*columns)
    for i in range(0, len(parsed.everywhere), RULES_PER_SCAN):
        rest = compile_rules([rule_rows[k] for k in parsed.everywhere[i : i + RULES_PER_SCAN]], field_map)
        raw = raw.unionByName(_raw_compiled_dedup(prepared, merge_same_meta(rest)).select(*columns))
    return raw


def rule_attributes(tags, level) -> tuple[str | None, str]:
    """Driver-side twin of ``technique_from_tags`` / ``rule_level`` for rules
    already collected (same fixed pattern and default)."""
    tid = None
    for tag in tags or []:
        m = re.search(TECHNIQUE_TAG_PATTERN, str(tag).lower())
        if m:
            tid = "T" + m.group(1)
            break
    lvl = DEFAULT_LEVEL if not level else str(level).lower()
    return tid, lvl


def collect_rules(rules: DataFrame) -> list[dict]:
    """The rule table on the driver (one job); technique id and level are
    derived here."""
    out = []
    for r in rules.collect():
        d = r.asDict(recursive=True)
        d["technique_id"], d["rule_level"] = rule_attributes(d.get("tags"), d.get("level"))
        out.append(d)
    return out


def hunt(
    logs: DataFrame,
    rules: DataFrame | list,
    techniques: DataFrame | None = None,
    strategy: str = "auto",
    compat_nulls: bool = False,
    field_map: dict[str, str] | None = None,
    dedupe: bool = True,
    distinct: Callable[[DataFrame], DataFrame] | None = None,
    event_id: str = "string",
) -> DataFrame:
    """Findings (FINDING_SCHEMA) of all rules over all log rows. ``distinct``
    drops equal matched log rows in place of ``DataFrame.distinct`` (streams;
    ``compiled`` only). ``event_id`` is the type it is given as: a caller who
    wants the number has it without two casts a finding."""
    if distinct is not None and (strategy != "compiled" or not dedupe):
        raise ValueError("distinct needs strategy='compiled' and dedupe")
    if strategy == "auto":
        known = collect_rules(rules.limit(COMPILED_RULES + 1)) if isinstance(rules, DataFrame) else rules
        strategy = "compiled" if len(known) <= COMPILED_RULES else "index"
        rules = known if strategy == "compiled" else rules
    prepared = prepare_logs(logs, compat_nulls)
    if strategy == "index":
        frame = rules if isinstance(rules, DataFrame) else logs.sparkSession.createDataFrame([{f: r.get(f) for f in RULE_SCHEMA.names} for r in rules], RULE_SCHEMA)
        enriched = _enriched_index(prepared, frame, techniques, field_map, dedupe)
    else:
        rule_rows = collect_rules(rules) if isinstance(rules, DataFrame) else rules
    if strategy == "table":
        raw = _raw_table(prepared, rule_rows, field_map)
    elif strategy == "compiled" and dedupe:
        raw = _raw_compiled_dedup(prepared, merge_same_meta(compile_rules(rule_rows, field_map)), distinct or DataFrame.distinct)
        dedupe = False
    elif strategy == "compiled":
        raw = _raw_compiled(prepared, compile_rules(rule_rows, field_map))
    elif strategy != "index":
        raise ValueError(f"unknown strategy {strategy!r}")
    if dedupe and strategy != "index":
        # Technique name/url/score are functions of the rule columns, so
        # de-duplicating before the join gives the same rows with a
        # narrower shuffle.
        raw = raw.distinct()
    if strategy != "index":
        enriched = enrich_technique(raw, techniques)
    findings = enriched.select(
        *[
            F.col(c).cast(event_id).alias(c) if c == "event_id" else F.col(c)
            for c in FINDING_COLUMNS
        ]
    )
    return findings


def rule_report(rules: DataFrame | list, field_map=None) -> list[dict]:
    """Which rules compile, and why the others never fire."""
    rule_rows = collect_rules(rules) if isinstance(rules, DataFrame) else rules
    return [
        {"id": r.rule_id, "title": r.title, "active": r.predicate is not None, "reason": r.reason}
        for r in compile_rules(rule_rows, field_map)
    ]
