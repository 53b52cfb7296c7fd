"""The hunt's rules as an index: J1, F1 and F2 for any number of rules.

*Compiled on the executors.* ``compiled`` turns the rule table into a table of
rules as data (``mapInArrow``): selections with lower-cased values, the truth
table of the condition, and which selections every match must hold one of. It is
written to the shared folder; no rule passes the driver for it.

*Searched in one pass.* The values of all items of all rules are literals of one
Aho-Corasick automaton a field. A log value is searched as ``START value END``,
so that ``equals``, ``startswith`` and ``endswith`` are literals with one or both
marks; ``contains`` with an inner ``*`` goes by its longest part and is confirmed
by its pattern. Each distinct value of an Arrow batch is searched once. The hits
give which items hold in which row; a rule is looked at only in rows where one
of the items it cannot do without holds (of those it may go by, the one that the
fewest rules use), and its selections and truth table are then evaluated for all
such (row, rule) pairs of a step at once. Rules without such an item, as
``not a``, are evaluated in every row, the same way.

*Bounded.* What is broadcast is a block of at most ``BLOCK`` bytes of compiled
rules; beyond it the rules are dealt into blocks by their metadata, and each
block passes over the log rows once. Duplicate log rows are dropped once they
are known to match, before they are multiplied by their rules.
"""

from __future__ import annotations

import ast
import contextlib
import functools
import gc
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.operators.conditions import UnsupportedCondition, evaluate_python, parse_condition
from ravenhunt.operators.ruletable import MAX_SELECTIONS, items_of
from ravenhunt.schemas import LOG_COLUMNS
from ravenhunt.session import scratch_table

BLOCK = 48 << 20
STEP = 1 << 21  # (row, rule) pairs that a step works on at once (more for one row that has more)
PIECE = 256  # rules of a class that are joined to a row at once
FEW = 4  # so many pieces of rules are broadcast
DEALT = 4  # times spark.sql.shuffle.partitions: so many tasks unfold the findings, which are many more than what is shuffled
OPTIONS = 8  # ways a rule may be found that are compared
START, END = "\x02", "\x03"
META = ["hunting_rule_id", "hunting_rule_title", "rule_level", "mitre_technique_id"]
INDEXED, WIDE = "indexed", "wide"
ITEM = "struct<field: int, op: string, values: array<string>>"
COMPILED = f"hunting_rule_id string, hunting_rule_title string, rule_level string, mitre_technique_id string, kind string, form string, truth string, selections array<array<{ITEM}>>, options array<array<int>>"


def covers(node: ast.AST, known: dict[str, list | None]) -> list[frozenset[str]]:
    """Sets of selections of which every match of the condition holds one (at
    most ``OPTIONS`` of them; none: there is no such set)."""
    if isinstance(node, ast.Name):
        items = known.get(node.id)
        return [frozenset()] if items is None else [frozenset([node.id])] if items else []
    if isinstance(node, ast.BoolOp):
        parts = [covers(v, known) for v in node.values]
        if isinstance(node.op, ast.And):
            found = [c for p in parts for c in p]
        else:
            found = [] if [] in parts else [frozenset().union(*c) for c in itertools.islice(itertools.product(*parts), OPTIONS)]
        return sorted(set(found), key=lambda c: (len(c), sorted(c)))[:OPTIONS]
    return []


def compile_rule(d: dict, resolve: Callable[[str], str | None]) -> tuple[str, str, list, list] | None:
    """(kind, truth table, selections, options) of a rule; None: it never fires."""
    if d.get("error"):
        return None
    known = {s["name"].lower(): items_of(s["items"], resolve) for s in d.get("selections") or []}
    shape = condition_shape(d.get("condition"), tuple((n, None if items is None else bool(items)) for n, items in known.items()))
    if shape is None:
        return None
    kind, truth, names, options = shape
    selections = [[(LOG_COLUMNS.index(f), op, values) for f, op, values in known[n]] if known[n] is not None else [(-1, "never", [])] for n in names]
    return kind, truth, selections, [list(o) for o in options]


@functools.lru_cache(4096)
def condition_shape(condition: str | None, states: tuple[tuple[str, bool | None], ...]) -> tuple[str, str, list, list] | None:
    """(kind, truth table, names, options) of a condition over selections that
    have items (True), none (False) or never hold (None); None: it never fires."""
    try:
        tree = parse_condition(condition)
    except UnsupportedCondition:
        return None
    known = {n: None if state is None else [n] * state for n, state in states}
    names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} & known.keys())
    if len(names) > MAX_SELECTIONS:
        return WIDE, "", [], []
    truth = "".join("01"[evaluate_python(condition, dict(zip(names, bits, strict=True)))] for bits in itertools.product((False, True), repeat=len(names)))
    options = covers(tree, known)
    if "1" not in truth or frozenset() in options:
        return None
    return INDEXED, truth, names, [[names.index(n) for n in sorted(c)] for c in options]


def listed(column: pa.Array) -> list:
    """``column.to_pylist()``, nested types by their flat values (several times faster)."""
    if pa.types.is_list(column.type):
        ends = list(itertools.accumulate(pc.fill_null(pc.list_value_length(column), 0).to_pylist()))
        flat = listed(pc.list_flatten(column))
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    elif pa.types.is_struct(column.type):
        names = column.type.names
        out = [dict(zip(names, v, strict=True)) for v in zip(*map(listed, column.flatten()), strict=True)]
    else:
        return column.to_pylist()
    return out if not column.null_count else [v if ok else None for v, ok in zip(out, column.is_valid().to_pylist(), strict=True)]


def lists_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many elements each list has, and all of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without looks for garbage among very many new objects, most of which stay."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.enable() if on else None


def compiled(rules: DataFrame, resolve: Callable[[str], str | None]) -> DataFrame:
    """The rules that can fire, as data, with a number each (``rule``) and a
    digest of all that decides where they fire (``form``)."""
    optional = [c for c in ("error",) if c in rules.columns]
    rows = rules.select("id", "title", "rule_level", "technique_id", "selections", "condition", *optional)
    rows = rows.repartition(rules.sparkSession.sparkContext.defaultParallelism)  # a small file of many rules is one task otherwise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(4096)(resolve)
        for batch in batches:
            out = []
            with uncollected():
                for d in listed(batch.to_struct_array()):
                    made = compile_rule(d, known)
                    if made:
                        kind, truth, selections, options = made
                        form = hashlib.blake2b(repr(made).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                        out.append((d["id"], d["title"], d["rule_level"], d["technique_id"], kind, form, truth,
                                    [[{"field": f, "op": op, "values": values} for f, op, values in s] for s in selections], options))
                columns = list(zip(*out, strict=True)) if out else [()] * len(_COMPILED_ARROW)
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COMPILED_ARROW.values(), strict=True)], names=list(_COMPILED_ARROW))
            yield made

    return scratch_table(rows.mapInArrow(run, COMPILED).withColumn("rule", F.monotonically_increasing_id()), "compiled-rules")


_ARROW_ITEM = pa.struct([("field", pa.int32()), ("op", pa.string()), ("values", pa.list_(pa.string()))])
_COMPILED_ARROW = {**dict.fromkeys(META, pa.string()), "kind": pa.string(), "form": pa.string(), "truth": pa.string(),
                   "selections": pa.list_(pa.list_(_ARROW_ITEM)), "options": pa.list_(pa.list_(pa.int32()))}


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Lists:
    """Lists of whole numbers, end to end: how many each has, and all of them."""

    def __init__(self, n: np.ndarray, flat: np.ndarray):
        self.n, self.flat = n.astype(np.int64), flat.astype(np.int64)
        self.start = np.cumsum(self.n) - self.n

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``which``, number) of the lists asked for."""
        n = self.n[which]
        return np.repeat(np.arange(len(which)), n), self.flat[spread(self.start[which], n)]


NEVER, ALWAYS = 0, 1


class RuleIndex:
    """A block of compiled rules, ready to be evaluated on Arrow batches; rules
    may share a number, that of their class."""

    def __init__(self, rules: pa.Table):
        rules = rules.combine_chunks()
        self.number = rules["number"].to_numpy()
        self.numbers, at = np.unique(self.number, return_index=True)
        self.n_pieces = rules["pieces"].to_numpy().astype(np.int32)[at]
        n_sets, sets = lists_of(rules["selections"])
        n_listed, listed_items = lists_of(sets)
        numbers: dict[tuple, int] = {}
        parts = [listed(pc.struct_field(listed_items, f)) for f in ("field", "op", "values")]
        of_item = [NEVER if op == "never" else numbers.setdefault((field, op, tuple(values)), len(numbers) + 2) for field, op, values in zip(*parts, strict=True)]
        self.items = len(numbers) + 2
        n_items = np.maximum(n_listed, 1)  # a selection without items always holds
        items = np.full(n_items.sum(), ALWAYS, np.int64)
        items[np.repeat(n_listed > 0, n_items)] = of_item
        rule_of_set, set_of_item = np.repeat(np.arange(len(n_sets)), n_sets), np.repeat(np.arange(len(n_items)), n_items)
        rule_of_item = rule_of_set[set_of_item]
        self.rule_items = Lists(np.bincount(rule_of_set, n_items, len(n_sets)), items)
        begins = np.r_[True, set_of_item[1:] != set_of_item[:-1]] if len(items) else np.empty(0, bool)
        self.begins = Lists(self.rule_items.n, begins)  # does a selection begin here?
        self.rule_sets = Lists(n_sets, 1 << (spread(np.zeros(len(n_sets), np.int64), n_sets[::-1])[::-1]))
        truth = rules["truth"].to_pylist()
        self.truth = Lists(np.array([len(t) for t in truth], np.int64), np.frombuffer("".join(truth).encode(), np.uint8) - ord("0"))
        # of a rule's options the one that the fewest rules use, of each of its selections the item that the fewest use
        uses = np.bincount(np.unique(rule_of_item * self.items + items) % self.items, minlength=self.items)
        rank = uses[items] * self.items + items
        best = np.minimum.reduceat(rank, np.flatnonzero(begins)) % self.items if len(items) else items
        n_options, options = lists_of(rules["options"])
        n_asked, asked = lists_of(options)
        rule_of_option, option = np.repeat(np.arange(len(n_options)), n_options), np.repeat(np.arange(len(n_asked)), n_asked)
        asked = best[(np.cumsum(n_sets) - n_sets)[rule_of_option][option] + asked.to_numpy()]
        order = np.lexsort((np.bincount(option, uses[asked], len(n_asked)), rule_of_option))
        found, first = np.unique(rule_of_option[order], return_index=True)
        chosen = np.zeros(len(n_asked), bool)
        chosen[order[first]] = True
        item, rule = np.divmod(np.unique(asked[chosen[option]] * len(self.number) + rule_of_option[option][chosen[option]]), max(1, len(self.number)))
        self.everywhere = np.setdiff1d(np.arange(len(self.number)), found)
        self.several = len(np.unique(rule)) < len(rule)
        self.by_item = Lists(np.bincount(item, minlength=self.items), rule)
        self.search = {LOG_COLUMNS[f]: Literals({k: i for k, i in numbers.items() if k[0] == f}) for f in sorted({k[0] for k in numbers})}

    def pieces(self, number: np.ndarray) -> np.ndarray:
        return self.n_pieces[np.searchsorted(self.numbers, number)]

    def holding(self, batch: pa.RecordBatch, lowered: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) where an item holds."""
        rows, items = [], []
        for name, literals in self.search.items():
            coded = batch.column(lowered(name)).dictionary_encode()
            which = np.flatnonzero(pc.is_valid(coded).to_numpy(zero_copy_only=False))
            code = pc.fill_null(coded.indices, 0).to_numpy()[which]
            held = [literals.of(v) for v in coded.dictionary.to_pylist()]
            place, held = Lists(np.array([len(x) for x in held], np.int64), np.array([i for x in held for i in x], np.int64)).of(code)
            rows.append(which[place])
            items.append(held)
        return np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*items, np.empty(0, np.int64)]).astype(np.int64)

    def matches(self, batch: pa.RecordBatch, lowered: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, rule's number) of all matches, by row."""
        row, item = self.holding(batch, lowered)
        order = np.argsort(row, kind="stable")
        row, item = row[order], item[order]
        per_row = np.bincount(row, self.by_item.n[item], batch.num_rows).astype(np.int64) if len(row) else np.zeros(batch.num_rows, np.int64)
        pairs = np.cumsum(per_row + 1 + len(self.everywhere))
        out, lo = [], 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + STEP, "right")))
            a, b = np.searchsorted(row, [lo, hi])
            out.append(self.step(lo, hi, row[a:b], item[a:b]))
            lo = hi
        return tuple(np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(2))

    def step(self, lo: int, hi: int, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.sort((row - lo) * self.items + item)
        place, rule = self.by_item.of(item)
        at = row[place] - lo
        rule = np.r_[rule, np.tile(self.everywhere, hi - lo)]
        at = np.r_[at, np.repeat(np.arange(hi - lo), len(self.everywhere))]
        if self.several:  # a rule found by several of its items
            at, rule = np.divmod(np.unique(at * len(self.number) + rule), len(self.number))
        pair, needed = self.rule_items.of(rule)
        if not len(pair):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        asked = at[pair] * self.items + needed
        true = needed == ALWAYS
        if len(held):
            true |= held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
        begins = self.begins.of(rule)[1].astype(bool)
        true = np.logical_and.reduceat(true, np.flatnonzero(begins))
        owner, weight = self.rule_sets.of(rule)
        code = np.bincount(owner, true * weight, len(rule)).astype(np.int64)
        fires = self.truth.flat[self.truth.start[rule] + code] == 1
        return at[fires] + lo, self.number[rule[fires]]


class Literals:
    """The items of one field; which of them hold in a value."""

    def __init__(self, items: dict[tuple, int]):
        import ahocorasick

        found: dict[str, dict[tuple[bool, bool], tuple[list, list]]] = {}  # literal -> marked (at its start, end) -> items
        for (_, op, values), number in items.items():
            for v in values:
                wild = op == "contains" and "*" in v
                part = max(v.split("*"), key=len) if wild else v
                marks = op in ("startswith", "equals") or (op == "contains" and not part), op in ("endswith", "equals")
                sure, maybe = found.setdefault(START * marks[0] + part + END * marks[1], {}).setdefault(marks, ([], []))
                if wild:  # found by a part, confirmed by the pattern
                    maybe.append((number, ".*".join(map(re.escape, v.split("*")))))
                else:
                    sure.append(number)
        self.automaton = ahocorasick.Automaton()
        for literal, kinds in sorted(found.items()):
            self.automaton.add_word(literal, (len(literal), [(*marks, sure, maybe) for marks, (sure, maybe) in kinds.items()]))
        self.automaton.make_automaton()

    def of(self, value: str | None) -> list[int]:
        if value is None:
            return []
        out, last = set(), len(value) + 1
        for end, (size, kinds) in self.automaton.iter(f"{START}{value}{END}"):
            for at_start, at_end, sure, maybe in kinds:  # a mark counts only at its place: values may hold marks of their own
                if at_start == (end + 1 == size) and at_end == (end == last):
                    out.update(sure)
                    out.update(n for n, pattern in maybe if n not in out and re.search(pattern, value))
        return sorted(out)


_BUILT: dict = {}  # the worker's last index, by broadcast


def block_matches(prepared: DataFrame, rules: DataFrame, lowered: Callable[[str], str], dedupe: bool) -> DataFrame:
    """The matched log rows of one block of compiled rules, with ``classes``, the numbers and pieces of their rules' classes."""
    spark = prepared.sparkSession
    table = rules.select("number", "pieces", "truth", "selections", "options").orderBy("number", "form").toArrow()  # at most about BLOCK bytes
    used = {LOG_COLUMNS[f] for f in pc.unique(pc.struct_field(pc.list_flatten(pc.list_flatten(table.column("selections"))), "field")).to_pylist() if f is not None and f >= 0}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    key = (spark.sparkContext.applicationId, table.num_rows, id(shared), dedupe)
    rows = prepared.select(*LOG_COLUMNS, *[lowered(c) for c in LOG_COLUMNS if c in used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _BUILT.get(key)
        if index is None:
            _BUILT.clear()
            with uncollected():
                index = _BUILT[key] = RuleIndex(pa.ipc.open_stream(shared.value).read_all())
        for batch in batches:
            row, number = index.matches(batch, lowered)
            if dedupe:  # several rules of a class
                pairs = np.unique(np.stack([row, number], axis=1), axis=0)
                row, number = pairs[:, 0], pairs[:, 1]
            else:
                order = np.lexsort((number, row))
                row, number = row[order], number[order]
            held, at = np.unique(row, return_index=True)
            classes = pa.StructArray.from_arrays([pa.array(number), pa.array(index.pieces(number))], ["number", "pieces"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)].astype(np.int32)), classes)
            kept = batch.select(LOG_COLUMNS).take(pa.array(held))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*LOG_COLUMNS, "classes"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.select(*LOG_COLUMNS).schema)
    found = rows.mapInArrow(run, f"{types}, classes array<struct<number: long, pieces: int>>")
    return found.distinct() if dedupe else found


def rule_classes(table: DataFrame, dedupe: bool, enrich: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(what to evaluate for each class: number, pieces, truth, selections, options;
    the rules of each class: number, piece, rules).

    The form of a rule is all that decides where it fires. Rules of equal
    metadata give one finding a row (``dedupe``), so they are one rule of several forms."""
    rules = table.filter(F.col("kind") == INDEXED)
    members = rules.select(*META, "rule", F.col("form").alias("forms"))
    if dedupe:
        members = rules.groupBy(*META).agg(F.min("rule").alias("rule"), F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"))
    members = scratch_table(members, "rule-members")
    groups = members.groupBy("forms").agg(F.min("rule").alias("number"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    groups = scratch_table(groups, "rule-classes")
    forms = rules.groupBy("form").agg(*[F.first(c).alias(c) for c in ("truth", "selections", "options")])
    index = scratch_table(groups.select("number", "pieces", F.explode(F.split("forms", ",")).alias("form")).join(forms, "form"), "rule-forms")
    told = enrich(members.join(groups, "forms"))
    meta = F.struct(*[c for c in told.columns if c not in ("rule", "forms", "number", "pieces")])
    piece = F.pmod(F.xxhash64("rule"), F.col("pieces")).cast("int")
    return index, scratch_table(told.groupBy("number", piece.alias("piece")).agg(F.collect_list(meta).alias("rules")), "rule-pieces")


def matches(prepared: DataFrame, table: DataFrame, lowered: Callable[[str], str], dedupe: bool, block: int = BLOCK, *,
            enrich: Callable[[DataFrame], DataFrame] = lambda rules: rules) -> DataFrame:
    """(log row, rule) pairs that match, with the rules' four columns and those
    that ``enrich`` adds to a table of rules, for the ``INDEXED`` rules of ``compiled``."""
    few = table.limit(FEW * PIECE + 1).count() <= FEW * PIECE  # no more rules than that: they are broadcast
    index, pieces = rule_classes(table, dedupe, (lambda rules: rules) if few else enrich)
    text = F.octet_length(F.to_json(F.struct("truth", "selections", "options")))
    n, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    blocks = max(1, min(n, -(-size // block)))
    out = None
    for b in range(blocks):
        part = index if blocks == 1 else index.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)
        found = block_matches(prepared, part, lowered, dedupe)
        out = found if out is None else out.unionByName(found)
    of_class = out.select(*LOG_COLUMNS, F.explode("classes").alias("_class"))
    pairs = of_class.select(*LOG_COLUMNS, F.col("_class.number").alias("number"), F.explode(F.sequence(F.lit(0), F.col("_class.pieces") - 1)).alias("piece"))
    if few:
        return enrich(pairs.join(F.broadcast(pieces), ["number", "piece"]).select(*LOG_COLUMNS, F.inline("rules")))
    # a number of partitions of their own: by the bytes of the pairs, which say nothing of the findings, they would be put together
    partitions = DEALT * int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.repartition(partitions, "number", "piece").join(pieces, ["number", "piece"])
    return joined.select(*LOG_COLUMNS, F.inline("rules"))
