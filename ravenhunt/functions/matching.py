"""Rule item predicates (F1-F5) over lower-cased text Columns.

The column passed in is already lower-cased (done once per row before all
rules); values are lower-cased here on the driver, once per rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN_OPS = ("contains", "startswith", "endswith", "equals")

_REGEX_META = set("\\^$.|?*+()[]{}-&~#!<>=:,'\"/@%`;")


def escape_regex_literal(text: str) -> str:
    """Escape ASCII punctuation so the text matches literally (Java and RE2)."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in text)


def wildcard_regex(pattern: str) -> str:
    """Inner ``*`` -> any run of characters except newline; rest literal.

    ``(?d)`` (UNIX_LINES) makes ``.`` exclude only ``\\n``, as in Python.
    """
    return "(?d)" + ".*".join(escape_regex_literal(p) for p in pattern.split("*"))


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def item_predicate(lowered: Column, op: str, values: list[str]) -> Column:
    """One detection item: OR over its values; unknown operator -> false."""
    vals = [str(v).lower() for v in values]
    if op == "contains":
        plain = [v for v in vals if "*" not in v]
        wild = [v for v in vals if "*" in v]
        preds = [lowered.contains(F.lit(v)) for v in plain]
        preds += [lowered.rlike(wildcard_regex(v)) for v in wild]
        return _any(preds)
    if op == "startswith":
        return _any([lowered.startswith(F.lit(v)) for v in vals])
    if op == "endswith":
        return _any([lowered.endswith(F.lit(v)) for v in vals])
    if op == "equals":
        if len(vals) == 1:
            return lowered == F.lit(vals[0])
        return lowered.isin(vals)
    return F.lit(False)


def match_contains(c: Column, values: list[str]) -> Column:
    return F.coalesce(item_predicate(F.lower(c), "contains", values), F.lit(False))


def match_startswith(c: Column, values: list[str]) -> Column:
    return F.coalesce(item_predicate(F.lower(c), "startswith", values), F.lit(False))


def match_endswith(c: Column, values: list[str]) -> Column:
    return F.coalesce(item_predicate(F.lower(c), "endswith", values), F.lit(False))


def match_equals(c: Column, values: list[str]) -> Column:
    return F.coalesce(item_predicate(F.lower(c), "equals", values), F.lit(False))
