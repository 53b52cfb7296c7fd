"""A rule condition -> one boolean Column.

The condition text is read with Python's own ``ast`` (mode ``eval``); only
``and``, ``or``, ``not``, parentheses and names are accepted. Each node folds
into a pair (value, error) so that an undefined selection name behaves like
the short-circuit evaluation of the original: ``A or missing`` is true when A
is, ``missing or A`` never fires. Result = value and not error.

Parts are Python bools where they are known on the driver, so a rule with no
undefined names compiles to plain AND/OR/NOT of its selection Columns.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = bool | Column


class UnsupportedCondition(ValueError):
    """Raised for syntax outside and/or/not/()/names (rule never fires)."""


def _and(a: Part, b: Part) -> Part:
    if a is False or b is False:
        return False
    if a is True:
        return b
    if b is True:
        return a
    return a & b


def _or(a: Part, b: Part) -> Part:
    if a is True or b is True:
        return True
    if a is False:
        return b
    if b is False:
        return a
    return a | b


def _not(a: Part) -> Part:
    if isinstance(a, bool):
        return not a
    return ~a


@dataclass
class Folded:
    value: Part
    error: Part


def parse_condition(text: str | None) -> ast.AST:
    if text is None or not str(text).strip():
        raise UnsupportedCondition("empty condition")
    try:
        tree = ast.parse(str(text).strip().lower(), mode="eval")
    except SyntaxError as exc:
        raise UnsupportedCondition(f"syntax: {exc.msg}") from None
    _check(tree.body)
    return tree.body


def _check(node: ast.AST) -> None:
    if isinstance(node, ast.BoolOp):
        for v in node.values:
            _check(v)
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        _check(node.operand)
    elif isinstance(node, ast.Name):
        return
    else:
        raise UnsupportedCondition(f"unsupported syntax: {type(node).__name__}")


def fold(node: ast.AST, selections: dict[str, Part]) -> Folded:
    """Fold a checked condition tree over {lower-case name: Column|bool}."""
    if isinstance(node, ast.Name):
        if node.id in selections:
            return Folded(selections[node.id], False)
        return Folded(False, True)
    if isinstance(node, ast.UnaryOp):
        inner = fold(node.operand, selections)
        return Folded(_not(inner.value), inner.error)
    if isinstance(node, ast.BoolOp):
        acc = fold(node.values[0], selections)
        for nxt in node.values[1:]:
            right = fold(nxt, selections)
            if isinstance(node.op, ast.And):
                error = _or(acc.error, _and(acc.value, right.error))
                value = _and(acc.value, right.value)
            else:
                error = _or(acc.error, _and(_not(acc.value), right.error))
                value = _or(acc.value, right.value)
            acc = Folded(value, error)
        return acc
    raise UnsupportedCondition(type(node).__name__)  # pragma: no cover


def condition_column(text: str | None, selections: dict[str, Part]) -> Column:
    """Compile a condition; raises UnsupportedCondition for other syntax."""
    tree = parse_condition(text)
    folded = fold(tree, {k.lower(): v for k, v in selections.items()})
    result = _and(folded.value, _not(folded.error))
    return F.lit(result) if isinstance(result, bool) else result


def evaluate_python(text: str, truth: dict[str, bool]) -> bool:
    """Plain-Python evaluator with the same semantics, used by tests."""

    def ev(node):
        if isinstance(node, ast.Name):
            if node.id not in truth:
                raise NameError(node.id)
            return truth[node.id]
        if isinstance(node, ast.UnaryOp):
            return not ev(node.operand)
        if isinstance(node, ast.BoolOp):
            if isinstance(node.op, ast.And):
                for v in node.values:
                    if not ev(v):
                        return False
                return True
            for v in node.values:
                if ev(v):
                    return True
            return False
        raise UnsupportedCondition(type(node).__name__)

    try:
        return bool(ev(parse_condition(text)))
    except (NameError, UnsupportedCondition):
        return False
