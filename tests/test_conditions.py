"""Condition folding equals Python's own evaluation (names replaced by
True/False, undefined name -> error -> no match)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ravenhunt.operators.conditions import UnsupportedCondition, condition_column, evaluate_python, parse_condition

NAMES = ["a", "b", "c"]


def python_eval(cond: str, truth: dict) -> bool:
    text = cond.lower()
    for name, val in truth.items():
        text = re.sub(r"\b" + re.escape(name) + r"\b", str(val), text)
    try:
        return bool(eval(text, {"__builtins__": {}}, {}))  # noqa: S307 - test oracle on our own strings
    except Exception:  # noqa: BLE001
        return False


def random_condition(rng: random.Random, depth: int = 0) -> str:
    if depth > 2 or rng.random() < 0.3:
        return rng.choice(NAMES + ["missing"])
    kind = rng.choice(["and", "or", "not", "paren"])
    if kind == "not":
        return "not " + random_condition(rng, depth + 1)
    if kind == "paren":
        return "(" + random_condition(rng, depth + 1) + ")"
    return f"{random_condition(rng, depth + 1)} {kind} {random_condition(rng, depth + 1)}"


def test_random_conditions_match_python(spark):
    rng = random.Random(7)
    conds = [random_condition(rng) for _ in range(40)]
    rows = [(x & 4 > 0, x & 2 > 0, x & 1 > 0) for x in range(8)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    sels = {n: F.col(n) for n in NAMES}
    cols = [condition_column(c, sels).alias(f"c{i}") for i, c in enumerate(conds)]
    got = df.select("a", "b", "c", *cols).collect()
    checked = 0
    for r in got:
        truth = {"a": r.a, "b": r.b, "c": r.c}
        for i, c in enumerate(conds):
            assert r[f"c{i}"] == python_eval(c, truth), (c, truth)
            assert evaluate_python(c, truth) == python_eval(c, truth)
            checked += 1
    assert checked == 320


@pytest.mark.parametrize(
    "cond,expected",
    [
        ("a or missing", True),
        ("missing or a", False),
        ("a and missing", False),
        ("not missing", False),
        ("A", True),  # upper-case name matches (R3)
    ],
)
def test_short_circuit_and_case(spark, cond, expected):
    df = spark.createDataFrame([(True,)], "a boolean")
    assert df.select(condition_column(cond, {"a": F.col("a")}).alias("m")).first().m is expected


@pytest.mark.parametrize("cond", ["1 of selection*", "all of them", "selection | count() > 5", "a ==", ""])
def test_unsupported_syntax_is_rejected(cond):
    with pytest.raises(UnsupportedCondition):
        parse_condition(cond)
