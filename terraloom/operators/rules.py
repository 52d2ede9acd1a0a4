"""Threshold rules over pixel evidence, kept as tables.

A rule is a list of tests ``(evidence, operator, value)`` that must all hold. Evidence is a dictionary
of columns, so the same tables serve stored columns and expressions. First-match tables give
the outcome of the first rule that holds.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = tuple[str, str, float]
OPS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def holds(evidence: dict, tests: list[Test]):
    """Evidence is columns, or arrays of equal shape; the result is of the same kind."""
    own = lambda name, value: F.lit(value) if isinstance(evidence[name], Column) else value
    return reduce(operator.and_, (OPS[op](evidence[name], own(name, value)) for name, op, value in tests))


def any_holds(evidence: dict, rules: list[list[Test]]):
    return reduce(operator.or_, (holds(evidence, r) for r in rules))


def first_match(evidence: dict[str, Column], table: list[tuple[str, list[Test]]], otherwise: str) -> Column:
    """Outcome of the first rule that holds."""
    pick = F.lit(otherwise)
    for outcome, tests in reversed(table):
        pick = F.when(holds(evidence, tests), F.lit(outcome)).otherwise(pick)
    return pick


def colour_evidence(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Channels, their differences, and lightness and saturation measures."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return {
        "r": r, "g": g, "b": b, "r-g": r - g, "r-b": r - b, "g-b": g - b, "g-r": g - r, "b-r": b - r, "b-g": b - g, "|r-g|": F.abs(r - g), "|r-b|": F.abs(r - b),
        "max": top, "min rg - b": F.least(r, g) - b, "b - min rg": b - F.least(r, g), "hsv sat": F.when(top == 0, F.lit(0.0)).otherwise((top - low) / F.nullif(top, F.lit(0.0))),
    }
