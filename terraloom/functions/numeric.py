"""Null-safe arithmetic used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would turn it into a bound)."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def finite(x: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def sentinel_to_null(x: Column, floor: float = -900.0) -> Column:
    """Missing-value sentinels (such as -999) and NaN become NULL."""
    return F.when((x > F.lit(floor)) & ~F.isnan(x), x)


def flag_pct(mask: Column, digits: int | None = None) -> Column:
    """Share of rows (in %) on which ``mask`` holds; an aggregate. With ``digits`` it is
    rounded half-even, as published percentages are."""
    p = F.lit(100.0) * F.count_if(mask) / F.count(F.lit(1))
    return p if digits is None else F.bround(p, digits)


def skill_pct(rmse: Column, base: Column) -> Column:
    """(1 - rmse / base) * 100, NULL for a zero base."""
    return (F.lit(1.0) - F.try_divide(rmse, base)) * F.lit(100.0)


def bands(x: Column, steps: list[tuple[str, float, str]], last: str) -> Column:
    """First label whose comparison holds, in order; NULL input gives NULL."""
    out = None
    for op, bound, label in steps:
        cond = {"<": x < bound, "<=": x <= bound, ">=": x >= bound, ">": x > bound}[op]
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(x.isNotNull(), out.otherwise(last))
