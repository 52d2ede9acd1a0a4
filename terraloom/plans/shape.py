"""Output shaping shared by the queries: rounded doubles and dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.session import shared  # noqa: F401


def r(col: str | Column, digits: int = 4, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, digits)
    return out.alias(name or (col if isinstance(col, str) else "value"))


def s(col: str, name: str | None = None) -> Column:
    return F.col(col).cast("string").alias(name or col)


def i(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)
