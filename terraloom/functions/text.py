"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def id_prefix(ident: Column) -> Column:
    """Source part of a dataset id."""
    return F.element_at(F.split(ident, "_"), 1)


def period_end(period: Column) -> Column:
    """End of a ``start-end`` period written with an en dash, as yyyy-MM-dd when it is a
    compact day."""
    end = F.element_at(F.split(period, "–"), -1)
    day = F.try_to_date(end, "yyyyMMdd")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), end)


def squeezed(text: Column) -> Column:
    """Trimmed text with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def valid_id(ident: Column) -> Column:
    return ident.rlike("^[a-z0-9_]+$")


def file_stem(name: Column, width: int = 80) -> Column:
    """File name without its extension, cut to a display width."""
    return F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, width)


def merged_counts(a: Column, b: Column) -> Column:
    """Sum of two count maps over the union of their keys."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
