"""Date and season expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mid-month day numbers of the periodic monthly climatology.
MONTH_MIDPOINTS = [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5]


def capped_doy(d: Column) -> Column:
    """Day of year with leap 31 December folded into 365."""
    return F.least(F.dayofyear(d), F.lit(365))


def harmonics(doy: Column) -> dict[str, Column]:
    """First and second seasonal harmonics."""
    a = doy * F.lit(2 * math.pi / 365.25)
    return {
        "sin1": F.sin(a),
        "cos1": F.cos(a),
        "sin2": F.sin(a * 2),
        "cos2": F.cos(a * 2),
    }


def from_yyyymmdd(s: Column) -> Column:
    return F.try_to_date(s, "yyyyMMdd")


def to_yyyymmdd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def day_label(d: Column) -> Column:
    return F.date_format(d, "dd MMM")


def week_label(d: Column) -> Column:
    return F.concat(F.lit("W"), F.weekofyear(d).cast("string"))


def parse_utc(s: Column) -> Column:
    """ISO text with ``Z``, with an offset or without a zone (read as UTC), or the
    stored ``... UTC`` form; the session zone must be UTC."""
    t = F.regexp_replace(F.trim(s), " UTC$", "")
    return F.try_to_timestamp(t)


def dataset_id(source: Column, var: Column, region: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", source, var, region, start, end)


def refresh_window(today: Column, latency: int = 3, days: int = 30) -> tuple[Column, Column]:
    """Start and end of the trailing window a refresh pulls."""
    end = F.date_sub(today, latency)
    return F.date_sub(end, days), end


def year_fraction(year: Column, first: Column, last: Column) -> Column:
    return (year - first) / (last - first + F.lit(1e-9))


def interp_log_decay(lead: Column, fitted: Column) -> Column:
    """Log-linear interpolation of a decay factor between its fitted leads.

    ``fitted`` is an array of ``struct(lead, phi)`` sorted by lead; outside the fitted
    leads the end value holds.
    """
    x = lead.cast("double")
    below = F.filter(fitted, lambda s: s["lead"] <= lead)
    above = F.filter(fitted, lambda s: s["lead"] >= lead)
    lo = F.coalesce(F.try_element_at(below, F.lit(-1)), F.try_element_at(fitted, F.lit(1)))
    hi = F.coalesce(F.try_element_at(above, F.lit(1)), F.try_element_at(fitted, F.lit(-1)))

    def ln(s: Column) -> Column:
        return F.log(F.greatest(F.lit(1e-4), F.least(F.lit(1.0), s["phi"])))

    span = (hi["lead"] - lo["lead"]).cast("double")
    t = F.coalesce(F.try_divide(x - lo["lead"], span), F.lit(0.0))
    return F.exp(ln(lo) * (1 - t) + ln(hi) * t)


def month_brackets(doy: Column) -> tuple[Column, Column, Column]:
    """(lower month, upper month, weight of the upper) of the periodic interpolation
    between mid-month points for a day of year 1..366."""
    mids = [MONTH_MIDPOINTS[-1] - 365.0, *MONTH_MIDPOINTS, MONTH_MIDPOINTS[0] + 365.0]
    j = F.lit(1)
    for k in range(2, len(mids)):
        j = F.when(doy >= F.lit(mids[k - 1]), F.lit(k)).otherwise(j)
    edges = F.array(*[F.lit(m) for m in mids])
    lower_edge, upper_edge = F.element_at(edges, j), F.element_at(edges, j + 1)
    weight = (doy - lower_edge) / (upper_edge - lower_edge)
    months = F.array(*[F.lit(m) for m in [12, *range(1, 13), 1]])
    return F.element_at(months, j), F.element_at(months, j + 1), weight


def daily_normals(clim: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Monthly normals (months 1..12) per key to daily normals by periodic interpolation.

    The twelve months of a key become one map, so the 366 days need no join.
    """
    by_month = (
        clim.filter(F.col("month").between(1, 12))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("month").cast("int"), F.col(value)))).alias("_m"))
    )
    days = by_month.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    lo, hi, w = month_brackets(F.col("doy"))
    return days.select(
        *keys,
        "doy",
        ((1 - w) * F.try_element_at("_m", lo) + w * F.try_element_at("_m", hi)).alias("normal"),
    )
