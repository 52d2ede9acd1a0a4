"""Day-of-year and monthly climatologies, anomalies, annual means and trends.

A station series holds one row per day, so windows over a station are bounded by the
calendar; everything larger is pre-aggregated by the adapters before it gets here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.calendar import capped_doy

HALF_WINDOW = 3  # fixed value: days on either side of the smoothed day-of-year normal


def with_calendar(obs: DataFrame, date_col: str = "obs_date") -> DataFrame:
    d = F.col(date_col)
    return obs.withColumns({"doy": capped_doy(d), "year": F.year(d), "month": F.month(d)})


def doy_climatology(
    obs: DataFrame,
    values: list[str],
    keys: list[str] | None = None,
    half_window: int = HALF_WINDOW,
    date_col: str = "obs_date",
) -> DataFrame:
    """Mean and population standard deviation per day of year over a circular window.

    Moments are first reduced per day of year; only those (at most 365 per key) are
    spread to the neighbouring days, so the raw rows are shuffled once and never copied.
    """
    keys = keys or ["station"]
    doy = capped_doy(F.col(date_col))
    aggs: list[Column] = []
    for v in values:
        aggs += [
            F.count(v).alias(f"_n_{v}"),
            F.avg(v).alias(f"_m_{v}"),
            (F.var_pop(v) * F.count(v)).alias(f"_q_{v}"),
        ]
    per_day = obs.groupBy(*keys, doy.alias("_d")).agg(*aggs)
    spread = per_day.withColumn("_off", F.explode(F.sequence(F.lit(-half_window), F.lit(half_window)))).withColumn(
        "doy", (F.pmod(F.col("_d") - 1 + F.col("_off"), F.lit(365)) + 1).cast("int")
    )
    merged: list[Column] = []
    for v in values:
        n, m, q = F.col(f"_n_{v}"), F.col(f"_m_{v}"), F.col(f"_q_{v}")
        total = F.sum(n)
        mean = F.try_divide(F.sum(n * m), total)
        var = F.try_divide(F.sum(q) + F.sum(n * m * m), total) - mean * mean
        merged += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"{v}_std")]
    return spread.groupBy(*keys, "doy").agg(*merged)


def with_normals(obs: DataFrame, clim: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Observation joined to the normals of its day of year. The normals are far smaller
    than the record; whether they are broadcast is left to their measured size."""
    keys = keys or ["station"]
    base = obs if "doy" in obs.columns else with_calendar(obs)
    return base.join(clim, [*keys, "doy"], "left")


def daily_anomaly(obs: DataFrame, clim: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    joined = with_normals(obs, clim, keys)
    return joined.withColumns({f"{v}_anom": F.col(v) - F.col(f"{v}_mean") for v in values})


def standardised_anomaly(obs: DataFrame, clim: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """z = (obs - normal) / (standard deviation of all anomalies + 1e-6)."""
    keys = keys or ["station"]
    anom = daily_anomaly(obs, clim, [value], keys)
    scale = anom.groupBy(*keys).agg((F.stddev_pop(f"{value}_anom") + 1e-6).alias("anom_sd"))
    return anom.join(scale, keys).withColumn("z", F.col(f"{value}_anom") / F.col("anom_sd"))


def annual_mean(obs: DataFrame, value: str = "tmean", keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["station"]
    return obs.groupBy(*keys, F.year("obs_date").alias("year")).agg(
        F.avg(value).alias("annual_mean"), F.count(F.lit(1)).alias("n_days")
    )


def linear_trend(annual: DataFrame, keys: list[str] | None = None, min_days: int | None = 330) -> DataFrame:
    """Least-squares trend per key; with ``min_days`` only full years enter the fit."""
    keys = keys or ["station"]
    fit = annual if min_days is None else annual.filter(F.col("n_days") >= min_days)
    return fit.groupBy(*keys).agg(
        F.regr_slope("annual_mean", "year").alias("slope"),
        F.regr_intercept("annual_mean", "year").alias("intercept"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("n_years"),
    )


def leak_free_trend(obs: DataFrame, split: DataFrame, value: str = "tmean", keys: list[str] | None = None) -> DataFrame:
    """Trend over the years up to ``split_year`` only, with the mean year of those rows."""
    keys = keys or ["station"]
    past = obs.withColumn("year", F.year("obs_date")).join(split, keys).filter(F.col("year") <= F.col("split_year"))
    annual = past.groupBy(*keys, "year").agg(F.avg(value).alias("annual_mean"), F.count(F.lit(1)).alias("n_days"))
    full = F.col("n_days") >= 330
    return annual.groupBy(*keys).agg(
        F.regr_slope(F.when(full, F.col("annual_mean")), F.when(full, F.col("year"))).alias("slope"),
        (F.sum(F.col("year") * F.col("n_days")) / F.sum("n_days")).alias("mid_year"),
    )


def monthly_totals(obs: DataFrame, value: str = "precip", keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["station"]
    d = F.col("obs_date")
    return obs.groupBy(*keys, F.year(d).alias("year"), F.month(d).alias("month")).agg(F.sum(value).alias("total"))


def season_window_normals(clim: DataFrame, starts: DataFrame, values: list[str], days: int = 30) -> DataFrame:
    """Mean normals over the ``days`` days from ``start_date`` (per station)."""
    span = starts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(
        "doy", capped_doy(F.date_add("start_date", F.col("_k")))
    )
    return (
        span.join(clim, ["station", "doy"])
        .groupBy("station", "start_date")
        .agg(*[F.avg(f"{v}_mean").alias(f"{v}_normal") for v in values])
    )


# --------------------------------------------------------------------------- grids
def field_mean(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Time mean per cell; NULL days are skipped."""
    return grid.groupBy(*keys, "lat", "lon").agg(F.avg("value").alias("value"))


def monthly_grid_climatology(grid: DataFrame, keys: list[str]) -> DataFrame:
    """12 monthly normals per cell plus month 13, the annual one (13 steps).

    One pass: the monthly sums are kept and the annual step adds them up.
    """
    monthly = grid.groupBy(*keys, "lat", "lon", F.month("obs_date").alias("month")).agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n")
    )
    steps = monthly.withColumn("month", F.explode(F.array("month", F.lit(13))))
    return steps.groupBy(*keys, "lat", "lon", "month").agg((F.sum("_s") / F.sum("_n")).alias("value"))


def month_set_normal(clim: DataFrame, months: DataFrame, keys: list[str], cell_keys: list[str]) -> DataFrame:
    """Equal-weight mean of the monthly normals over the months present (``months``:
    ``keys`` + month)."""
    present = months.select(*keys, "month").distinct()
    return clim.join(present, [*keys, "month"]).groupBy(*cell_keys).agg(F.avg("value").alias("normal"))
