"""Drought, heat, cold, rain-extreme and season indices of daily station records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.calendar import capped_doy
from terraloom.functions.numeric import bands, clip
from terraloom.operators import climatology as cl
from terraloom.operators import windows as wn

# Class limits.
SPI_BANDS = [
    ("<=", -2.0, "Extreme drought"),
    ("<=", -1.5, "Severe drought"),
    ("<=", -1.0, "Moderate drought"),
    ("<", 1.0, "Near normal"),
    ("<", 1.5, "Moderately wet"),
]
Z_DROUGHT = [("<", -1.3, "Severe"), ("<", -0.8, "Moderate"), ("<", -0.5, "Mild")]
ANOMALY_DROUGHT = [("<", -40.0, "Severe"), ("<", -20.0, "Moderate"), ("<", -10.0, "Mild")]


def spi_class(x: Column) -> Column:
    return bands(x, SPI_BANDS, "Very wet")


def drought_from_z(z: Column) -> Column:
    return bands(z, Z_DROUGHT, "Normal")


def drought_from_anomaly(pct: Column) -> Column:
    return bands(pct, ANOMALY_DROUGHT, "Normal")


def spi(monthly: DataFrame, keys: list[str] | None = None, months: int = 3) -> DataFrame:
    """Standardised precipitation index: rolling sums standardised per calendar month.

    A series holds 12 rows a year, so both windows stay small; they share one shuffle by
    ``keys``.
    """
    keys = keys or ["station"]
    w = Window.partitionBy(*keys).orderBy("year", "month")
    rolled = monthly.withColumn("sum3", wn.full_sum(F.col("total"), w, -(months - 1), 0))
    per_month = Window.partitionBy(*keys, "month")
    z = (F.col("sum3") - F.avg("sum3").over(per_month)) / (F.stddev_pop("sum3").over(per_month) + 1e-6)
    value = F.when(F.count("sum3").over(per_month) > 5, z)
    return rolled.withColumn("spi", clip(value, -3, 3)).withColumn("class", spi_class(F.col("spi")))


def spi_latest(spi_rows: DataFrame, keys: list[str] | None = None, months: int = 60) -> DataFrame:
    """The last ``months`` months of the index, NULL months dropped, age 0 first."""
    keys = keys or ["station"]
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc(), F.col("month").desc())
    ranked = spi_rows.withColumn("age", F.row_number().over(w) - 1)
    return ranked.filter((F.col("age") < months) & F.col("spi").isNotNull())


def heat_days(obs: DataFrame, clim: DataFrame, threshold: float = 4.5, abs_min: float = 30.0) -> DataFrame:
    """Adds the maximum-temperature anomaly, the hot flag and the spell columns."""
    a = cl.daily_anomaly(obs, clim, ["tmax"])
    hot = F.coalesce((F.col("tmax_anom") >= threshold) & (F.col("tmax") >= abs_min), F.lit(False))
    return wn.spells(a.withColumn("hot", hot), "hot", ["station"])


def days_per_year(flagged: DataFrame, flag: str, keys: list[str] | None = None, years: int | None = 12) -> DataFrame:
    """Flagged days per year; with ``years`` only the newest years of each key."""
    keys = keys or ["station"]
    per_year = flagged.groupBy(*keys, F.year("obs_date").alias("year")).agg(
        F.count_if(F.col(flag)).alias("days"), F.count(F.lit(1)).alias("n_days")
    )
    if years is None:
        return per_year
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc())
    return per_year.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= years).drop("_r")


def heat_status(days: DataFrame) -> DataFrame:
    """Newest anomaly and whether any of the last three days lies in a spell."""
    return (
        wn.last_rows(days, 3, ["station"])
        .groupBy("station")
        .agg(
            F.max("obs_date").alias("as_of"),
            F.max_by("tmax_anom", "obs_date").alias("recent_tmax_anomaly"),
            F.bool_or("in_spell").alias("active"),
        )
        .withColumn("status", F.when(F.col("active"), "Heatwave conditions").otherwise("No active heatwave"))
    )


def wet_threshold(obs: DataFrame, pct: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """Percentile of the wet days (at least 1 mm) with linear interpolation; 0 where there
    is no wet day. Bounded input: one value per day of the calendar."""
    keys = keys or ["station"]
    wet = F.when(F.col("precip") >= 1.0, F.col("precip"))
    return obs.groupBy(*keys).agg(F.coalesce(F.percentile(wet, F.lit(pct)), F.lit(0.0)).alias("threshold"))


def heavy_days(obs: DataFrame, pct: float = 0.95) -> DataFrame:
    return obs.join(wet_threshold(obs, pct), "station").withColumn("heavy", F.col("precip") >= F.col("threshold"))


def year_summary(per_year: DataFrame, keys: list[str] | None = None, min_days: int = 330) -> DataFrame:
    """Latest full year, its count, and the mean of the full years before it.

    Without a full year the newest year stands in; with a single one the baseline is its
    own count.
    """
    keys = keys or ["station"]
    full = F.col("n_days") >= min_days
    tops = per_year.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(full, F.col("year"))), F.max("year")).alias("latest_year")
    )
    j = per_year.join(tops, keys)
    latest = F.col("year") == F.col("latest_year")
    return j.groupBy(*keys, "latest_year").agg(
        F.max(F.when(latest, F.col("days"))).alias("latest_days"),
        F.coalesce(
            F.avg(F.when(full & ~latest, F.col("days"))), F.max(F.when(latest, F.col("days"))).cast("double")
        ).alias("baseline_days"),
    )


def cold_status(obs: DataFrame, clim: DataFrame, threshold: float = 4.5) -> DataFrame:
    """Mean minimum-temperature anomaly of the last three days and the cold-snap flag."""
    a = cl.daily_anomaly(obs, clim, ["tmin"])
    return (
        wn.last_rows(a, 3, ["station"])
        .groupBy("station")
        .agg(F.avg("tmin_anom").alias("recent_tmin_anomaly"))
        .withColumn("active", F.col("recent_tmin_anomaly") <= -threshold)
        .withColumn("status", F.when(F.col("active"), "Cold-snap conditions").otherwise("No active cold-wave"))
    )


def frost_days(obs: DataFrame) -> DataFrame:
    return obs.withColumn("frost", F.col("tmin") <= 0.0)


def monsoon_curve(obs: DataFrame, min_days: int = 100, truncate: bool = True) -> DataFrame:
    """Mean cumulative curve over the seasons of at least ``min_days`` days beside the
    newest year's curve, per day of season.

    ``truncate`` keeps the default rule: the curve ends with the shortest such season.
    """
    s = wn.season_curve(obs)
    whole = F.col("season_days") >= min_days
    # the newest year of the record, also when its season has not begun
    newest = obs.groupBy("station").agg(F.max(F.year("obs_date")).alias("last_year"))
    length = s.filter(whole).groupBy("station").agg(F.min("season_days").alias("length"))
    j = s.join(newest, "station").join(length, "station")
    if truncate:
        j = j.filter(F.col("dos") <= F.col("length"))
    return j.groupBy("station", "last_year", "length", "dos").agg(
        F.avg(F.when(whole, F.col("cum"))).alias("normal"),
        F.max(F.when(F.col("year") == F.col("last_year"), F.col("cum"))).alias("current"),
    )


def monsoon_summary(obs: DataFrame, onset_mm: float = 10.0) -> DataFrame:
    """Season progress and onset of the newest year. Onset is the first day of a full
    7-day spell of at least ``onset_mm``; NULL when the season has none (or no rows yet)."""
    curve = monsoon_curve(obs)
    totals = curve.groupBy("station", "last_year").agg(
        F.max_by("normal", "dos").alias("seasonal_normal"),
        F.coalesce(F.max_by("current", F.when(F.col("current").isNotNull(), F.col("dos"))), F.lit(0.0)).alias("received"),
    )
    s = wn.season_curve(obs)
    onset = (
        s.filter(F.col("run7") >= onset_mm).groupBy("station", F.col("year").alias("last_year")).agg(F.min("obs_date").alias("onset_date"))
    )
    return totals.join(onset, ["station", "last_year"], "left").withColumn(
        "progress_pct", F.col("received") / (F.col("seasonal_normal") + 1e-6) * 100
    )


def warming_trend(obs: DataFrame) -> DataFrame:
    """Annual means with the fitted trend, slope per decade and total change."""
    annual = cl.annual_mean(obs)
    fit = cl.linear_trend(annual)
    return annual.join(fit, "station").select(
        "station",
        "year",
        "annual_mean",
        (F.col("slope") * F.col("year") + F.col("intercept")).alias("trend"),
        (F.col("slope") * 10).alias("slope_per_decade"),
        (F.col("slope") * (F.col("last_year") - F.col("first_year"))).alias("total_change"),
    )


def records(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All-time extremes with the first date they occurred on.

    ``max`` over (value, negated day) structs is a partial aggregate: no sort, no window.
    """
    keys = keys or ["station"]
    day = F.unix_date("obs_date")

    def top(value: Column, alias: str) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-day).alias("d")))).alias(alias)

    agg = obs.groupBy(*keys).agg(
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
        F.count(F.lit(1)).alias("record_days"),
        top(F.col("tmax"), "_h"),
        top(-F.col("tmin"), "_c"),
        top(F.col("precip"), "_w"),
    )
    return agg.select(
        *keys,
        "first_date",
        "last_date",
        "record_days",
        F.col("_h.v").alias("hottest"),
        F.date_from_unix_date(-F.col("_h.d")).alias("hottest_date"),
        (-F.col("_c.v")).alias("coldest"),
        F.date_from_unix_date(-F.col("_c.d")).alias("coldest_date"),
        F.col("_w.v").alias("wettest"),
        F.date_from_unix_date(-F.col("_w.d")).alias("wettest_date"),
    )


def current_state(obs: DataFrame, clim: DataFrame) -> DataFrame:
    """State of each station from its newest 90 days: temperature and rain anomaly, soil
    moisture proxy, drought class, warming trend."""
    j = wn.last_rows(cl.with_normals(obs, clim), 90, ["station"])
    in30 = F.col("age") < 30
    trend = cl.linear_trend(cl.annual_mean(obs), min_days=None).select("station", "slope")
    s = j.groupBy("station").agg(
        F.max("obs_date").alias("as_of"),
        F.avg(F.when(in30, F.col("tmean"))).alias("mean_temp"),
        F.avg(F.when(in30, F.col("tmean_mean"))).alias("_clim_t"),
        F.sum(F.when(in30, F.col("precip"))).alias("precip_30d"),
        F.sum("precip").alias("_p90"),
        F.sum("precip_mean").alias("_c90"),
        F.stddev_pop("precip_mean").alias("_sd90"),
        F.sum(F.when(F.col("age") < 45, F.col("precip") * F.pow(F.lit(0.94), F.col("age")))).alias("api"),
    )
    z = (F.col("_p90") - F.col("_c90")) / (F.col("_sd90") * F.sqrt(F.lit(90.0)) + 1e-6)
    return s.join(trend, "station").select(
        "station",
        "as_of",
        clip((F.col("_p90") / (F.col("_c90") + 1e-6) - 1) * 100, -70, 100).alias("rain_anomaly_pct"),
        (F.col("mean_temp") - F.col("_clim_t")).alias("temp_anomaly"),
        clip(0.15 + F.col("api") / 60.0, 0.05, 0.95).alias("soil_moisture"),
        drought_from_z(z).alias("drought_class"),
        (F.col("slope") * 10).alias("trend_per_decade"),
        "mean_temp",
        "precip_30d",
    )


def splice_tail(hist: DataFrame, feed: DataFrame, min_overlap: int = 365) -> DataFrame:
    """History followed by the feed's later days, brought to the history's level.

    Temperatures transfer as day-of-year anomalies; rain is scaled by the clipped ratio of
    the two normals where the feed's normal exceeds 0.15. Feeds with fewer than
    ``min_overlap`` days inside the history are not spliced.
    """
    vars4 = ["tmean", "tmax", "tmin", "precip"]
    ends = hist.groupBy("station").agg(F.max("obs_date").alias("hist_end"))
    f = feed.select("station", "obs_date", "tmean", "tmax", "tmin", F.greatest("precip", F.lit(0.0)).alias("precip"))
    f = f.filter(F.col("tmean").isNotNull() & F.col("precip").isNotNull()).join(ends, "station")
    over = f.filter(F.col("obs_date") <= F.col("hist_end"))
    enough = over.groupBy("station").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_overlap).select("station")
    fc = cl.doy_climatology(over, vars4)
    hc = cl.doy_climatology(hist, vars4)
    fc = fc.select("station", "doy", *[F.col(f"{v}_mean").alias(f"f_{v}") for v in vars4])
    hc = hc.select("station", "doy", *[F.col(f"{v}_mean").alias(f"h_{v}") for v in vars4])
    tail = (
        f.filter(F.col("obs_date") > F.col("hist_end"))
        .withColumn("doy", capped_doy(F.col("obs_date")))
        .join(enough, "station", "left_semi")
        .join(fc, ["station", "doy"], "left")
        .join(hc, ["station", "doy"], "left")
    )
    ratio = F.when(F.col("f_precip") > 0.15, clip(F.col("h_precip") / F.col("f_precip"), 0.2, 6.0)).otherwise(F.lit(1.0))
    temps = [(F.col(f"h_{v}") + F.col(v) - F.col(f"f_{v}")).alias(v) for v in ("tmean", "tmax", "tmin")]
    spliced = tail.select("station", "obs_date", *temps, F.greatest(F.col("precip") * ratio, F.lit(0.0)).alias("precip"), F.lit(True).alias("is_tail"))
    head = hist.select("station", "obs_date", "tmean", "tmax", "tmin", "precip", F.lit(False).alias("is_tail"))
    return head.unionByName(spliced)


def summary(obs: DataFrame, clim: DataFrame) -> DataFrame:
    """Drought, heat and season status of each station in one row."""
    s = spi_latest(spi(cl.monthly_totals(obs))).filter("age = 0").select("station", "spi", F.col("class").alias("spi_class"))
    heat = heat_status(heat_days(obs, clim)).select("station", "as_of", F.col("active").alias("heat_active"), "recent_tmax_anomaly")
    season = monsoon_summary(obs).select("station", "onset_date", "progress_pct")
    return heat.join(s, "station", "left").join(season, "station", "left")


def analytics(obs: DataFrame, clim: DataFrame) -> DataFrame:
    """Long-term trend, rain extremes, cold status and records of each station in one row."""
    trend = cl.linear_trend(cl.annual_mean(obs)).select("station", (F.col("slope") * 10).alias("slope_per_decade"))
    heavy = year_summary(days_per_year(heavy_days(obs), "heavy", years=None))
    heavy = heavy.select("station", "latest_year", F.col("latest_days").alias("heavy_days"), "baseline_days")
    frost = year_summary(days_per_year(frost_days(obs), "frost", years=None)).select("station", F.col("latest_days").alias("frost_days"))
    cold = cold_status(obs, clim).select("station", "recent_tmin_anomaly")
    rec = records(obs).select("station", "record_days", "hottest", "coldest", "wettest")
    return rec.join(trend, "station", "left").join(heavy, "station", "left").join(frost, "station", "left").join(cold, "station", "left")


def record_span(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First and last day and number of days of each record."""
    keys = keys or ["station"]
    return obs.groupBy(*keys).agg(F.min("obs_date").alias("start"), F.max("obs_date").alias("end"), F.count(F.lit(1)).alias("days"))
