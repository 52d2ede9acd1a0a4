"""Series windows: trailing frames, lags, runs, season sums, as-of anchors.

All windows are partitioned by the series key. A series has one row per day (or month),
so the largest possible partition is the calendar, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.calendar import harmonics
from terraloom.operators.ranking import group_rank

LAGS = [1, 2, 3, 7, 14, 30]  # fixed values: lags of the forecaster's features


def by_date(keys: list[str], order: str = "obs_date") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def with_age(df: DataFrame, keys: list[str], order: str = "obs_date") -> DataFrame:
    """``age`` = 0 for the newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("age", F.row_number().over(w) - 1)


def last_rows(df: DataFrame, n: int, keys: list[str], order: str = "obs_date") -> DataFrame:
    return with_age(df, keys, order).filter(F.col("age") < n)


def trailing_mean(value: Column, days: int, keys: list[str], order: str = "obs_date") -> Column:
    return F.avg(value).over(by_date(keys, order).rowsBetween(-(days - 1), 0))


def trailing_any(flag: Column, days: int, keys: list[str], order: str = "obs_date") -> Column:
    return F.bool_or(flag).over(by_date(keys, order).rowsBetween(-(days - 1), 0))


def full_sum(value: Column, w: Window, start: int, end: int) -> Column:
    """Frame sum that is NULL unless every row of the frame exists."""
    frame = w.rowsBetween(start, end)
    return F.when(F.count(F.lit(1)).over(frame) == end - start + 1, F.sum(value).over(frame))


def spells(df: DataFrame, flag: str, keys: list[str], order: str = "obs_date", min_run: int = 2) -> DataFrame:
    """Gaps and islands: adds ``run_id``, ``run_length`` and ``in_spell`` (runs of at least
    ``min_run`` consecutive flagged rows)."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.withColumn("_rn", F.row_number().over(w))
    island = Window.partitionBy(*keys, flag).orderBy(order)
    r = r.withColumn("run_id", F.when(F.col(flag), F.col("_rn") - F.row_number().over(island)))
    run = Window.partitionBy(*keys, flag, "run_id")
    r = r.withColumn("run_length", F.when(F.col(flag), F.count(F.lit(1)).over(run)).otherwise(0))
    return r.withColumn("in_spell", F.col("run_length") >= min_run).drop("_rn")


def antecedent_index(
    df: DataFrame, value: str = "precip", keys: list[str] | None = None, days: int = 45, decay: float = 0.94
) -> DataFrame:
    """Recency-weighted sum over the trailing ``days`` rows, for every row of the series."""
    keys = keys or ["station"]
    frame = by_date(keys).rowsBetween(-(days - 1), 0)
    folded = F.aggregate(
        F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(frame),
        F.lit(0.0),
        lambda acc, x: acc * F.lit(decay) + x,
    )
    return df.withColumn("api", folded)


def season_curve(obs: DataFrame, value: str = "precip", keys: list[str] | None = None, first: int = 6, last: int = 9) -> DataFrame:
    """Cumulative seasonal sum with day-of-season number and season length, per year."""
    keys = keys or ["station"]
    s = obs.withColumns({"year": F.year("obs_date"), "_mo": F.month("obs_date")}).filter(F.col("_mo").between(first, last))
    w = Window.partitionBy(*keys, "year").orderBy("obs_date")
    whole = Window.partitionBy(*keys, "year")
    return s.select(
        *keys,
        "year",
        "obs_date",
        F.row_number().over(w).alias("dos"),
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        full_sum(F.col(value), w, 0, 6).alias("run7"),
        F.count(F.lit(1)).over(whole).alias("season_days"),
    )


def lag_features(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Features for predicting a day from the days before it: harmonics, lags, rolling
    means and sums that exclude the day itself. ``row_no`` counts from 1."""
    keys = keys or ["station"]
    w = by_date(keys)
    cols: dict[str, Column] = {"row_no": F.row_number().over(w)}
    cols |= harmonics(F.col("doy"))
    for n in LAGS:
        cols[f"tmean_lag{n}"] = F.lag("tmean", n).over(w)
        cols[f"precip_lag{n}"] = F.lag("precip", n).over(w)
    for n in (7, 30):
        cols[f"tmean_mean{n}"] = F.avg("tmean").over(w.rowsBetween(-n, -1))
        cols[f"precip_sum{n}"] = F.sum("precip").over(w.rowsBetween(-n, -1))
    return obs.withColumns(cols)


def sequence_windows(obs: DataFrame, value: str, keys: list[str] | None = None, back: int = 30, ahead: int = 14) -> DataFrame:
    """The last ``back`` values before an issue row and the ``ahead`` values from it on;
    rows without both full windows are dropped."""
    keys = keys or ["station"]
    w = by_date(keys)
    out = obs.withColumns(
        {
            "window_in": F.collect_list(value).over(w.rowsBetween(-back, -1)),
            "window_out": F.collect_list(value).over(w.rowsBetween(0, ahead - 1)),
        }
    )
    return out.filter((F.size("window_in") == back) & (F.size("window_out") == ahead))


def season_anchor(obs: DataFrame, today: Column, keys: list[str] | None = None) -> DataFrame:
    """As-of anchor: the newest day whose day of year is not after yesterday's; the newest
    day of all where there is none."""
    keys = keys or ["station"]
    yesterday = F.least(F.dayofyear(F.date_sub(today, 1)), F.lit(365))
    return obs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("doy") <= yesterday, F.col("obs_date"))), F.max("obs_date")).alias("anchor_date")
    )


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Latest-wins view. The newest row is picked by a ``max`` aggregate (partial before
    the shuffle), so a key with very many versions never gathers in one task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.struct(*order), F.struct(F.lit(0), *comparable(df, rest)))).alias("_m")
    return df.groupBy(*keys).agg(newest).select(*keys, "_m.*")


def comparable(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that can be ordered, to break ties; maps cannot, at any depth."""
    return [c for c in columns if not any(t in df.schema[c].dataType.simpleString() for t in ("map<", "variant"))]


def time_split(df: DataFrame, keys: list[str], holdout_years: int = 3) -> DataFrame:
    """Adds ``split_year`` (last year minus the held-out ones) and ``is_train``."""
    last = df.groupBy(*keys).agg((F.max("year") - holdout_years).alias("split_year"))
    return df.join(last, keys).withColumn("is_train", F.col("year") <= F.col("split_year"))


def ordered_share(df: DataFrame, keys: list[str], order: str, share: float = 0.75) -> DataFrame:
    """Marks the first ``share`` of the ordered rows of a key (floor of share * n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("in_first", F.row_number().over(w) <= F.floor(n * share))


def half_split(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """``half`` = 'older' for the first floor(n/2) rows of a key, else 'newer'.

    Only (keys, order, tie) are ranked; the rows themselves are compared with their key's border
    row and need neither sorting nor storing. ``tie`` tells the rows of a key apart.
    """
    ranked = group_rank(df.select(*keys, order, tie), keys, order, tie, "_rank", "_n")
    border = ranked.filter(F.col("_rank") == F.floor(F.col("_n") / 2)).select(*keys, F.struct(order, tie).alias("_border"))
    older = F.coalesce(F.struct(order, tie) <= F.col("_border"), F.lit(False))
    return df.join(border, keys, "left").withColumn("half", F.when(older, "older").otherwise("newer")).drop("_border")


def every_nth(df: DataFrame, keys: list[str], order: str, step: int = 2) -> DataFrame:
    """Every ``step``-th issue row of a key, beginning with the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % step == 0).drop("_i")
