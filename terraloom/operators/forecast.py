"""14-day station forecasts: member forecasts, non-negative blends, backtests, outlooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.calendar import capped_doy
from terraloom.functions.numeric import clip
from terraloom.operators import climatology as cl
from terraloom.operators import windows as wn

HORIZON = 14  # fixed value
DECAY = 0.7  # fixed value: damping per lead of the persistence member
KEYS = ["station"]


def split_years(obs: DataFrame, holdout: int = 3) -> DataFrame:
    """Per station: models see the years up to ``split_year``, blends are fitted on the year
    after it and scored on the later ones."""
    return obs.groupBy(*KEYS).agg((F.max(F.year("obs_date")) - holdout).alias("split_year"))


def trend_offset(value: str, trend: DataFrame | None) -> Column:
    """Warming since the climatology's mid year, for temperature only."""
    return F.col("slope") * (F.col("year") - F.col("mid_year")) if value == "tmean" and trend is not None else F.lit(0.0)


def origin_state(obs: DataFrame, clim: DataFrame, value: str, trend: DataFrame | None = None) -> DataFrame:
    """Every row of the record as a possible issue date with its recent anomalies."""
    d = cl.with_normals(obs, clim.select(*KEYS, "doy", F.col(f"{value}_mean").alias("normal")))
    if trend is not None:
        d = d.join(trend, KEYS)
    w = wn.by_date(KEYS)
    last5, last14 = w.rowsBetween(-4, 0), w.rowsBetween(-13, 0)
    off = trend_offset(value, trend)
    return d.withColumns(
        {
            "row_no": F.row_number().over(w),
            "offset": off,
            "anom5": F.avg(value).over(last5) - F.avg("normal").over(last5) - off,
            "anom14": F.avg(value).over(last14) - F.avg("normal").over(last14) - off,
            "anom1": F.col(value) - F.col("normal") - off,
        }
    )


def backtest_frame(obs: DataFrame, clim: DataFrame, value: str, trend: DataFrame | None = None, horizon: int = HORIZON, warmup: int = 60) -> DataFrame:
    """One row per (station, issue date, lead): truth, climatology, trend-adjusted
    climatology and the anomaly members.

    The next ``horizon`` days are gathered into a short array by a window and exploded, so
    the verification needs no self-join.
    """
    d = origin_state(obs, clim, value, trend)
    ahead = wn.by_date(KEYS).rowsBetween(1, horizon)
    d = d.withColumn("_next", F.collect_list(F.struct(F.col(value).alias("obs"), F.col("normal").alias("clim"))).over(ahead))
    d = d.filter((F.col("row_no") > warmup) & (F.size("_next") == horizon))
    long = d.select(*KEYS, F.col("obs_date").alias("issue_date"), "year", "offset", "anom5", "anom14", "anom1", F.posexplode("_next").alias("_k", "_n"))
    long = long.select(*KEYS, "issue_date", "year", "anom5", "anom14", "anom1", (F.col("_k") + 1).alias("lead"), "_n.obs", "_n.clim", (F.col("_n.clim") + F.col("offset")).alias("clim_trend"))
    return with_members(long, value)


def with_members(rows: DataFrame, value: str) -> DataFrame:
    """Damped persistence of the 5-day anomaly and naive persistence of the last day."""
    floor = (lambda c: c) if value == "tmean" else (lambda c: F.greatest(c, F.lit(0.0)))
    base = F.col("clim_trend")
    return rows.withColumns(
        {
            "persist": floor(base + F.col("anom5") * F.pow(F.lit(DECAY), F.col("lead"))),
            "naive": floor(base + F.col("anom1") * F.pow(F.lit(0.6), F.col("lead"))),
        }
    )


def fitted_decay(frame: DataFrame, split: DataFrame) -> DataFrame:
    """Least-squares damping of the 14-day anomaly per station and lead, training years only."""
    t = frame.join(split, KEYS).filter(F.col("year") <= F.col("split_year"))
    y = F.col("obs") - F.col("clim_trend")
    phi = F.sum(F.col("anom14") * y) / (F.sum(F.col("anom14") * F.col("anom14")) + 1e-9)
    return t.groupBy(*KEYS, "lead").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), phi)).alias("phi"))


def with_fitted(frame: DataFrame, decay: DataFrame, value: str) -> DataFrame:
    damped = F.col("clim_trend") + F.col("phi") * F.col("anom14")
    return frame.join(decay, [*KEYS, "lead"]).withColumn("damped", damped if value == "tmean" else F.greatest(damped, F.lit(0.0)))


# --------------------------------------------------------------------------- blends
def gram(frame: DataFrame, members: list[str], keys: list[str], target: str = "obs", base: str = "clim_trend") -> DataFrame:
    """Normal equations of three members as anomalies around ``base``: nine sums per key."""
    x = [F.col(m) - F.col(base) for m in members]
    y = F.col(target) - F.col(base)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)]
    return frame.groupBy(*keys).agg(*sums, *[F.sum(x[i] * y).alias(f"b{i}") for i in range(3)], F.count(F.lit(1)).alias("n"))


def nnls3(normal: DataFrame) -> DataFrame:
    """Exact non-negative least squares for three members, in column expressions.

    The optimum is the unconstrained solution of one of the eight active sets; at such a
    point the objective is minus the dot product of weights and right-hand side, so the
    best feasible candidate is the minimum of that. Singular sets are skipped.
    """
    g = lambda i, j: F.col(f"g{min(i, j)}{max(i, j)}")
    b = lambda i: F.col(f"b{i}")
    zero = F.lit(0.0)

    def candidate(w: dict[int, Column], det: Column | None) -> Column:
        ws = [w.get(k, zero) for k in range(3)]
        gain = ws[0] * b(0) + ws[1] * b(1) + ws[2] * b(2)
        ok = (ws[0] >= 0) & (ws[1] >= 0) & (ws[2] >= 0)
        if det is not None:
            ok = ok & (F.abs(det) > 1e-12)
        return F.when(ok, F.struct((-gain).alias("f"), *[c.alias(f"w{k}") for k, c in enumerate(ws)]))

    out = [candidate({}, None)]
    for i in range(3):
        out.append(candidate({i: F.try_divide(b(i), g(i, i))}, g(i, i)))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        det = g(i, i) * g(j, j) - g(i, j) * g(i, j)
        out.append(candidate({
            i: F.try_divide(b(i) * g(j, j) - b(j) * g(i, j), det), j: F.try_divide(b(j) * g(i, i) - b(i) * g(i, j), det),
        }, det))

    def det3(c: list[list[Column]]) -> Column:
        return (
            c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1])
            - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0])
            + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
        )

    full = [[g(i, j) for j in range(3)] for i in range(3)]
    det = det3(full)
    swap = lambda k: det3([[b(i) if j == k else full[i][j] for j in range(3)] for i in range(3)])
    out.append(candidate({k: F.try_divide(swap(k), det) for k in range(3)}, det))
    best = F.array_min(F.array_compact(F.array(*out)))
    d = normal.withColumn("_w", best)
    keep = [c for c in normal.columns if c[0] not in "gb" or len(c) > 3]
    norm = F.sqrt(sum(F.pow(F.col(f"_w.w{k}"), F.lit(2)) for k in range(3)))
    return d.select(*keep, *[F.col(f"_w.w{k}").alias(f"w{k}") for k in range(3)], norm.alias("weight_norm"))


def blend(frame: DataFrame, weights: DataFrame, members: list[str], value: str) -> DataFrame:
    base = F.col("clim_trend")
    v = base
    for k, m in enumerate(members):
        v = v + F.col(f"w{k}") * (F.col(m) - base)
    v = v if value == "tmean" else F.greatest(v, F.lit(0.0))
    return frame.join(weights.select(*KEYS, "lead", "w0", "w1", "w2"), [*KEYS, "lead"]).withColumn("blend", v)


# --------------------------------------------------------------------------- live forecast
def live_rows(obs: DataFrame, clim: DataFrame, value: str, trend: DataFrame | None = None, horizon: int = HORIZON) -> DataFrame:
    """Rows of the forecast issued on each station's newest day, one per lead."""
    newest = wn.last_rows(origin_state(obs, clim, value, trend), 1, KEYS)
    d = newest.select(*KEYS, F.col("obs_date").alias("issue_date"), "offset", "anom5", "anom14", "anom1", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead"))
    d = d.withColumn("target_date", F.date_add("issue_date", F.col("lead"))).withColumn("doy", capped_doy(F.col("target_date")))
    d = d.join(clim.select(*KEYS, "doy", F.col(f"{value}_mean").alias("clim")), [*KEYS, "doy"])
    return with_members(d.withColumn("clim_trend", F.col("clim") + F.col("offset")), value)


def with_bands(rows: DataFrame, band: Column, value: str, point: str = "value") -> DataFrame:
    p = F.col(point)
    low = p - band if value == "tmean" else F.greatest(p - band, F.lit(0.0))
    return rows.withColumns({"upper": p + band, "lower": low})


def blended_forecast(live: DataFrame, weights: DataFrame, by_lead: DataFrame, members: list[str], value: str) -> DataFrame:
    """Blend for the newest issue date with +- RMSE(lead) bands from the backtest."""
    b = blend(live, weights, members, value).join(by_lead.select(*KEYS, "lead", "rmse"), [*KEYS, "lead"])
    return with_bands(b.withColumnRenamed("blend", "value"), F.col("rmse"), value)


def fallback_forecast(rows: DataFrame, value: str, model: str = "model") -> DataFrame:
    """0.6 model + 0.4 damped climatology; the band grows with lead and disagreement.

    ``rows`` carry the model forecast, clim, anom5, lead, resid_std and half_trend.
    """
    trend = F.col("half_trend") if value == "tmean" else F.lit(0.0)
    member = F.col("clim") + trend + F.col("anom5") * F.pow(F.lit(DECAY), F.col("lead"))
    v = 0.6 * F.col(model) + 0.4 * member
    v = v if value == "tmean" else F.greatest(v, F.lit(0.0))
    band = (F.col("resid_std") + F.abs(F.col(model) - member) / 2) * (1 + 0.04 * F.col("lead"))
    return with_bands(rows.withColumn("value", v), band, value)


def gate(scores: DataFrame, preferred: str, fallback: str, keys: list[str]) -> DataFrame:
    """Model choice: the preferred one only where its skill is positive."""
    s = scores.groupBy(*keys).agg(F.max(F.when(F.col("method") == preferred, F.col("skill_pct"))).alias("_s"))
    return s.select(*keys, F.when(F.col("_s") > 0, preferred).otherwise(fallback).alias("method"))


# --------------------------------------------------------------------------- derived outlooks
def soil_outlook(recent: DataFrame, rain: DataFrame, temp: DataFrame, clim: DataFrame, state: DataFrame) -> DataFrame:
    """Soil-moisture and drought-risk trajectories from seven observed days and the two
    14-day forecasts (a daily water-balance bucket anchored at today's soil moisture).

    ``recent``: the newest seven days (``age`` 0 = now, precip, tmean); at most 21 rows per
    station enter the running sum.
    """
    seen = recent.select(*KEYS, F.col("obs_date").alias("day"), (-F.col("age")).alias("step"), F.col("precip").alias("rain"), F.col("tmean").alias("temp"), F.lit(None).cast("double").alias("spread"))
    ahead = rain.select(*KEYS, F.col("target_date").alias("day"), F.col("lead").alias("step"), F.col("value").alias("rain"), (F.col("upper") - F.col("value")).alias("spread"))
    ahead = ahead.join(temp.select(*KEYS, F.col("target_date").alias("day"), F.col("value").alias("temp")), [*KEYS, "day"])
    d = seen.unionByName(ahead.select(*seen.columns)).withColumn("doy", capped_doy(F.col("day")))
    d = d.join(clim.select(*KEYS, "doy", "precip_mean", "tmean_mean"), [*KEYS, "doy"])
    delta = 0.012 * (F.col("rain") - F.col("precip_mean")) - 0.007 * (F.col("temp") - F.col("tmean_mean"))
    w = Window.partitionBy(*KEYS).orderBy("step")
    first = F.row_number().over(w) == 1
    d = d.withColumn("_d", delta).withColumn("_first", first)
    d = d.withColumn("raw", F.sum(F.when(F.col("_first"), 0.0).otherwise(F.col("_d"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seam = F.max(F.when(F.col("step") == 0, F.col("raw"))).over(Window.partitionBy(*KEYS))
    d = d.join(state.select(*KEYS, "soil_moisture"), KEYS).withColumn("soil", clip(F.col("raw") + F.col("soil_moisture") - seam, 0.08, 0.95))
    d = d.withColumn("drought_risk", clip((0.55 - F.col("soil")) * 185, 0, 100))
    band = F.coalesce(0.012 * F.col("spread") * F.sqrt(F.col("step")), F.lit(0.0))
    return d.select(
        *KEYS, "day", "step", "soil", "drought_risk",
        F.least(F.lit(0.95), F.col("soil") + band).alias("soil_upper"), F.greatest(F.lit(0.0), F.col("soil") - band).alias("soil_lower"),
        F.least(F.lit(100.0), F.col("drought_risk") + band * 185).alias("risk_upper"), F.greatest(F.lit(0.0), F.col("drought_risk") - band * 185).alias("risk_lower"),
    )


def outlook_totals(rain: DataFrame, temp: DataFrame) -> DataFrame:
    """14-day rain total and mean temperature beside their normals."""
    r = rain.groupBy(*KEYS).agg(F.sum("value").alias("rain_total"), F.sum("clim").alias("rain_normal"))
    t = temp.groupBy(*KEYS).agg(F.avg("value").alias("temp_mean"), F.avg("clim").alias("temp_normal"))
    return r.join(t, KEYS)


def climatology_rmse(obs: DataFrame, clim: DataFrame, value: str, days: int = 365) -> DataFrame:
    """RMSE of the climatology over the last ``days`` rows of each station."""
    j = wn.last_rows(cl.with_normals(obs, clim), days, KEYS)
    e = F.col(value) - F.col(f"{value}_mean")
    return j.groupBy(*KEYS).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
