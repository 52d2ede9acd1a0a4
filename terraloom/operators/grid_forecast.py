"""Per-cell forecasts on grids: persistence, fitted damped persistence, and their skill.

Time steps are addressed by day number, so "L days earlier" is a range frame over one
cell's own rows; no self-join is needed and a cell's partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.calendar import daily_normals, interp_log_decay
from terraloom.functions.numeric import skill_pct

CELL = ["lat", "lon"]
FIT_LEADS = [1, 3, 7, 14]  # fixed value
SEED_DAYS = 3  # fixed value
NAIVE = 0.6  # fixed value: decay per day of the naive persistence


def persistence_forecast(anomaly: DataFrame, clim: DataFrame, ends: DataFrame, keys: list[str], leads: int = 14) -> DataFrame:
    """clim(target month) + anomaly * 0.6^lead for every lead 1..``leads`` at once."""
    f = anomaly.select(*keys, *CELL, "anomaly").join(ends, keys)
    f = f.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads))))
    f = f.withColumn("target_date", F.date_add("end_date", F.col("lead"))).withColumn("month", F.month("target_date"))
    normal = clim.select(*keys, *CELL, "month", F.col("value").alias("normal"))
    decayed = F.col("anomaly") * F.pow(F.lit(NAIVE), F.col("lead"))
    return f.join(normal, [*keys, *CELL, "month"], "left").select(
        *keys, *CELL, "lead", "target_date", (F.col("normal") + decayed).alias("value"), decayed.alias("anomaly")
    )


def _monthly_anomaly(grid: DataFrame, clim: DataFrame, keys: list[str]) -> DataFrame:
    normal = clim.select(*keys, *CELL, "month", F.col("value").alias("normal"))
    g = grid.withColumns({"month": F.month("obs_date"), "t": F.unix_date("obs_date")})
    return g.join(normal, [*keys, *CELL, "month"]).withColumn("anom", F.col("value") - F.col("normal"))


def persistence_skill(grid: DataFrame, clim: DataFrame, keys: list[str], leads: tuple[int, ...] = (1, 7, 14), test_days: int = 365) -> DataFrame:
    """RMSE and skill of persisted anomalies over the last ``test_days`` days, per lead."""
    a = _monthly_anomaly(grid, clim, keys)
    last = a.groupBy(*keys).agg(F.max("t").alias("_last"))
    w = Window.partitionBy(*keys, *CELL).orderBy("t")
    lagged = F.array(*[F.struct(F.lit(n).alias("lead"), F.max("anom").over(w.rangeBetween(-n, -n)).alias("p")) for n in leads])
    rows = a.withColumn("_l", lagged).join(last, keys).filter(F.col("t") > F.col("_last") - test_days)
    long = rows.select(*keys, "anom", F.explode("_l").alias("_l")).select(*keys, "anom", "_l.lead", "_l.p")
    miss = F.col("p") * F.pow(F.lit(NAIVE), F.col("lead")) - F.col("anom")
    s = long.groupBy(*keys, "lead").agg(
        F.sqrt(F.avg(F.col("anom") * F.col("anom"))).alias("clim_rmse"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.count("p").alias("n")
    )
    return s.withColumn("skill_pct", skill_pct(F.col("rmse"), F.col("clim_rmse")))


def daily_anomaly(grid: DataFrame, clim: DataFrame, keys: list[str]) -> DataFrame:
    """Anomaly against the periodic daily normals of each cell."""
    normals = daily_normals(clim, [*keys, *CELL])
    g = grid.withColumns({"doy": F.dayofyear("obs_date"), "t": F.unix_date("obs_date")})
    return g.join(normals, [*keys, *CELL, "doy"]).withColumn("anom", F.col("value") - F.col("normal"))


def issue_rows(anoms: DataFrame, keys: list[str], leads: list[int] | None = None, step: int = 2) -> DataFrame:
    """One row per (cell, target day, lead): the target anomaly ``y`` and the seed ``s``,
    the mean anomaly of the last three days up to the issue day (0 when none was observed).

    ``issue`` counts days from the first day of the grid; every ``step``-th issue day
    counts, and the first 75 % of the days are the fitting period.
    """
    leads = leads or FIT_LEADS
    span = anoms.groupBy(*keys).agg(F.min("t").alias("_t0"), (F.max("t") - F.min("t") + 1).alias("_n"))
    w = Window.partitionBy(*keys, *CELL).orderBy("t")
    seeds = F.array(
        *[
            F.struct(F.lit(n).alias("lead"), F.coalesce(F.avg("anom").over(w.rangeBetween(-(n + SEED_DAYS - 1), -n)), F.lit(0.0)).alias("s"))
            for n in leads
        ]
    )
    rows = anoms.filter(F.col("anom").isNotNull()).withColumn("_l", seeds).join(span, keys)
    long = rows.select(*keys, *CELL, "t", "doy", F.col("anom").alias("y"), "_t0", "_n", F.explode("_l").alias("_l"))
    long = long.select("*", "_l.lead", "_l.s", (F.col("t") - F.col("_t0") - F.col("_l.lead")).alias("issue")).drop("_l")
    long = long.filter((F.col("issue") >= SEED_DAYS) & ((F.col("issue") - SEED_DAYS) % step == 0))
    return long.withColumn("fit", F.col("issue") < F.floor(F.col("_n") * 0.75)).drop("_t0", "_n")


def fit_phi(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per-lead decay through the origin on the fitting period and its scores afterwards.

    Every score is a quadratic form of the same sums, so one aggregate serves fit and test.
    """
    s, y, fit = F.col("s"), F.col("y"), F.col("fit")
    agg = rows.groupBy(*keys, "lead").agg(
        F.sum(F.when(fit, s * y)).alias("sy"), F.sum(F.when(fit, s * s)).alias("ss"),
        F.sum(F.when(~fit, s * y)).alias("tsy"), F.sum(F.when(~fit, s * s)).alias("tss"),
        F.sum(F.when(~fit, y * y)).alias("tyy"), F.count_if(~fit).alias("n_test"),
    )
    phi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sy") / (F.col("ss") + 1e-9)))
    agg = agg.withColumn("phi", phi).withColumn("naive", F.pow(F.lit(NAIVE), F.col("lead")))

    def score(c):
        return F.sqrt(F.try_divide(c * c * F.col("tss") - 2 * c * F.col("tsy") + F.col("tyy"), F.col("n_test")))

    out = agg.withColumns({"rmse": score(F.col("phi")), "clim_rmse": score(F.lit(0.0)), "persist_rmse": score(F.col("naive"))})
    return out.select(
        *keys, "lead", "phi", "rmse", "clim_rmse", "persist_rmse", "n_test",
        skill_pct(F.col("rmse"), F.col("clim_rmse")).alias("skill_vs_clim_pct"),
        skill_pct(F.col("rmse"), F.col("persist_rmse")).alias("skill_vs_persist_pct"),
    )


def last_valid_day(grid: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Newest day on which more than ``share`` of the grid's cells hold a value.

    Cells and days are counted from a per-day pre-aggregate."""
    n_cells = grid.groupBy(*keys, *CELL).agg(F.lit(1).alias("_o")).groupBy(*keys).agg(F.count("_o").alias("n_cells"))
    per_day = grid.groupBy(*keys, "obs_date").agg(F.count("value").alias("n"))
    return per_day.join(n_cells, keys).filter(F.col("n") / F.col("n_cells") > share).groupBy(*keys).agg(
        F.max("obs_date").alias("seed_date")
    )


def damped_forecast(grid: DataFrame, clim: DataFrame, phi: DataFrame, keys: list[str], leads: int = 14, floor: float | None = None) -> DataFrame:
    """Fitted persistence for leads 1..``leads``: daily normal of the target day plus
    phi(lead) times the seed of the last valid day; cells without a seed start from 0."""
    normals = daily_normals(clim, [*keys, *CELL])
    seed_day = last_valid_day(grid, keys)
    fitted = phi.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lead", "phi"))).alias("fitted"))
    near = grid.join(seed_day, keys).filter(F.col("obs_date").between(F.date_sub("seed_date", SEED_DAYS - 1), F.col("seed_date")))
    near = near.withColumn("doy", F.dayofyear("obs_date")).join(normals, [*keys, *CELL, "doy"])
    seeds = near.groupBy(*keys, *CELL).agg(F.avg(F.col("value") - F.col("normal")).alias("seed"))
    cells = clim.select(*keys, *CELL).distinct().join(seed_day, keys).join(fitted, keys).join(seeds, [*keys, *CELL], "left")
    f = cells.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads))))
    f = f.withColumn("target_date", F.date_add("seed_date", F.col("lead"))).withColumn("doy", F.dayofyear("target_date"))
    anom = interp_log_decay(F.col("lead"), F.col("fitted")) * F.coalesce(F.col("seed"), F.lit(0.0))
    f = f.join(normals, [*keys, *CELL, "doy"]).withColumn("anomaly", anom)
    value = F.col("normal") + F.col("anomaly")
    if floor is not None:
        value = F.greatest(value, F.lit(float(floor)))
    return f.select(*keys, *CELL, "lead", "target_date", value.alias("value"), "anomaly")


def with_lead_skill(forecast: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast beside the skill of its lead; NULL for leads that were not scored."""
    return forecast.join(scored.select(*keys, "lead", "skill_vs_clim_pct"), [*keys, "lead"], "left")
