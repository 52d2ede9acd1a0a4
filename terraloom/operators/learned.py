"""Forecasters fitted with ``pyspark.ml`` and the unified backtest.

All stations share one model (their level and season enter as features or anomalies), so a
fit is one distributed job however many stations there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.calendar import capped_doy, harmonics
from terraloom.operators import climatology as cl
from terraloom.operators import forecast as fc
from terraloom.operators import grid as gr
from terraloom.operators import skill as sk
from terraloom.operators import windows as wn
from terraloom.session import cut_lineage

KEYS = ["station"]
HISTORY = 40  # fixed value: days of history behind a recursive forecast
FEATURES = (
    ["sin1", "cos1", "sin2", "cos2", "year_frac"]
    + [f"{v}_lag{n}" for n in wn.LAGS for v in ("tmean", "precip")]
    + [f"{p}{n}" for n in (7, 30) for p in ("tmean_mean", "precip_sum")]
)


class Forecaster(Protocol):
    """What the blend needs of a model: fit on a record, forecast (origin, lead, value)."""

    def fit(self, obs: DataFrame) -> Forecaster: ...

    def forecast(self, origins: DataFrame, horizon: int) -> DataFrame: ...


def _vector(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip").transform(df)


@dataclass
class BoostedTrees:
    """Lag-feature boosted trees for mean temperature and rain, forecast recursively."""

    rounds: int = 20
    depth: int = 4
    first_year: int | None = None
    last_year: int | None = None

    def features(self, obs: DataFrame) -> DataFrame:
        d = wn.lag_features(cl.with_calendar(obs)).filter(F.col("row_no") > max(wn.LAGS) + 1)
        span = (F.col("year") - self.first_year) / (self.last_year - self.first_year + 1e-9)
        return d.withColumn("year_frac", span)

    def fit(self, obs: DataFrame) -> BoostedTrees:
        """Trains on the years up to the last three and keeps the one-step test rows."""
        lo, hi = obs.agg(F.min(F.year("obs_date")), F.max(F.year("obs_date"))).first()
        self.first_year, self.last_year = lo, hi
        d = _vector(self.features(obs), FEATURES).withColumn("is_train", F.col("year") <= hi - 3).persist()
        train = d.filter("is_train")
        make = lambda y: GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=f"p_{y}", maxIter=self.rounds, maxDepth=self.depth, stepSize=0.1, seed=0)
        self.models = {y: make(y).fit(train) for y in ("tmean", "precip")}
        self.rows = d
        return self

    def one_step_scores(self, clim: DataFrame) -> DataFrame:
        """Scores of the one-day-ahead forecast on the held-out years."""
        t = self.rows.filter("not is_train")
        for m in self.models.values():
            t = m.transform(t)
        t = t.withColumn("p_precip", F.greatest("p_precip", F.lit(0.0))).join(clim, [*KEYS, "doy"])
        parts = []
        for v in ("tmean", "precip"):
            parts.append(t.select(*KEYS, F.lit(v).alias("var"), F.col(f"p_{v}").alias("pred"), F.col(v).alias("obs"), F.col(f"{v}_mean").alias("base")))
        return sk.scores(parts[0].unionByName(parts[1]), [*KEYS, "var"])

    def forecast(self, origins: DataFrame, horizon: int = 14) -> DataFrame:
        """Feeds predictions back for ``horizon`` days, for all origins at once.

        ``origins``: station, issue_date, t_hist, p_hist (the last 40 values, oldest first).
        Every step is one pass of both models over all origins; the plan is cut every few
        steps.
        """
        d = origins.withColumns({"_t": F.col("t_hist"), "_p": F.col("p_hist")})
        for h in range(1, horizon + 1):
            cols = harmonics(capped_doy(F.date_add("issue_date", h)))
            cols["year_frac"] = F.lit(float(self.last_year - self.first_year)) / (self.last_year - self.first_year + 1e-9)
            for n in wn.LAGS:
                cols[f"tmean_lag{n}"] = F.element_at("_t", -n)
                cols[f"precip_lag{n}"] = F.element_at("_p", -n)
            total = lambda c, n: F.aggregate(F.slice(c, -n, n), F.lit(0.0), lambda a, x: a + x)
            for n in (7, 30):
                cols[f"tmean_mean{n}"] = total("_t", n) / n
                cols[f"precip_sum{n}"] = total("_p", n)
            d = _vector(d.withColumns(cols), FEATURES)
            d = self.models["precip"].transform(self.models["tmean"].transform(d))
            d = d.withColumns({"_t": F.concat("_t", F.array("p_tmean")), "_p": F.concat("_p", F.array(F.greatest("p_precip", F.lit(0.0))))})
            d = d.drop("_x", "p_tmean", "p_precip", *FEATURES)
            if h % 5 == 0 and h < horizon:
                d = cut_lineage(d)
        steps = F.arrays_zip(F.slice("_t", -horizon, horizon).alias("tmean"), F.slice("_p", -horizon, horizon).alias("precip"))
        out = d.select(*KEYS, "issue_date", F.posexplode(steps).alias("_k", "_v"))
        return out.select(*KEYS, "issue_date", (F.col("_k") + 1).alias("lead"), "_v.tmean", "_v.precip")


def origins(obs: DataFrame, history: int = HISTORY) -> DataFrame:
    """Every day with a full history as a possible issue date, with its last values."""
    w = wn.by_date(KEYS).rowsBetween(-(history - 1), 0)
    d = obs.withColumns({"t_hist": F.collect_list("tmean").over(w), "p_hist": F.collect_list("precip").over(w)})
    return d.filter((F.size("t_hist") == history) & (F.size("p_hist") == history)).select(
        *KEYS, F.col("obs_date").alias("issue_date"), "t_hist", "p_hist"
    )


@dataclass
class DirectLeads:
    """One linear regression per lead on the last 30 standardised anomalies and the season.

    All leads share their inputs, so one aggregate holds everything: the Gram matrix of inputs and targets, to which
    every task adds its rows' part. It is solved once, for all leads together (ridge in units of the inputs' variances).
    """

    value: str
    clim: DataFrame
    back: int = 30
    horizon: int = 14
    ridge: float = 0.01

    def windows(self, obs: DataFrame) -> DataFrame:
        z = cl.standardised_anomaly(obs, self.clim, self.value)
        w = wn.by_date(KEYS)
        d = z.withColumns(
            {
                "_in": F.collect_list("z").over(w.rowsBetween(-self.back + 1, 0)),
                "_out": F.collect_list("z").over(w.rowsBetween(1, self.horizon)),
                **harmonics(F.col("doy")),
            }
        ).filter(F.size("_in") == self.back)
        return d.select(*KEYS, "obs_date", "year", "anom_sd", F.concat("_in", F.array("sin1", "cos1", F.lit(1.0))).alias("x"), "_out")

    def gram(self, rows: DataFrame) -> np.ndarray:
        """Sums of products of inputs (with the constant) and targets; ``rows`` has one array ``v`` of both."""
        n = self.back + 3 + self.horizon

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((n, n))
            for b in batches:
                m = np.asarray(b.column(0).flatten()).reshape(-1, n)
                held += m.T @ m
            yield pa.RecordBatch.from_arrays([pa.array(range(n * n), pa.int32()), pa.array(held.ravel())], names=["i", "s"])

        out = np.zeros(n * n)
        for r in rows.select("v").mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # n * n numbers
            out[r.i] = r.s
        return out.reshape(n, n)

    def fit(self, obs: DataFrame) -> DirectLeads:
        """Learns from the years up to the last three."""
        hi = obs.agg(F.max(F.year("obs_date"))).first()[0]
        self.rows = self.windows(obs).persist()
        full = self.rows.filter((F.size("_out") == self.horizon) & (F.col("year") <= hi - 3))
        g, k = self.gram(full.select(F.concat("x", "_out").alias("v"))), self.back + 3
        n = max(g[k - 1, k - 1], 1.0)
        spread = np.diag(g)[:k] - g[:k, k - 1] ** 2 / n
        self.coefficients = np.linalg.lstsq(g[:k, :k] + np.diag(self.ridge * np.maximum(spread, 0.0)), g[:k, k:], rcond=None)[0]
        return self

    def forecast(self, origins: DataFrame, horizon: int = 14) -> DataFrame:
        """(station, issue_date, lead, z, anom_sd): standardised anomaly forecasts of the issue dates ``origins``; the
        dot products are plain column arithmetic over one array."""
        leads = []
        for h in range(min(horizon, self.horizon)):
            coef = F.array(*[F.lit(float(c)) for c in self.coefficients[:, h]])
            dot = F.aggregate(F.zip_with("x", coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            leads.append(F.struct(F.lit(h + 1).alias("lead"), dot.alias("z")))
        d = self.rows.withColumnRenamed("obs_date", "issue_date").join(origins.select(*KEYS, "issue_date"), [*KEYS, "issue_date"], "left_semi")
        return d.select(*KEYS, "issue_date", "anom_sd", F.explode(F.array(*leads)).alias("_l")).select(*KEYS, "issue_date", "anom_sd", "_l.lead", "_l.z")


def unified_backtest(obs: DataFrame, clim: DataFrame, value: str, trees: BoostedTrees) -> tuple[DataFrame, DataFrame]:
    """Seven methods on the same issue dates: climatology, trend-adjusted climatology,
    damped persistence, boosted trees, direct leads, the fixed mix and the fitted blend.

    Returns (scores per station, method and lead; blend weights). Blend weights are fitted
    on the year after the training years and scored on the years after that.
    """
    split = fc.split_years(obs)
    trend = cl.leak_free_trend(obs, split, "tmean") if value == "tmean" else None
    frame = fc.backtest_frame(obs, clim, value, trend).join(split, KEYS).filter(F.col("year") > F.col("split_year"))
    frame = cut_lineage(frame)
    issue = frame.select(*KEYS, "issue_date").distinct()
    g = trees.forecast(origins(obs).join(issue, [*KEYS, "issue_date"], "left_semi")).select(*KEYS, "issue_date", "lead", F.col(value).alias("trees"))
    z = DirectLeads(value, clim).fit(obs).forecast(issue)
    d = frame.join(g, [*KEYS, "issue_date", "lead"]).join(z, [*KEYS, "issue_date", "lead"])
    floor = (lambda c: c) if value == "tmean" else (lambda c: F.greatest(c, F.lit(0.0)))
    d = d.withColumn("direct", floor(F.col("clim") + F.col("z") * F.col("anom_sd")))
    chosen = F.col("direct") if value == "tmean" else F.col("trees")
    d = cut_lineage(d.withColumn("mix", floor(0.6 * chosen + 0.4 * F.col("persist"))))
    members = ["trees", "direct", "persist"]
    val = d.filter(F.col("year") == F.col("split_year") + 1)
    weights = fc.nnls3(fc.gram(val, members, [*KEYS, "lead"]))
    test = fc.blend(d, weights, members, value).filter(F.col("year") > F.col("split_year") + 1)
    methods = ["clim", "clim_trend", "persist", "trees", "direct", "mix", "blend"]
    return sk.scores_by_lead(test, methods, KEYS), weights


# --------------------------------------------------------------------------- grid challenger
GRID_FEATURES = ["sin1", "cos1", "sin2", "cos2", "lead", "nlat", "nlon", "s", "gridmean"]


def grid_challenger(rows: DataFrame, keys: list[str], rounds: int = 10) -> DataFrame:
    """Boosted trees on the grid's issue rows, scored beside climatology (never used for the
    forecast). ``rows`` come from :func:`terraloom.operators.grid_forecast.issue_rows`."""
    mean = rows.groupBy(*keys, "issue", "lead").agg(F.avg("s").alias("gridmean"))
    d = gr.normalised_coordinates(rows, keys).join(mean, [*keys, "issue", "lead"]).withColumns(harmonics(F.col("doy")))
    d = cut_lineage(_vector(d, GRID_FEATURES).select(*keys, "lead", "fit", "y", "_x"))
    model = GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="pred", maxIter=rounds, maxDepth=4, seed=0).fit(d.filter("fit"))
    t = model.transform(d.filter("not fit"))
    return sk.scores(t.withColumn("zero", F.lit(0.0)), [*keys, "lead"], "pred", "y", "zero").select(*keys, "lead", "rmse", F.col("base_rmse").alias("clim_rmse"), "skill_pct")


# --------------------------------------------------------------------------- patch classifier
def fit_patch_scorer(patches: DataFrame, features: list[str], label: str, weight: str | None = None):
    """Multinomial logistic regression on patch features: (weights, bias, classes)."""
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, maxIter=30, family="multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    m = lr.fit(_vector(patches, features))
    return [list(map(float, r)) for r in m.coefficientMatrix.toArray()], [float(b) for b in m.interceptVector], m.numClasses


