"""Queries with fitted models (no SQL twin: their scores are checked by invariants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.operators import focal as fo
from terraloom.operators import learned as le
from terraloom.operators import scene as sc
from terraloom.operators import scorers as so
from terraloom.operators import spectral as sp
from terraloom.plans.grid_queries import K as GRID_K
from terraloom.plans.grid_queries import phi_rows
from terraloom.plans.registry import query
from terraloom.plans.scene_queries import rgb
from terraloom.plans.shape import i, r, shared
from terraloom.plans.station_queries import BASE
from terraloom.schemas import CLASSES
from terraloom.session import scratch_path
from terraloom.sources import tables as tb


def record(spark, sf):
    obs = shared(tb.daily(spark, sf))
    return obs, shared(cl.doy_climatology(obs, ["tmean", "precip"]))


@query("gbt_scores")
def gbt_scores(spark, sf):
    obs, clim = record(spark, sf)
    sc_ = le.BoostedTrees(rounds=8).fit(obs).one_step_scores(clim)
    return sc_.select("station", "var", r("rmse"), r("mae"), r("base_rmse"), r("resid_std"), r("skill_pct"), "n")


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    """Recursive 14-day forecast from the newest day of every station."""
    obs, _ = record(spark, sf)
    trees = le.BoostedTrees(rounds=8).fit(obs)
    newest = obs.groupBy("station").agg(F.max("obs_date").alias("issue_date"))
    f = trees.forecast(le.origins(obs).join(newest, ["station", "issue_date"], "left_semi"))
    return f.select("station", F.col("issue_date").cast("string").alias("issue_date"), i("lead"), r("tmean"), r("precip"))


@query(
    "direct_leads",
    f"""WITH RECURSIVE {BASE.removeprefix('WITH ')}, zs AS (SELECT station, obs_date, yr, doy, a / (stddev_pop(a) OVER (PARTITION BY station) + 1e-6) AS z
      FROM (SELECT station, obs_date, yr, doy, tmean - tmean_mean AS a FROM cal JOIN clim USING (station, doy))),
    win AS (SELECT station, obs_date, yr, list(z) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS back, list(z) OVER (w ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS ahead,
      [sin(doy * 2 * pi() / 365.25::DOUBLE), cos(doy * 2 * pi() / 365.25::DOUBLE), 1.0::DOUBLE] AS season FROM zs WINDOW w AS (PARTITION BY station ORDER BY obs_date)),
    m AS MATERIALIZED (SELECT list_concat(list_concat(back, season), ahead) AS v FROM win WHERE len(back) = 30 AND len(ahead) = 14 AND yr <= (SELECT max(yr) FROM cal) - 3),
    g AS MATERIALIZED (SELECT i.range AS i, j.range AS j, sum(v[i.range] * v[j.range]) AS s FROM m, range(1, 34) i, range(1, 48) j GROUP BY ALL),
    one AS (SELECT i, s AS mean FROM g WHERE j = 33), n AS (SELECT s AS n FROM g WHERE i = 33 AND j = 33),
    p AS (SELECT g.i, j, s + CASE WHEN g.i = j AND j < 33 THEN 0.01::DOUBLE * (s - mean * mean / n) ELSE 0 END AS s FROM g JOIN one USING (i), n),
    sol AS (SELECT 1::BIGINT AS k, list(r ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS r FROM p GROUP BY i)
      UNION ALL SELECT k + 1, list_transform(range(1, 34), lambda i: CASE WHEN i = k THEN list_transform(a[k], lambda x: x / a[k][k])
        ELSE list_transform(range(1, 48), lambda j: a[i][j] - a[i][k] * a[k][j] / a[k][k]) END) FROM sol WHERE k <= 33),
    newest AS (SELECT station, obs_date, list_concat(back, season) AS x FROM win WHERE len(back) = 30 QUALIFY row_number() OVER (PARTITION BY station ORDER BY obs_date DESC) = 1)
    SELECT station, CAST(obs_date AS VARCHAR) AS issue_date, h.range AS lead, round(list_sum(list_transform(range(1, 34), lambda i: x[i] * a[i][33 + h.range])), 3) AS z
    FROM newest, sol, range(1, 15) h WHERE k = 34""",
)
def direct_leads(spark, sf):
    """Standardised anomalies of the next 14 days from the newest day of every station."""
    obs, clim = record(spark, sf)
    newest = obs.groupBy("station").agg(F.max("obs_date").alias("issue_date"))
    f = le.DirectLeads("tmean", clim).fit(obs).forecast(newest)
    return f.select("station", F.col("issue_date").cast("string").alias("issue_date"), i("lead"), r("z", 3))


@query("unified_backtest")
def unified_backtest(spark, sf):
    obs, clim = record(spark, sf)
    trees = le.BoostedTrees(rounds=8).fit(obs)
    both = [le.unified_backtest(obs, clim, var, trees)[0].withColumn("var", F.lit(var)) for var in ("tmean", "precip")]
    return both[0].unionByName(both[1]).select("station", "var", "method", i("lead"), r("rmse"), r("mae"), r("skill_pct"))


@query("grid_challenger")
def grid_challenger(spark, sf):
    _, _, rows = phi_rows(spark, sf)
    g = le.grid_challenger(rows, GRID_K)
    return g.select("source", i("lead"), r("rmse"), r("clim_rmse"), r("skill_pct"))


@query("patch_classifier")
def patch_classifier(spark, sf):
    """Patch scorer on 8 x 8 windows with rotation averaging, back to a class map."""
    px = shared(rgb(spark, sf))
    names = ["r_mean", "r_std", "g_mean", "g_std", "b_mean", "b_std"]
    tiles = px.withColumns({"ty": F.floor(F.col("y") / 4), "tx": F.floor(F.col("x") / 4)})
    train = sc.inverse_frequency(sc.patch_features(tiles, ["scene_id", "ty", "tx", "label"]), "label")
    w, b, n = le.fit_patch_scorer(train, names, "label", "weight")
    views = fo.rotate_views(
        fo.patch_pixels(px, ["scene_id"], 8, 4).withColumns({"y": F.col("y") - F.col("py"), "x": F.col("x") - F.col("px0")}), 8
    )
    feats = sc.patch_features(views, ["scene_id", "py", "px0", "view"])
    scored = feats.select("scene_id", "py", "px0", sc.linear_scorer(w, b)(F.array(*names)).alias("p"))
    p = fo.patches_to_pixels(px, sc.mean_views(scored, ["scene_id", "py", "px0"], n), ["scene_id"], 8, 4, n)
    cls = p.withColumn("cls", sp.argmax(sp.project(F.col("p"))))
    pct = sc.class_percentages(cls)
    return pct.select("scene_id", *[F.col(c).alias(c.lower()) for c in CLASSES])


@query("promotion")
def promotion(spark, sf):
    """The tile classifier fitted on all training tiles challenges the stored one of an earlier time, when only half of the
    scenes were there. Both are scored on the held-out tiles of all scenes."""
    px = rgb(spark, sf).withColumns({"ty": F.floor(F.col("y") / 4), "tx": F.floor(F.col("x") / 4)})
    names = ["r_mean", "r_std", "g_mean", "g_std", "b_mean", "b_std"]
    tiles = sc.patch_features(px, ["scene_id", "ty", "tx", "label"]).withColumn("tile", F.concat_ws("/", "scene_id", "ty", "tx"))
    parts = shared(sc.stratified_split(tiles, "label", "tile"))
    train, store = parts.filter("split = 'train'"), scratch_path(spark, "scorers")
    for version, rows in (("half", train.filter("scene_id % 2 = 0")), ("all", train)):
        w, b, _ = le.fit_patch_scorer(rows, names, "label")
        so.save(spark, store, "tiles", version, names, w, b)
        out = so.challenge(spark, store, "tiles", version, parts.filter("split = 'test'"), "label")
    now = so.in_service(spark, store).select("task", F.col("version").alias("in_service"))
    return out.join(now, "task").select("task", "role", "version", r("accuracy"), r("grouped_accuracy"), "n", F.col("promote").cast("int").alias("promote"), "in_service")
