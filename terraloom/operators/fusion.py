"""Fusing two gridded sources, and correcting a field towards point observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.numeric import clip
from terraloom.operators import climatology as cl
from terraloom.operators import grid as gr

CELL = ["lat", "lon"]


def pair_sources(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Values of both sources on shared days and cells."""
    on = [*(keys or []), "obs_date", *CELL]
    return a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on)


DAY_BITS = 22  # days since DAY_ZERO of every date that Spark can hold from year 1 to 9999
DAY_ZERO = 1 << 20


def _upto(last: Column) -> Column:
    """The blocks of doubling length that together are the axis 0..last: one for each bit of last + 1, a left block of its pair."""
    bit = lambda b: F.shiftright(last + 1, b)
    blocks = F.array(*[F.when(bit(b) % 2 == 1, F.struct(F.lit(b).alias("b"), (bit(b) - 1).alias("no"))) for b in range(DAY_BITS)])
    return F.filter(blocks, lambda x: x.isNotNull())


def _holding(at: Column) -> Column:
    """The left blocks that hold a place of the axis."""
    bit = lambda b: F.shiftright(at, b)
    blocks = F.array(*[F.when(bit(b) % 2 == 0, F.struct(F.lit(b).alias("b"), bit(b).alias("no"))) for b in range(DAY_BITS)])
    return F.filter(blocks, lambda x: x.isNotNull())


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue entries whose [start, end] ranges overlap, per left entry the best partner:
    most shared days, then the fewest days, then the newest end, then the greatest id.

    No range is paired with all that overlap it. A partner starts either up to the start of the left range or from there on;
    these starts are a few blocks of doubling length on the axis of days. In a block, the best partner that ends up to
    the left end, or from there on, is a running maximum over the ends:

    ============  ====================  ======================
    partner       ends up to left end   ends from left end on
    ============  ====================  ======================
    starts before newest end            fewest days
    starts after  longest               first start
    ============  ====================  ======================

    So the work is the number of distinct ranges times some twenty blocks, however many overlap. Partners of one range
    are interchangeable but for their days: the fewest days, then the least id. Ranges that end before they start, or lack an
    end, overlap nothing.
    """
    day = lambda c: F.unix_date(F.to_date(c, "yyyyMMdd")) + DAY_ZERO
    valid = "start_ymd <= end_ymd"
    spans = left.filter(valid).select(*keys, day("start_ymd").alias("s"), day("end_ymd").alias("e")).distinct()
    ranges = right.filter(valid).groupBy(*keys, day("start_ymd").alias("s"), day("end_ymd").alias("e")).agg(
        F.min(F.struct("days", "id")).alias("m")
    ).select(*keys, "s", "e", "m.days", "m.id")
    mirrored = F.lit((1 << DAY_BITS) - 1) - F.col("s")

    def sides(d: DataFrame, blocks, *more: str) -> DataFrame:
        both = F.array(F.struct(F.lit("before").alias("side"), blocks(F.col("s")).alias("at")), F.struct(F.lit("after").alias("side"), blocks(mirrored).alias("at")))
        d = d.select(*keys, "s", "e", *more, F.explode(both).alias("_x"))
        return d.select(*keys, "s", "e", *more, "_x.side", F.explode("_x.at").alias("_b")).select(*keys, "s", "e", *more, "side", "_b.*")

    def rank(upto: bool) -> Column:
        worth = F.when(F.col("side") == "before", F.col("e") if upto else F.lit(0)).otherwise(F.col("e") - F.col("s") if upto else -F.col("s"))
        return F.when(F.col("id").isNotNull(), F.struct(worth.alias("v"), (-F.col("days")).alias("d"), F.col("e").alias("e"), F.col("id").alias("id")))

    asked = sides(spans, _upto).withColumns({"days": F.lit(None).cast(ranges.schema["days"].dataType), "id": F.lit(None).cast(ranges.schema["id"].dataType)})
    rows = asked.unionByName(sides(ranges, _holding, "days", "id"))
    block = Window.partitionBy(*keys, "side", "b", "no")
    # rows with the same end are peers: each frame holds them all
    rows = rows.withColumns({"upto": F.max(rank(True)).over(block.orderBy("e")), "beyond": F.max(rank(False)).over(block.orderBy(F.col("e").desc()))})
    before = F.col("side") == "before"
    shared_days = {
        "upto": F.when(before, F.col("upto.v") - F.col("s")).otherwise(F.col("upto.v")),
        "beyond": F.when(before, F.col("e") - F.col("s")).otherwise(F.col("e") + F.col("beyond.v")),
    }
    found = [F.struct(n.alias("overlap"), F.col(f"{c}.d"), F.col(f"{c}.e"), F.col(f"{c}.id")) for c, n in shared_days.items()]
    some = rows.filter("id IS NULL").select(*keys, "s", "e", F.explode(F.array(*found)).alias("_f")).filter("_f.id IS NOT NULL AND _f.overlap >= 0")
    picked = some.groupBy(*keys, "s", "e").agg(F.max("_f").alias("_b"))
    ids = left.filter(valid).select(*keys, F.col("id").alias("left_id"), day("start_ymd").alias("s"), day("end_ymd").alias("e"))
    return ids.join(picked, [*keys, "s", "e"]).select(
        *keys, "left_id", F.col("_b.id").alias("right_id"), F.col("_b.overlap").alias("overlap_days")
    )


def blue_statistics(pairs: DataFrame, keys: list[str], debias: bool = True, min_pairs: int = 5) -> DataFrame:
    """Error statistics of ``a`` and ``b`` against ``truth`` and the minimum-variance weights.

    Variances and covariance come from Spark's merging central-moment aggregates, so one
    pass is enough and large offsets do not cancel. Keys with fewer than ``min_pairs``
    complete rows are left out.
    """
    ok = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("truth").isNotNull())
    e = ok.withColumns({"ea": F.col("a") - F.col("truth"), "eb": F.col("b") - F.col("truth")})
    if debias:
        moments = [F.var_pop("ea").alias("va"), F.var_pop("eb").alias("vb"), F.covar_pop("ea", "eb").alias("cab"),
                   F.avg("ea").alias("bias_a"), F.avg("eb").alias("bias_b")]
    else:
        moments = [F.avg(F.col("ea") * F.col("ea")).alias("va"), F.avg(F.col("eb") * F.col("eb")).alias("vb"),
                   F.avg(F.col("ea") * F.col("eb")).alias("cab"), F.lit(0.0).alias("bias_a"), F.lit(0.0).alias("bias_b")]
    s = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *moments,
        F.sqrt(F.avg(F.col("ea") * F.col("ea"))).alias("raw_rmse_a"), F.sqrt(F.avg(F.col("eb") * F.col("eb"))).alias("raw_rmse_b"),
    ).filter(F.col("n") >= min_pairs)
    den = F.col("va") + F.col("vb") - 2 * F.col("cab")
    w = F.when(den > 1e-9, clip((F.col("vb") - F.col("cab")) / den, 0.0, 1.0)).otherwise(F.lit(0.5))
    s = s.withColumn("w_a", w).withColumn("w_b", 1 - F.col("w_a"))
    fused_var = F.pow("w_a", F.lit(2)) * F.col("va") + F.pow("w_b", F.lit(2)) * F.col("vb") + 2 * F.col("w_a") * F.col("w_b") * F.col("cab")
    s = s.withColumns({
        "rmse_a": F.sqrt("va"), "rmse_b": F.sqrt("vb"), "rmse_fused": F.sqrt(F.greatest(fused_var, F.lit(0.0))),
        "error_corr": F.col("cab") / (F.sqrt(F.col("va") * F.col("vb")) + 1e-12),
    })
    best = F.least("rmse_a", "rmse_b")
    return s.withColumn("reduction_pct", (1 - F.try_divide(F.col("rmse_fused"), best)) * 100).drop("va", "vb", "cab")


def choose_weights(windows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Weights per key: the live (newest) window if it has statistics, else the newest
    calibration window that has, else 0.5 / 0.5 without bias.

    ``windows``: keys, window_id, window_end for every candidate; ``stats``: keys,
    window_id and the columns of :func:`blue_statistics`.
    """
    live = windows.groupBy(*keys).agg(F.max(F.struct("window_end", "window_id")).alias("_w")).select(
        *keys, F.col("_w.window_id").alias("live_id")
    )
    cols = ["w_a", "w_b", "bias_a", "bias_b", "rmse_a", "rmse_b", "rmse_fused"]
    picked = windows.join(stats, [*keys, "window_id"]).groupBy(*keys).agg(
        F.max(F.struct("window_end", "window_id", *cols)).alias("_s")
    )
    out = live.join(picked, keys, "left")
    return out.select(
        *keys, "live_id", F.col("_s.window_id").alias("weights_from"),
        F.coalesce(F.col("_s.window_id") != F.col("live_id"), F.lit(True)).alias("calibrated"),
        F.coalesce("_s.w_a", F.lit(0.5)).alias("w_a"), F.coalesce("_s.w_b", F.lit(0.5)).alias("w_b"),
        F.coalesce("_s.bias_a", F.lit(0.0)).alias("bias_a"), F.coalesce("_s.bias_b", F.lit(0.0)).alias("bias_b"),
        *[F.col(f"_s.{c}").alias(c) for c in cols[4:]],
    )


def fuse_fields(pairs: DataFrame, weights: DataFrame, clim: DataFrame, keys: list[str]) -> DataFrame:
    """Fused time-mean field: ``b`` is moved onto the bias level of ``a`` and blended by
    weight; the spread is what disagreement remains. Anomaly against the month-set normal."""
    means = pairs.groupBy(*keys, *CELL).agg(F.avg("a").alias("fa"), F.avg("b").alias("fb"))
    months = pairs.select(*keys, F.month("obs_date").alias("month"))
    normal = cl.month_set_normal(clim, months, keys, [*keys, *CELL])
    j = means.join(weights, keys).join(normal, [*keys, *CELL], "left")
    fb = F.col("fb") - (F.col("bias_b") - F.col("bias_a"))
    fused = F.col("w_a") * F.col("fa") + F.col("w_b") * fb
    return j.select(
        *keys, *CELL, fused.alias("value"), F.abs(F.col("fa") - fb).alias("spread"), (fused - F.col("normal")).alias("anomaly")
    )


def spread_summary(fused: DataFrame, keys: list[str]) -> DataFrame:
    return fused.groupBy(*keys).agg(
        F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"),
        F.min("anomaly").alias("anomaly_min"), F.max("anomaly").alias("anomaly_max"),
    )


def cressman(
    field: DataFrame, obs: DataFrame, keys: list[str], radius: float = 1.0, alpha: float = 0.6
) -> DataFrame:
    """One-pass correction of a field towards point observations (lat, lon, obs).

    Observations at one location are summed first, then each location adds its weighted
    increment to the cells within ``radius``; the sums are partial aggregates, so a dense
    cluster of observations is reduced before the shuffle. The increments are measured
    against the uncorrected field and normalised by ``max(1, sum of weights)``. An
    observation whose nearest cell is missing is skipped.
    """
    places = obs.filter(F.col("obs").isNotNull() & ~F.isnan("obs")).groupBy(*keys, *CELL).agg(
        F.sum("obs").alias("o_sum"), F.count(F.lit(1)).alias("o_n")
    )
    ax = gr.axes(field, keys)
    at = gr.nearest_cells(places, ax, keys)
    g = field.select(*keys, F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), F.col("value").alias("g"))
    at = at.join(g, [*keys, "cell_lat", "cell_lon"]).filter(F.col("g").isNotNull()).withColumn(
        "incr", F.col("o_sum") - F.col("o_n") * F.col("g")
    )
    reach = gr.within_radius(at.select(*keys, *CELL, "incr", "o_n"), ax, keys, radius)
    r2 = radius * radius
    w = (F.lit(r2) - F.col("dist2")) / (F.lit(r2) + F.col("dist2"))
    corr = reach.groupBy(*keys, F.col("g_lat").alias("_a"), F.col("g_lon").alias("_o")).agg(
        F.sum(w * F.col("incr")).alias("wi"), F.sum(w * F.col("o_n")).alias("wn")
    ).withColumnsRenamed({"_a": "lat", "_o": "lon"})
    out = field.join(corr, [*keys, *CELL], "left")
    step = F.coalesce(F.lit(alpha) * F.col("wi") / F.greatest(F.lit(1.0), F.col("wn")), F.lit(0.0))
    return out.select(*keys, *CELL, "value", (F.col("value") + step).alias("fused"))


def _replay(radius: float, alpha: float, keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lon"], kind="stable")
        lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
        g = pdf["value"].to_numpy(dtype=float).copy()
        target = pdf["obs"].to_numpy(dtype=float)
        r2 = radius * radius
        for k in range(len(g)):
            if not np.isfinite(target[k]) or not np.isfinite(g[k]):
                continue
            d2 = (lat - lat[k]) ** 2 + (lon - lon[k]) ** 2
            g = g + alpha * np.clip((r2 - d2) / (r2 + d2), 0, None) * (target[k] - g[k])
        return pdf[[*keys, "lat", "lon", "value", "obs"]].assign(fused=g)

    return run


def cressman_in_order(
    cells: DataFrame, keys: list[str], radius: float = 0.6, alpha: float = 0.5
) -> DataFrame:
    """Order-exact correction where every cell carries at most one observation ``obs``.

    Each increment is read from the already corrected grid, cell after cell, so one grid is
    a sequential recurrence. A group is one region's grid at one time step (``keys``), whose
    cell count the region registry fixes (a few thousand); the work spreads over the steps.
    """
    schema = ", ".join(
        [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]
        + ["lat double", "lon double", "value double", "obs double", "fused double"]
    )
    return cells.select(*keys, *CELL, "value", "obs").groupBy(*keys).applyInPandas(_replay(radius, alpha, keys), schema)


def surface_fusion(air: DataFrame, skin: DataFrame, keys: list[str], radius: float = 0.6, alpha: float = 0.5) -> DataFrame:
    """Skin-temperature field assimilated into the air-temperature field: the skin field is
    moved onto the air grid by nearest neighbour, then applied cell by cell in order."""
    moved = gr.resample_nearest(skin.select(*keys, *CELL, F.col("value").alias("obs")), gr.axes(air, keys), keys)
    cells = air.select(*keys, *CELL, "value").join(moved, [*keys, *CELL], "left")
    out = cressman_in_order(cells, keys, radius, alpha)
    return out.withColumn("adjustment", F.col("fused") - F.col("value"))


def adjustment_summary(fused: DataFrame, keys: list[str]) -> DataFrame:
    a = F.abs("adjustment")
    return fused.groupBy(*keys).agg(
        F.count("obs").alias("n_obs"), F.coalesce(F.avg(a), F.lit(0.0)).alias("mean_abs_adjustment"),
        F.coalesce(F.max(a), F.lit(0.0)).alias("max_abs_adjustment"),
    )
