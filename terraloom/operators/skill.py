"""Forecast and classification scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.numeric import skill_pct


def rmse(pred: Column, obs: Column) -> Column:
    e = pred - obs
    return F.sqrt(F.avg(e * e))


def mae(pred: Column, obs: Column) -> Column:
    return F.avg(F.abs(pred - obs))


def scores(pairs: DataFrame, keys: list[str], pred: str = "pred", obs: str = "obs", base: str = "base") -> DataFrame:
    """RMSE, MAE, residual spread and skill against a baseline forecast."""
    p, o, b = F.col(pred), F.col(obs), F.col(base)
    out = pairs.groupBy(*keys).agg(
        rmse(p, o).alias("rmse"), mae(p, o).alias("mae"), F.stddev_pop(o - p).alias("resid_std"),
        rmse(b, o).alias("base_rmse"), F.count(p - o).alias("n"),
    )
    return out.withColumn("skill_pct", skill_pct(F.col("rmse"), F.col("base_rmse")))


def scores_by_lead(frame: DataFrame, methods: list[str], keys: list[str], obs: str = "obs") -> DataFrame:
    """RMSE and MAE per method, over all leads (``lead`` NULL) and per lead, in one pass.

    ``methods`` are columns of ``frame``; skill is measured against the first of them.
    """
    long = frame.select(
        *keys, "lead", F.col(obs).alias("_obs"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods])).alias("_m"),
    ).select(*keys, "lead", "_obs", "_m.method", "_m.pred")
    every = [*keys, "method"]
    sets = long.groupingSets([every, [*every, "lead"]], *every, "lead").agg(
        rmse(F.col("pred"), F.col("_obs")).alias("rmse"), mae(F.col("pred"), F.col("_obs")).alias("mae")
    )
    # the grouping sets leave one row per (key, method, lead), so this window is tiny
    same = Window.partitionBy(*keys, "lead")
    base = F.max(F.when(F.col("method") == methods[0], F.col("rmse"))).over(same)
    return sets.withColumn("skill_pct", skill_pct(F.col("rmse"), base))


def best_method(scored: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """Method with the least overall RMSE (compared to 9 digits); the first listed on a tie."""
    overall = scored.filter(F.col("lead").isNull())
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    pick = F.min(F.struct(F.round("rmse", 9).alias("_r"), place.alias("_p"), "method", "rmse")).alias("_b")
    return overall.groupBy(*keys).agg(pick).select(*keys, F.col("_b.method").alias("best"), F.col("_b.rmse").alias("rmse"))


def confusion(rows: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and IoU from a confusion table."""
    keys = keys or []
    t = conf.groupBy(*keys, F.col("truth").alias("cls")).agg(F.sum("n").alias("support"))
    p = conf.groupBy(*keys, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    d = conf.filter(F.col("truth") == F.col("pred")).select(*keys, F.col("truth").alias("cls"), F.col("n").alias("tp"))
    j = t.join(p, [*keys, "cls"], "full").join(d, [*keys, "cls"], "left").fillna(0, subset=["support", "predicted", "tp"])
    tp, sup, pre = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    precision, recall = tp / (pre + F.lit(1e-9)), tp / (sup + F.lit(1e-9))
    return j.select(
        *keys, "cls", "support", "predicted", "tp",
        precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / (precision + recall + 1e-9)).alias("f1"),
        (tp / (sup + pre - tp + F.lit(1e-9))).alias("iou"),
    )


def overall_scores(per_class: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support") * 100).alias("accuracy_pct"),
        (F.avg("f1") * 100).alias("macro_f1_pct"),
        (F.avg("iou") * 100).alias("mean_iou_pct"),
    )


def majority_class(pixels: DataFrame, keys: list[str], cls: str = "cls") -> DataFrame:
    """Most frequent class of a block, the lowest code on a tie."""
    counts = pixels.groupBy(*keys, F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col("cls"))).alias("_m")).select(
        *keys, F.col("_m.cls").alias("cls")
    )


def probe_accuracy(class_map: DataFrame, probes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of accepted classes inside probe boxes.

    ``probes``: scene_id, probe, x0, y0, x1, y1 (fractions) and ``accepted`` (array of
    classes). Boxes are cut to the scene's pixel size, gathered per scene (a scene has a
    handful of boxes) and tested on each pixel; pixels are never multiplied by boxes that
    do not contain them.
    """
    boxes = probes.join(sizes, "scene_id").select(
        "scene_id",
        F.struct(
            "probe", "accepted",
            F.floor(F.col("x0") * F.col("width")).alias("xa"), F.floor(F.col("x1") * F.col("width")).alias("xb"),
            F.floor(F.col("y0") * F.col("height")).alias("ya"), F.floor(F.col("y1") * F.col("height")).alias("yb"),
        ).alias("box"),
    ).groupBy("scene_id").agg(F.collect_list("box").alias("boxes"))
    inside = lambda b: (
        (F.col("x") >= b["xa"]) & (F.col("x") < b["xb"]) & (F.col("y") >= b["ya"]) & (F.col("y") < b["yb"])
    )
    hits = class_map.join(boxes, "scene_id").withColumn("box", F.explode(F.filter("boxes", inside)))
    return hits.groupBy("scene_id", F.col("box.probe").alias("probe")).agg(
        F.avg(F.array_contains(F.col("box.accepted"), F.col("cls")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_pixels"),
    )


def composition_checks(class_pct: DataFrame, checks: DataFrame) -> DataFrame:
    """Class shares against allowed ranges (scene_id, cls, lo, hi)."""
    return checks.join(class_pct, ["scene_id", "cls"], "left").withColumn(
        "ok", F.coalesce(F.col("pct").between(F.col("lo"), F.col("hi")), F.lit(False))
    )


def promote(scored: DataFrame) -> DataFrame:
    """Champion/challenger decision: the challenger wins when its (10-class, grouped)
    accuracy pair is lexicographically greater."""
    pair = F.struct("accuracy", "grouped_accuracy")
    return scored.groupBy("task").agg(
        F.max(F.when(F.col("role") == "challenger", pair)).alias("_c"), F.max(F.when(F.col("role") == "champion", pair)).alias("_h")
    ).select("task", F.coalesce(F.col("_c") > F.col("_h"), F.col("_c").isNotNull()).alias("promote"))


def model_cards(scored: DataFrame, keys: list[str], model: str = "blend", base: str = "clim") -> DataFrame:
    """One card per key: RMSE and skill of the operational model, RMSE of the baseline and
    the skill of every member (a short map)."""
    o = scored.filter(F.col("lead").isNull())
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return o.groupBy(*keys).agg(
        pick(model, "rmse").alias("rmse"), pick(model, "skill_pct").alias("skill_pct"), pick(base, "rmse").alias("baseline_rmse"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "skill_pct")))).alias("members"),
    )
