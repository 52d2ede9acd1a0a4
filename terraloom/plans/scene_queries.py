"""Queries over rasters: indices, masks, neighbourhoods, objects, change, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import components as co
from terraloom.operators import focal as fo
from terraloom.operators import scene as sc
from terraloom.operators import skill as sk
from terraloom.operators import spectral as sp
from terraloom.operators import triage as tr
from terraloom.plans.registry import query
from terraloom.plans.shape import i, r, shared
from terraloom.schemas import CLASSES, FINE_CLASSES
from terraloom.sources import tables as tb

K = ["scene_id"]
R = f"WITH {tb.RASTER}"
BANDS = {"green": "b0", "red": "b1", "nir": "b2", "swir": "b3"}

IDX = """idx AS (SELECT scene_id, y, x, b0 AS green, b1 AS red, b2 AS nir, b3 AS swir, abs(b0) + abs(b1) + abs(b2) + abs(b3) >= 1e-6 AS ok,
  (b0 - b2) / (b0 + b2 + 1e-6) AS ndwi, (b0 - b3) / (b0 + b3 + 1e-6) AS mndwi, (b2 - b1) / (b2 + b1 + 1e-6) AS ndvi,
  (b2 - b3) / (b2 + b3 + 1e-6) AS nbr, (b3 - b1) / (b3 + b1 + 1e-6) AS nbr2 FROM raster),
cover AS (SELECT scene_id, greatest(count(*) FILTER (WHERE ok), 1) AS n,
  100.0 * count(*) FILTER (WHERE ok AND (ndwi > 0 OR mndwi > 0)) / greatest(count(*) FILTER (WHERE ok), 1) AS water_pct,
  100.0 * count(*) FILTER (WHERE ok AND ndvi > 0.3) / greatest(count(*) FILTER (WHERE ok), 1) AS veg_pct,
  100.0 * count(*) FILTER (WHERE ok AND nbr < -0.1 AND ndvi < 0.3) / greatest(count(*) FILTER (WHERE ok), 1) AS burn_pct,
  100.0 * count(*) FILTER (WHERE ok AND swir > nir + 0.10 AND swir > 0.15 AND ndvi < 0.25) / greatest(count(*) FILTER (WHERE ok), 1) AS active_fire_pct,
  avg(ndwi) FILTER (WHERE ok) AS ndwi_mean, avg(mndwi) FILTER (WHERE ok) AS mndwi_mean, avg(ndvi) FILTER (WHERE ok) AS ndvi_mean,
  avg(nbr) FILTER (WHERE ok) AS nbr_mean, avg(nbr2) FILTER (WHERE ok) AS nbr2_mean FROM idx GROUP BY scene_id)"""
INDEX_COLS = ["water_pct", "veg_pct", "burn_pct", "active_fire_pct", "ndwi_mean", "mndwi_mean", "ndvi_mean", "nbr_mean", "nbr2_mean"]

CH = """ch AS (SELECT scene_id, y, x, label, b0 AS r, b1 AS g, b2 AS b, (b0 + b1 + b2) / 3.0 AS bright, greatest(b0, b1, b2) AS vmax,
  (greatest(b0, b1, b2) - least(b0, b1, b2)) / (greatest(b0, b1, b2) + 1e-6) AS sat, 2 * b1 - b0 - b2 AS exg FROM raster)"""
MASKS = """m1 AS (SELECT *, exg > 0.08 AS veg, bright > 0.72 AND sat < 0.18 AS snow, r > 0.68 AND r - g > 0.28 AND r - b > 0.42 AND sat > 0.45 AS fire FROM ch),
masks AS (SELECT *, sat < 0.12 AND bright > 0.45 AND bright < 0.90 AND NOT fire AND NOT snow AS smoke,
  r > g + 0.04 AND exg < -0.02 AND bright < 0.55 AND NOT fire AS burn, r > g AND g > b AND exg < 0.04 AND bright > 0.30 AND NOT snow AS bare,
  ((b >= r + 0.015 AND b + 0.01 >= g AND bright < 0.62 AND bright > 0.06) OR (bright < 0.26 AND sat < 0.35 AND exg < 0.06)
   OR (sat < 0.14 AND bright > 0.18 AND bright < 0.52 AND exg < 0.05 AND abs(r - b) < 0.06)) AND NOT snow AND NOT fire AS water FROM m1)"""
CLS = """cm AS (SELECT *, CASE WHEN b >= g AND b >= r AND b - least(r, g) > 0.02 THEN 1
   WHEN g >= r AND g - b > 0.02 AND vmax < 0.45 AND (CASE WHEN vmax = 0 THEN 0 ELSE (vmax - least(r, g, b)) / vmax END) > 0.15 THEN 0
   WHEN g >= r AND g - b > 0.02 THEN 2 WHEN r > 0.35 AND g > 0.30 AND least(r, g) - b > 0.06 AND abs(r - g) < 0.18 THEN 2
   WHEN (CASE WHEN vmax = 0 THEN 0 ELSE (vmax - least(r, g, b)) / vmax END) < 0.16 THEN 3 WHEN r >= g AND r - b > 0.04 AND r - g > 0.02 THEN 3 ELSE 4 END AS cls FROM {src})"""
PCT5 = ", ".join(f"round_even(100.0 * count(*) FILTER (WHERE cls = {k}) / count(*), 2) AS {c.lower()}" for k, c in enumerate(CLASSES))


def rgb(spark, sf):
    return tb.raster(spark, sf).withColumnsRenamed({"b0": "r", "b1": "g", "b2": "b"})


def classed(spark, sf):
    px = rgb(spark, sf)
    return px.withColumn("cls", sp.class_code(sp.colour_class(F.col("r"), F.col("g"), F.col("b"))))


def tiles(spark, sf):
    """Class map whose 4 x 4 tiles carry the vector's label folded to five classes."""
    return rgb(spark, sf).withColumn("cls", F.pmod("label", F.lit(5)).cast("int"))


def paired(px):
    """Scene 2k is the pre-event, scene 2k + 1 the post-event image of pair k."""
    half = F.floor(F.col("scene_id") / 2)
    before = px.filter(F.pmod("scene_id", F.lit(2)) == 0).withColumn("pair_id", half)
    after = px.filter(F.pmod("scene_id", F.lit(2)) == 1).withColumn("pair_id", half)
    return before, after


@query("spectral_indices", f"{R}, {IDX} SELECT scene_id, {', '.join(f'round({c}, 4) AS {c}' for c in INDEX_COLS)} FROM cover")
def spectral_indices(spark, sf):
    s = sp.index_summary(sp.with_indices(tb.raster(spark, sf), BANDS), K)
    return s.select("scene_id", *[r(c) for c in INDEX_COLS])


@query(
    "index_pixels",
    f"{R}, {IDX} SELECT scene_id, y, x, round(ndwi, 5) AS ndwi, round(ndvi, 5) AS ndvi, round(nbr, 5) AS nbr, CAST(nbr < -0.1 AND ndvi < 0.3 AND ok AS INT) AS burn FROM idx",
)
def index_pixels(spark, sf):
    d = sp.with_indices(tb.raster(spark, sf), BANDS)
    return d.select("scene_id", "y", "x", r("ndwi", 5), r("ndvi", 5), r("nbr", 5), F.col("burn").cast("int").alias("burn"))


@query(
    "ndvi_guarded",
    f"{R} SELECT scene_id, round(avg(CASE WHEN b2 + b1 = 0 THEN 0 ELSE greatest(-1, least(1, (b2 - b1) / (b2 + b1))) END), 5) AS ndvi FROM raster GROUP BY scene_id",
)
def ndvi_guarded(spark, sf):
    d = tb.raster(spark, sf).withColumn("ndvi", sp.ndvi_guarded(F.col("b2"), F.col("b1")))
    return d.groupBy("scene_id").agg(r(F.avg("ndvi"), 5, "ndvi"))


@query(
    "dnbr_severity",
    f"""{R}, {IDX} SELECT a.scene_id // 2 AS pair_id, round(round(a.nbr_mean, 3) - round(b.nbr_mean, 3), 3) AS dnbr,
      CASE WHEN round(round(a.nbr_mean, 3) - round(b.nbr_mean, 3), 3) < 0.1 THEN 'Unburned' WHEN round(round(a.nbr_mean, 3) - round(b.nbr_mean, 3), 3) < 0.27 THEN 'Low'
        WHEN round(round(a.nbr_mean, 3) - round(b.nbr_mean, 3), 3) < 0.66 THEN 'Moderate' ELSE 'High' END AS severity
      FROM cover a JOIN cover b ON a.scene_id % 2 = 0 AND b.scene_id = a.scene_id + 1""",
)
def dnbr_severity(spark, sf):
    s = sp.index_summary(sp.with_indices(tb.raster(spark, sf), BANDS), K)
    before, after = paired(s)
    return sp.dnbr(before, after, ["pair_id"])


@query(
    "band_stretch",
    f"""{R}, q AS (SELECT scene_id, quantile_cont(b2, 0.02) AS l2, quantile_cont(b2, 0.98) AS h2, quantile_cont(b1, 0.02) AS l1, quantile_cont(b1, 0.98) AS h1,
      quantile_cont(b0, 0.02) AS l0, quantile_cont(b0, 0.98) AS h0 FROM raster GROUP BY 1)
    SELECT scene_id, y, x, floor(greatest(0, least(1, (b2 - l2) / (h2 - l2 + 1e-9))) * 255) AS r, floor(greatest(0, least(1, (b1 - l1) / (h1 - l1 + 1e-9))) * 255) AS g,
      floor(greatest(0, least(1, (b0 - l0) / (h0 - l0 + 1e-9))) * 255) AS b FROM raster JOIN q USING (scene_id)""",
)
def band_stretch(spark, sf):
    d = sp.false_colour(shared(tb.raster(spark, sf)), K, BANDS)
    return d.select("scene_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in "rgb"])


MASK_NAMES = ["veg", "snow", "fire", "smoke", "burn", "bare", "water"]


@query(
    "rgb_masks",
    f"{R}, {CH}, {MASKS} SELECT scene_id, {', '.join(f'round_even(100.0 * count(*) FILTER (WHERE {m}) / count(*), 1) AS {m}_pct' for m in MASK_NAMES)} FROM masks GROUP BY scene_id",
)
def rgb_masks(spark, sf):
    return sp.mask_percentages(sp.with_disaster_masks(rgb(spark, sf)), K)


@query("colour_classes", f"{R}, {CH}, {CLS.format(src='ch')} SELECT scene_id, {PCT5}, round(100 * (0.6 + 0.35 * avg(CAST(cls <> 4 AS DOUBLE))), 1) AS confidence FROM cm GROUP BY scene_id")
def colour_classes(spark, sf):
    s = sc.scene_summary(shared(classed(spark, sf)))
    return s.select("scene_id", *[F.col(c).alias(c.lower()) for c in CLASSES], "confidence")


@query(
    "pixel_features",
    f"""{R} SELECT scene_id, round(avg(greatest(-1, least(1, 2 * b1 - b0 - b2)) * 0.8), 5) AS exg, round(avg(greatest(-1, least(1, b2 - (b0 + b1) / 2)) * 0.8), 5) AS blue,
      round(avg(0.299 * b0 + 0.587 * b1 + 0.114 * b2), 5) AS grey FROM raster GROUP BY scene_id""",
)
def pixel_features(spark, sf):
    cols = [F.col(c) for c in "rgb"]
    d = rgb(spark, sf).withColumns({"f": sp.pixel_features(*cols), "grey": sp.grey(*cols)})
    return d.groupBy("scene_id").agg(r(F.avg(F.element_at("f", 4)), 5, "exg"), r(F.avg(F.element_at("f", 5)), 5, "blue"), r(F.avg("grey"), 5, "grey"))


LAB = """lin AS (SELECT scene_id, y, x, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g,
  CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM ch),
xyz AS (SELECT scene_id, y, x, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS xx, 0.212671 * r + 0.715160 * g + 0.072169 * b AS yy, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS zz FROM lin),
ff AS (SELECT *, CASE WHEN xx > 0.008856 THEN pow(xx, 1.0 / 3) ELSE 7.787 * xx + 16.0 / 116 END AS fx, CASE WHEN yy > 0.008856 THEN pow(yy, 1.0 / 3) ELSE 7.787 * yy + 16.0 / 116 END AS fy,
  CASE WHEN zz > 0.008856 THEN pow(zz, 1.0 / 3) ELSE 7.787 * zz + 16.0 / 116 END AS fz FROM xyz),
lab AS (SELECT scene_id, y, x, (CASE WHEN yy > 0.008856 THEN 116 * pow(yy, 1.0 / 3) - 16 ELSE 903.3 * yy END) * 255 / 100 AS ll, 500 * (fx - fy) + 128 AS aa, 200 * (fy - fz) + 128 AS bb FROM ff)"""
# the opening of a mask: erosion then dilation over the pixels inside the raster
OPEN3 = """er AS (SELECT p.scene_key, p.y, p.x, min(q.m) AS m FROM msk p JOIN msk q ON p.scene_key = q.scene_key AND q.y BETWEEN p.y - {k} AND p.y + {k} AND q.x BETWEEN p.x - {k} AND p.x + {k} GROUP BY ALL),
op AS (SELECT p.scene_key, p.y, p.x, max(q.m) AS m FROM er p JOIN er q ON p.scene_key = q.scene_key AND q.y BETWEEN p.y - {k} AND p.y + {k} AND q.x BETWEEN p.x - {k} AND p.x + {k} GROUP BY ALL)"""
CHANGE = f"""{R}, {CH}, {LAB}, tiles AS (SELECT *, CAST(label % 5 AS INT) AS cls FROM ch),
msk AS (SELECT p.scene_id // 2 AS scene_key, p.y, p.x, p.cls AS fc, q.cls AS tc,
   CAST((CASE WHEN p.cls = 2 THEN 0 ELSE p.cls END) <> (CASE WHEN q.cls = 2 THEN 0 ELSE q.cls END)
     AND sqrt(pow(a.ll - c.ll, 2) + pow(a.aa - c.aa, 2) + pow(a.bb - c.bb, 2)) > 14 AS INT) AS m
  FROM tiles p JOIN tiles q ON p.scene_id % 2 = 0 AND q.scene_id = p.scene_id + 1 AND p.y = q.y AND p.x = q.x
  JOIN lab a ON a.scene_id = p.scene_id AND a.y = p.y AND a.x = p.x JOIN lab c ON c.scene_id = q.scene_id AND c.y = q.y AND c.x = q.x),
{OPEN3.format(k=1)}, chg AS (SELECT op.scene_key AS pair_id, op.m, fc, tc FROM op JOIN msk USING (scene_key, y, x))"""


def change_pairs(spark, sf):
    before, after = paired(tiles(spark, sf))
    return sc.changed_pixels(before, after, ["pair_id"])


@query("change_percent", f"{CHANGE} SELECT pair_id, round_even(100.0 * sum(m) / count(*), 2) AS changed_percent FROM chg GROUP BY pair_id")
def change_percent(spark, sf):
    return sc.change_percent(change_pairs(spark, sf), ["pair_id"])


@query(
    "change_transitions",
    f"""{CHANGE}, n AS (SELECT pair_id, fc, tc, count(*) AS n FROM chg WHERE m = 1 GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY pair_id) AS tot FROM n)
    SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, fc, tc) AS rank, {CLASSES}[fc + 1] AS "from", {CLASSES}[tc + 1] AS "to", round_even(100.0 * n / tot, 1) AS pct
    FROM t WHERE fc <> tc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, fc, tc) <= 5""",
)
def change_transitions(spark, sf):
    return sc.transitions(change_pairs(spark, sf), ["pair_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "class_deltas",
    f"""{R}, {CH}, {CLS.format(src='ch')}, p AS (SELECT scene_id, {PCT5} FROM cm GROUP BY scene_id)
    SELECT a.scene_id // 2 AS pair_id, {', '.join(f'round(b.{c.lower()} - a.{c.lower()}, 2) AS {c.lower()}' for c in CLASSES)}
    FROM p a JOIN p b ON a.scene_id % 2 = 0 AND b.scene_id = a.scene_id + 1""",
)
def class_deltas(spark, sf):
    before, after = paired(sc.class_percentages(classed(spark, sf)))
    d = sc.class_deltas(before, after, ["pair_id"])
    return d.select("pair_id", *[F.col(c).alias(c.lower()) for c in CLASSES])


# --------------------------------------------------------------------------- probabilities
PROB = """pr AS (SELECT vec_id, label, [exp(4 * CAST(v AS DOUBLE)) FOR v IN embedding[1:10]] AS e FROM embeddings),
pn AS (SELECT vec_id, label, [v / list_sum(e) FOR v IN e] AS p FROM pr),
p5 AS (SELECT vec_id, label, p, [p[2], p[9] + p[10], p[1] + p[3] + p[6] + p[7], p[4] + p[5] + p[8], 0.0] AS q FROM pn)"""


def probabilities(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    raw = F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(4 * v.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "label", raw.alias("e")).select("vec_id", "label", F.transform("e", lambda v: v / total).alias("p"))


@query(
    "prob_projection",
    f"WITH {PROB} SELECT vec_id, {', '.join(f'round(q[{k + 1}], 5) AS {c.lower()}' for k, c in enumerate(CLASSES))}, list_position(q, list_max(q)) - 1 AS cls, round(list_max(q), 5) AS confidence FROM p5",
)
def prob_projection(spark, sf):
    d = probabilities(spark, sf).withColumn("q", sp.project(F.col("p")))
    return d.select(
        "vec_id", *[r(F.element_at("q", k + 1), 5, c.lower()) for k, c in enumerate(CLASSES)], sp.argmax(F.col("q")).alias("cls"), r(F.array_max("q"), 5, "confidence")
    )


PRED = f"""WITH {PROB}, pp AS (SELECT CAST(label AS INT) AS truth, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred FROM p5),
conf AS (SELECT truth, pred, count(*) AS n FROM pp GROUP BY ALL)"""


def predictions(spark, sf):
    return probabilities(spark, sf).select(F.col("label").alias("truth"), sp.argmax(F.col("p")).alias("pred"))


@query("confusion_matrix", f"{PRED} SELECT truth, pred, n FROM conf")
def confusion_matrix(spark, sf):
    return sk.confusion(predictions(spark, sf), "truth", "pred")


@query(
    "class_scores",
    f"""{PRED}, t AS (SELECT truth AS cls, sum(n) AS support FROM conf GROUP BY 1), p AS (SELECT pred AS cls, sum(n) AS predicted FROM conf GROUP BY 1),
    j AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce((SELECT n FROM conf c WHERE c.truth = coalesce(t.cls, p.cls) AND c.pred = c.truth), 0) AS tp FROM t FULL JOIN p ON t.cls = p.cls)
    SELECT cls, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, round(tp / (predicted + 1e-9), 5) AS precision, round(tp / (support + 1e-9), 5) AS recall,
      round(2 * (tp / (predicted + 1e-9)) * (tp / (support + 1e-9)) / ((tp / (predicted + 1e-9)) + (tp / (support + 1e-9)) + 1e-9), 5) AS f1, round(tp / (support + predicted - tp + 1e-9), 5) AS iou FROM j""",
)
def class_scores(spark, sf):
    s = sk.class_scores(shared(sk.confusion(predictions(spark, sf), "truth", "pred")))
    return s.select("cls", i("support"), i("tp"), r("precision", 5), r("recall", 5), r("f1", 5), r("iou", 5))


@query(
    "accuracy_summary",
    f"""{PRED}, t AS (SELECT truth AS cls, sum(n) AS s FROM conf GROUP BY 1), p AS (SELECT pred AS cls, sum(n) AS q FROM conf GROUP BY 1), d AS (SELECT truth AS cls, n AS tp FROM conf WHERE truth = pred),
    j AS (SELECT coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(tp, 0) AS tp FROM t FULL JOIN p USING (cls) LEFT JOIN d USING (cls)),
    m AS (SELECT *, tp / (q + 1e-9) AS pr, tp / (s + 1e-9) AS rc FROM j)
    SELECT round(sum(tp) / sum(s) * 100, 4) AS accuracy_pct, round(avg(2 * pr * rc / (pr + rc + 1e-9)) * 100, 4) AS macro_f1_pct, round(avg(tp / (s + q - tp + 1e-9)) * 100, 4) AS mean_iou_pct FROM m""",
)
def accuracy_summary(spark, sf):
    s = sk.overall_scores(sk.class_scores(shared(sk.confusion(predictions(spark, sf), "truth", "pred"))))
    return s.select(r("accuracy_pct"), r("macro_f1_pct"), r("mean_iou_pct"))


@query(
    "majority_blocks",
    f"""{R}, {CH}, {CLS.format(src='ch')}, n AS (SELECT scene_id, y // 8 AS ty, x // 8 AS tx, cls, count(*) AS n FROM cm GROUP BY ALL)
    SELECT DISTINCT ON (scene_id, ty, tx) scene_id, ty, tx, cls FROM n ORDER BY scene_id, ty, tx, n DESC, cls""",
)
def majority_blocks(spark, sf):
    px = classed(spark, sf).withColumns({"ty": F.floor(F.col("y") / 8), "tx": F.floor(F.col("x") / 8)})
    return sk.majority_class(px, ["scene_id", "ty", "tx"])


def probe_table(scenes):
    """Four quadrant probes per scene, accepting Forest and Agriculture."""
    spots = [("q0", 0.0, 0.0, 0.5, 0.5), ("q1", 0.5, 0.0, 1.0, 0.5), ("q2", 0.0, 0.5, 0.5, 1.0), ("q3", 0.25, 0.25, 0.75, 0.75)]
    arr = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("probe", "x0", "y0", "x1", "y1"), s)]) for s in spots])
    return scenes.select("scene_id", F.explode(arr).alias("p")).select("scene_id", "p.*", F.array(F.lit(0), F.lit(2)).alias("accepted"))


@query(
    "probe_accuracy",
    f"""{R}, {CH}, {CLS.format(src='ch')}, pb(probe, x0, y0, x1, y1) AS (VALUES ('q0', 0, 0, 20, 20), ('q1', 20, 0, 40, 20), ('q2', 0, 20, 20, 40), ('q3', 10, 10, 30, 30))
    SELECT scene_id, probe, round(avg(CAST(cls IN (0, 2) AS DOUBLE)), 5) AS accuracy, count(*) AS n_pixels FROM cm JOIN pb ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""",
)
def probe_accuracy(spark, sf):
    px = shared(classed(spark, sf))
    size = fo.sizes(px, K)
    return sk.probe_accuracy(px, probe_table(size), size).select("scene_id", "probe", r("accuracy", 5), "n_pixels")


@query(
    "composition_checks",
    f"""{R}, {CH}, {CLS.format(src='ch')} SELECT scene_id, c.cls, CAST(round_even(100.0 * count(*) FILTER (WHERE cm.cls = c.cls) / count(*), 2) BETWEEN 10 AND 40 AS INT) AS ok
      FROM cm CROSS JOIN (VALUES (0), (1), (3)) c(cls) GROUP BY scene_id, c.cls""",
)
def composition_checks(spark, sf):
    pct = sc.class_percentages(classed(spark, sf))
    long = pct.select("scene_id", F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).alias("pct")) for k, c in enumerate(CLASSES)])).alias("v")).select("scene_id", "v.*")
    checks = pct.select("scene_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("cls"), F.lit(10.0).alias("lo"), F.lit(40.0).alias("hi"))
    return sk.composition_checks(long, checks).select("scene_id", "cls", F.col("ok").cast("int").alias("ok"))


# --------------------------------------------------------------------------- neighbourhoods
REFLECT = """refl AS (SELECT scene_id, v.y, v.x, t.k AS ty, u.k AS tx FROM (SELECT scene_id, y, x FROM raster) v, range(-{r}, 40 + {r}) t(k), range(-{r}, 40 + {r}) u(k)
  WHERE v.y = (CASE WHEN t.k < 0 THEN -t.k WHEN t.k > 39 THEN 78 - t.k ELSE t.k END) AND v.x = (CASE WHEN u.k < 0 THEN -u.k WHEN u.k > 39 THEN 78 - u.k ELSE u.k END))"""


@query(
    "box_heterogeneity",
    f"""{R}, ay AS (SELECT t.k AS ty, CASE WHEN t.k < 0 THEN -t.k WHEN t.k > 39 THEN 78 - t.k ELSE t.k END AS s FROM range(-5, 45) t(k)),
    py AS (SELECT scene_id, ty AS y, x, b0, b1, b2 FROM raster JOIN ay ON y = s),
    pp AS (SELECT scene_id, y, ty AS x, b0, b1, b2 FROM py JOIN ay ON x = s),
    rx AS (SELECT scene_id, y, x, sum(b0) OVER w AS s0, sum(b1) OVER w AS s1, sum(b2) OVER w AS s2, sum(b0 * b0) OVER w AS q0, sum(b1 * b1) OVER w AS q1, sum(b2 * b2) OVER w AS q2 FROM pp
      WINDOW w AS (PARTITION BY scene_id, y ORDER BY x ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    ry AS (SELECT scene_id, y, x, sum(s0) OVER w / 121 AS s0, sum(s1) OVER w / 121 AS s1, sum(s2) OVER w / 121 AS s2, sum(q0) OVER w / 121 AS q0, sum(q1) OVER w / 121 AS q1, sum(q2) OVER w / 121 AS q2 FROM rx
      WINDOW w AS (PARTITION BY scene_id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
    SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round((sqrt(greatest(q0 - s0 * s0, 0)) + sqrt(greatest(q1 - s1 * s1, 0)) + sqrt(greatest(q2 - s2 * s2, 0))) / 3, 5) AS het
    FROM ry WHERE y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 39""",
)
def box_heterogeneity(spark, sf):
    return fo.heterogeneity(rgb(spark, sf), K, 11).select("scene_id", "y", "x", r("het", 5))


MSK = f"{R}, msk AS (SELECT scene_id AS scene_key, y, x, CAST(label % 5 < 3 AND b0 > 0.2 AS INT) AS m FROM raster), {OPEN3.format(k=1)}"


def mask_px(spark, sf):
    m = ((F.pmod("label", F.lit(5)) < 3) & (F.col("b0") > 0.2)).cast("int")
    return tb.raster(spark, sf).select("scene_id", "y", "x", m.alias("m"))


@query("morph_open", f"{MSK} SELECT scene_key AS scene_id, y, x, m FROM op")
def morph_open(spark, sf):
    return fo.opened(mask_px(spark, sf), K, ["m"], 3)


@query(
    "morph_close",
    f"""{R}, msk AS (SELECT scene_id AS scene_key, y, x, CAST(label % 5 < 3 AND b0 > 0.2 AS INT) AS m FROM raster), {OPEN3.format(k=2).replace('min(q.m)', 'MX').replace('max(q.m)', 'min(q.m)').replace('MX', 'max(q.m)')}
    SELECT scene_key AS scene_id, y, x, m FROM op""",
)
def morph_close(spark, sf):
    return fo.closed(mask_px(spark, sf), K, ["m"], 5)


def _line_sql(dy: int, dx: int, k: int = 3) -> str:
    steps = f"range(-{k}, {k + 1}) s(k)"
    return f"""e_{dy}_{abs(dx)}{'n' if dx < 0 else ''} AS (SELECT p.scene_key, p.y, p.x, min(q.m) AS m FROM msk p, {steps} JOIN msk q ON p.scene_key = q.scene_key AND q.y = p.y + s.k * {dy} AND q.x = p.x + s.k * ({dx}) GROUP BY ALL),
o_{dy}_{abs(dx)}{'n' if dx < 0 else ''} AS (SELECT p.scene_key, p.y, p.x, max(q.m) AS m FROM e_{dy}_{abs(dx)}{'n' if dx < 0 else ''} p, {steps} JOIN e_{dy}_{abs(dx)}{'n' if dx < 0 else ''} q ON p.scene_key = q.scene_key AND q.y = p.y + s.k * {dy} AND q.x = p.x + s.k * ({dx}) GROUP BY ALL)"""


@query(
    "line_open",
    f"""{R}, msk AS (SELECT scene_id AS scene_key, y, x, CAST(label % 5 < 3 AND b0 > 0.2 AS INT) AS m FROM raster), {_line_sql(0, 1)}, {_line_sql(1, 0)}, {_line_sql(1, 1)}, {_line_sql(1, -1)}
    SELECT scene_key AS scene_id, y, x, max(m) AS line FROM (FROM o_0_1 UNION ALL FROM o_1_0 UNION ALL FROM o_1_1 UNION ALL FROM o_1_1n) GROUP BY ALL""",
)
def line_open(spark, sf):
    return fo.line_opened(mask_px(spark, sf), K, "m", 7).select("scene_id", "y", "x", "line")


@query(
    "median5",
    f"""{R}, {CH}, {CLS.format(src='ch')}, sh AS (SELECT a.k AS dy, b.k AS dx FROM range(-2, 3) a(k), range(-2, 3) b(k)),
    nb AS (SELECT p.scene_id, p.y, p.x, least(39, greatest(0, p.y + dy)) AS qy, least(39, greatest(0, p.x + dx)) AS qx FROM cm p, sh)
    SELECT nb.scene_id, nb.y, nb.x, list_sort(list(q.cls))[13] AS cls FROM nb JOIN cm q ON q.scene_id = nb.scene_id AND q.y = qy AND q.x = qx GROUP BY ALL""",
)
def median5(spark, sf):
    return fo.median(classed(spark, sf).select("scene_id", "y", "x", "cls"), K, "cls")


@query(
    "density_blur",
    f"""{R}, ay AS (SELECT t.k AS t, CASE WHEN t.k < 0 THEN -t.k WHEN t.k > 39 THEN 78 - t.k ELSE t.k END AS s FROM range(-10, 50) t(k)),
    pp AS (SELECT scene_id, a.t AS y, b.t AS x, CAST(b0 > 0.5 AS INT) AS m FROM raster JOIN ay a ON y = a.s JOIN ay b ON x = b.s),
    rx AS (SELECT scene_id, y, x, sum(m) OVER (PARTITION BY scene_id, y ORDER BY x ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS s FROM pp),
    ry AS (SELECT scene_id, y, x, sum(s) OVER (PARTITION BY scene_id, x ORDER BY y ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 441 AS d FROM rx)
    SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(d, 5) AS density FROM ry WHERE y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 39""",
)
def density_blur(spark, sf):
    px = tb.raster(spark, sf).withColumn("m", F.col("b0") > 0.5)
    return fo.density(px, K, {"d": "m"}, 21).select("scene_id", "y", "x", r("d", 5, "density"))


@query(
    "area_resize",
    f"{R} SELECT scene_id, y // 4 AS y, x // 4 AS x, round(avg(b0), 5) AS b0 FROM raster GROUP BY scene_id, y // 4, x // 4",
)
def area_resize(spark, sf):
    return fo.resize_area(tb.raster(spark, sf), K, ["b0"], 10).select("scene_id", "y", "x", r("b0", 5))


@query(
    "patch_overlap",
    f"""{R}, oy(o) AS (VALUES (0), (12), (16)), pt AS (SELECT scene_id, a.o AS py, b.o AS px0, avg(b0) AS f FROM raster JOIN oy a ON y >= a.o AND y < a.o + 24 JOIN oy b ON x >= b.o AND x < b.o + 24 GROUP BY ALL)
    SELECT scene_id, y, x, round(avg(f), 5) AS p FROM raster JOIN pt USING (scene_id) WHERE y >= py AND y < py + 24 AND x >= px0 AND x < px0 + 24 GROUP BY ALL""",
)
def patch_overlap(spark, sf):
    """Patch scores (here the mean of a band) averaged back onto the pixels they cover."""
    px = shared(tb.raster(spark, sf))
    pt = fo.patch_pixels(px, K, 24, 12).groupBy("scene_id", "py", "px0").agg(F.array(F.avg("b0")).alias("p"))
    return fo.patches_to_pixels(px, pt, K, 24, 12, n=1).select("scene_id", "y", "x", r(F.element_at("p", 1), 5, "p"))


# --------------------------------------------------------------------------- components
def _reach(opened: bool) -> str:
    src = "op" if opened else "msk"
    return f"""fg AS (SELECT scene_key, y, x FROM {src} WHERE m = 1),
edge AS (SELECT a.scene_key, a.y, a.x, b.y AS y2, b.x AS x2 FROM fg a JOIN fg b ON a.scene_key = b.scene_key AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
reach AS (SELECT scene_key, y, x, y AS ry, x AS rx FROM fg UNION SELECT r.scene_key, e.y2, e.x2, r.ry, r.rx FROM reach r JOIN edge e ON e.scene_key = r.scene_key AND e.y = r.y AND e.x = r.x),
comp AS (SELECT scene_key, y, x, min(ry * 1000 + rx) AS c FROM reach GROUP BY ALL)"""


CMASK = f"WITH RECURSIVE {tb.RASTER}, msk AS (SELECT scene_id AS scene_key, y, x, CAST(label % 5 = 1 AND b0 > 0.1 AS INT) AS m FROM raster), {OPEN3.format(k=1)}"


def comp_px(spark, sf):
    m = (F.pmod("label", F.lit(5)) == 1) & (F.col("b0") > 0.1)
    return tb.raster(spark, sf).select("scene_id", "y", "x", m.alias("mask"))


@query(
    "components",
    f"""{CMASK}, {_reach(False)} SELECT scene_key AS scene_id, CAST(min(x) AS BIGINT) AS bx, CAST(min(y) AS BIGINT) AS "by", CAST(max(x) - min(x) + 1 AS BIGINT) AS bw, CAST(max(y) - min(y) + 1 AS BIGINT) AS bh, count(*) AS area FROM comp GROUP BY scene_key, c""",
)
def components(spark, sf):
    b = co.boxes(co.label(comp_px(spark, sf), K), K)
    return b.select("scene_id", "bx", "by", "bw", "bh", "area")


@query(
    "blob_boxes",
    f"""{CMASK}, {_reach(True)}, bx AS (SELECT scene_key AS scene_id, min(c) AS c, CAST(min(x) AS BIGINT) AS bx, CAST(min(y) AS BIGINT) AS "by", CAST(max(x) - min(x) + 1 AS BIGINT) AS bw, CAST(max(y) - min(y) + 1 AS BIGINT) AS bh, count(*) AS area FROM comp GROUP BY scene_key, c)
    SELECT scene_id, bx, "by", bw, bh, round(area / (bw * bh), 5) AS purity FROM bx WHERE area >= 0.004 * 1600 AND bw / bh BETWEEN 0.3 AND 3
    QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY bw * bh DESC, c) <= 6""",
)
def blob_boxes(spark, sf):
    b = co.blob_boxes(comp_px(spark, sf), K, "mask", 0.004, aspect=(0.3, 3.0), limit=6)
    return b.select("scene_id", "bx", "by", "bw", "bh", r("purity", 5))


# names of the evidence in SQL
SHOWN = {"p forest": "pf", "p soft": "ps", "green share": "gf", "built share": "md", "support": "su", "r-g": "r - g", "r-b": "r - b", "g-b": "g - b", "g-r": "g - r", "b-r": "b - r", "b-g": "b - g"}


def sql_holds(tests) -> str:
    return "(" + " AND ".join(f"({SHOWN.get(n, n)}) {op} {value}::DOUBLE" for n, op, value in tests) + ")"


def _box(src: str, out: str, columns: list[str], size: int) -> str:
    """Means over a square of 40 x 40 scenes, mirrored at the border."""
    near = "least(({v} + d + 780) % 78, 78 - ({v} + d + 780) % 78)"
    line = lambda name, of, axis, other: (
        f"""{name} AS (SELECT p.scene_id, p.y, p.x, {', '.join(f'avg(q.{c}) AS {c}' for c in columns)} FROM {of} p, range(-{size // 2}, {size // 2 + 1}) t(d)
  JOIN {of} q ON q.scene_id = p.scene_id AND q.{other} = p.{other} AND q.{axis} = {near.format(v='p.' + axis)} GROUP BY ALL)"""
    )
    return f"{line(out + '_x', src, 'x', 'y')}, {line(out, out + '_x', 'y', 'x')}"


def _square(src: str, out: str, fn: str, radius: int, column: str = "m") -> str:
    w = lambda part, order: f"OVER (PARTITION BY scene_id, {part} ORDER BY {order} RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    return f"""{out}_x AS (SELECT scene_id, y, x, {fn}({column}) {w('y', 'x')} AS m FROM {src}), {out} AS (SELECT scene_id, y, x, {fn}(m) {w('x', 'y')} AS m FROM {out}_x)"""


def _regions(src: str, out: str) -> str:
    """Pixels with the smallest number of their region: steps along touching pixels."""
    return f"""{out}_f AS MATERIALIZED (SELECT scene_id, y, x FROM {src} WHERE m = 1),
{out}_e AS MATERIALIZED (SELECT a.scene_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM {out}_f a JOIN {out}_f b ON a.scene_id = b.scene_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
{out}_r AS (SELECT scene_id, y, x, y * 1000 + x AS c, 0 AS k FROM {out}_f
  UNION ALL SELECT e.scene_id, e.y2, e.x2, min(r.c), any_value(r.k) + 1 FROM {out}_r r JOIN {out}_e e ON e.scene_id = r.scene_id AND e.y = r.y AND e.x = r.x WHERE r.k < 400 GROUP BY e.scene_id, e.y2, e.x2),
{out}_c AS MATERIALIZED (SELECT scene_id, y, x, c FROM {out}_r WHERE k = 400)"""


def _towns(src: str, out: str, share: float) -> str:
    """Pixels of regions of at least that share of a scene."""
    return f"""{_regions(src, out)},
{out} AS (SELECT scene_id, y, x FROM {out}_c JOIN (SELECT scene_id, c FROM {out}_c GROUP BY ALL HAVING count(*) >= {share} * 1600) USING (scene_id, c))"""


def _median5(src: str, out: str) -> str:
    return f"""{out} AS (SELECT p.scene_id, p.y, p.x, list_sort(list(q.cls))[13] AS cls FROM {src} p, range(-2, 3) t(dy), range(-2, 3) u(dx)
  JOIN {src} q ON q.scene_id = p.scene_id AND q.y = least(39, greatest(0, p.y + dy)) AND q.x = least(39, greatest(0, p.x + dx)) GROUP BY ALL)"""



def _line(part: str, order: str) -> str:
    w = f"OVER (PARTITION BY scene_id, {part} ORDER BY {order} ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING)"
    return f"SELECT scene_id, y, x, max(e) {w} AS m FROM (SELECT scene_id, y, x, min(m) {w} AS e FROM cand)"


_RULES = ", ".join(f"({k}, '{name}', {', '.join(f'{float(v)}::DOUBLE' for v in rule)})" for k, (name, _, *rule) in enumerate(co.OBJECT_RULES))
_AREAS = " UNION ALL ".join(
    f"SELECT scene_id * 10 + {k} AS scene_id, y, x, CAST(label % 5 = {sp.CODE[cls]}{' AND vmax > 0.48::DOUBLE' if name == 'Building' else ''} AS INT) AS m FROM px" for k, (name, cls, *_) in enumerate(co.OBJECT_RULES)
)
_BOXES = """CAST(min(x) AS BIGINT) AS bx, CAST(min(y) AS BIGINT) AS "by", CAST(max(x) - min(x) + 1 AS BIGINT) AS bw, CAST(max(y) - min(y) + 1 AS BIGINT) AS bh, count(*) AS area"""
OBJECTS = f"""WITH RECURSIVE {tb.RASTER}, px AS MATERIALIZED (SELECT scene_id, y, x, label, greatest(b0, b1, b2) AS vmax, 0.299::DOUBLE * b0 + 0.587::DOUBLE * b1 + 0.114::DOUBLE * b2 AS grey,
  (greatest(b0, b1, b2) - least(b0, b1, b2)) / (greatest(b0, b1, b2) + 1e-6::DOUBLE) AS sat FROM raster),
ar AS ({_AREAS}), {_square('ar', 'ao', 'min', 1)}, {_square('ao', 'aq', 'max', 1)}, {_regions('aq', 'area')},
rules(id, label, lo, hi, a0, a1, most, base, per, cap, pure) AS (VALUES {_RULES}),
ab AS (SELECT scene_id // 10 AS scene, scene_id % 10 AS id, c, {_BOXES} FROM area_c GROUP BY ALL),
af AS (SELECT * FROM ab JOIN rules USING (id) WHERE area BETWEEN lo * 1600 AND hi * 1600 AND bw / bh BETWEEN a0 AND a1
  QUALIFY row_number() OVER (PARTITION BY scene, id ORDER BY bw * bh DESC, c) <= most),
cand AS MATERIALIZED (SELECT scene_id, y, x, CAST(grey > 0.15::DOUBLE AND grey < 0.52::DOUBLE AND sat < 0.22::DOUBLE AS INT) AS m FROM px),
ln AS (SELECT scene_id, y, x, max(m) AS m FROM ({_line('y', 'x')} UNION ALL {_line('x', 'y')} UNION ALL {_line('x + y', 'x')} UNION ALL {_line('x - y', 'x')}) GROUP BY ALL),
{_square('cand', 'b1', 'min', 13)}, {_square('b1', 'b2', 'max', 13)},
rd AS (SELECT scene_id, y, x, CAST(ln.m > 0 AND b2.m = 0 AS INT) AS m FROM ln JOIN b2 USING (scene_id, y, x)),
{_square('rd', 'r1', 'max', 2)}, {_square('r1', 'r2', 'min', 2)}, {_square('r2', 'r3', 'min', 1)}, {_square('r3', 'r4', 'max', 1)}, {_regions('r4', 'road')},
rb AS (SELECT scene_id, c, {_BOXES} FROM road_c GROUP BY ALL)"""


@query(
    "objects",
    f"""{OBJECTS} SELECT scene AS scene_id, label, bx, "by", bw, bh, round(least(cap, base + per * (area / (bw * bh))), 1) AS confidence FROM af WHERE area / (bw * bh) >= pure
  UNION ALL SELECT scene_id, 'Road', bx, "by", bw, bh, round(least(96, 60 + area / 1600 * 400), 1) FROM rb WHERE area >= 0.0003 * 1600 AND greatest(bw, bh) / (least(bw, bh) + 1e-6::DOUBLE) >= 1.8""",
)
def objects(spark, sf):
    """Objects of every rule."""
    px = shared(sp.with_channels(tiles(spark, sf)).withColumn("grey", sp.grey(F.col("r"), F.col("g"), F.col("b"))))
    return co.area_objects(px, K).unionByName(co.road_objects(px, K))


_S = {n: sql_holds(t) for n, t in sc.SURFACES.items()}
_MADE = f"(({_S['grey']} OR {_S['red roof']}) AND NOT {_S['brown soil']} AND {_S['mid light']})"
_SOFT, _WHITE = _S["vegetation"], f"({_S['bright white']} AND NOT {_S['vegetation']})"
_WET = f"({_S['blue']} AND NOT {_SOFT} AND NOT {_WHITE})"
TEXTURE = f"""WITH RECURSIVE {tb.RASTER}, ch AS MATERIALIZED (SELECT scene_id, y, x, b0 AS r, b1 AS g, b2 AS b, greatest(b0, b1, b2) AS vmax,
  (greatest(b0, b1, b2) - least(b0, b1, b2)) / (greatest(b0, b1, b2) + 1e-6::DOUBLE) AS sat, 2 * b1 - b0 - b2 AS exg, b2 - (b0 + b1) / 2.0::DOUBLE AS blue,
  b0 AS m0, b1 AS m1, b2 AS m2, b0 * b0 AS q0, b1 * b1 AS q1, b2 * b2 AS q2 FROM raster),
{_box('ch', 'bm', ['m0', 'm1', 'm2', 'q0', 'q1', 'q2'], 21)},
rough AS (SELECT ch.* EXCLUDE (m0, m1, m2, q0, q1, q2), (sqrt(greatest(bm.q0 - bm.m0 * bm.m0, 0)) + sqrt(greatest(bm.q1 - bm.m1 * bm.m1, 0)) + sqrt(greatest(bm.q2 - bm.m2 * bm.m2, 0))) / 3 AS het
  FROM ch JOIN bm USING (scene_id, y, x)),
surf AS MATERIALIZED (SELECT scene_id, y, x, CASE WHEN {_WET} THEN 1 WHEN {_S['forest']} THEN 0 WHEN {_SOFT} THEN 2 ELSE 4 END AS cls,
  CAST({_MADE} AND {_S['rough']} AND NOT ({_WET} OR {_SOFT} OR {_WHITE}) AS INT) AS m FROM rough),
{_square('surf', 'o1', 'min', 3)}, {_square('o1', 'o2', 'max', 3)}, {_square('o2', 'c1', 'max', 4)}, {_square('c1', 'c2', 'min', 4)},
{_towns('c2', 'town', sc.TOWN_MIN)},
put AS MATERIALIZED (SELECT s.scene_id, s.y, s.x, CASE WHEN t.y IS NOT NULL THEN 3 ELSE s.cls END AS cls FROM surf s LEFT JOIN town t USING (scene_id, y, x)),
{_median5('put', 'cm')}"""


@query(
    "texture_segment",
    f"""{TEXTURE} SELECT scene_id, {PCT5}, round(100 * (0.6 + 0.35 * avg(CAST(cls <> 4 AS DOUBLE))), 1) AS confidence FROM cm GROUP BY scene_id""",
)
def texture_segment(spark, sf):
    s = sc.scene_summary(shared(sc.texture_segment(rgb(spark, sf))))
    return s.select("scene_id", *[F.col(c).alias(c.lower()) for c in CLASSES], "confidence")


def sql_any(rules) -> str:
    return "(" + " OR ".join(sql_holds(r) for r in rules) + ")"


_G = {n: (sql_any if isinstance(t[0], list) else sql_holds)(t) for n, t in sc.GUARDS.items()}
_FIVE = ", ".join(" + ".join(["0::DOUBLE", *(f"p10[{k + 1}]" for k, (_, app) in enumerate(FINE_CLASSES) if app == c)]) for c in CLASSES)
_P = {n: f"p10[{sp.FINE[n] + 1}]" for n in ("Highway", "Industrial", "Residential")}
HYBRID = f"""{TEXTURE[:TEXTURE.index('surf AS MATERIALIZED')]}
ex AS (SELECT vec_id, list_transform(embedding[1:10], lambda v: exp(8 * v::DOUBLE)) AS e FROM embeddings),
pr AS (SELECT vec_id // 100 AS scene_id, (vec_id % 100) // 10 AS ty, vec_id % 10 AS tx, list_transform(e, lambda v: v / list_sum(e)) AS p10 FROM ex),
p5 AS (SELECT scene_id, ty, tx, p10, [{_FIVE}] AS p FROM pr),
h0 AS MATERIALIZED (SELECT rough.*, p[1] AS pf, p[1] + p[3] AS ps, list_position(p, list_max(p)) - 1 AS first,
  list_position([p[1], -1, p[3], -1, p[5]], list_max([p[1], -1, p[3], -1, p[5]])) - 1 AS second, {_P['Industrial']} > {_P['Residential']} + {_P['Highway']} AS works,
  {_P['Residential']} + {_P['Highway']} + {_P['Industrial']} AS support FROM rough JOIN p5 ON p5.scene_id = rough.scene_id AND ty = y // 4 AND tx = x // 4),
h1 AS MATERIALIZED (SELECT *, {_G['green']} AS green, {_G['canopy']} AS canopy, CAST({_G['white']} AND NOT {_G['green']} AS DOUBLE) AS white FROM h0),
{_box('h1', 'bw', ['white'], 41)},
h2 AS MATERIALIZED (SELECT h1.*, h1.white = 1 AND bw.white > {sc.SNOW_FIELD} AS snow, CAST(h1.white = 1 AND bw.white > {sc.SNOW_FIELD} AS DOUBLE) AS sn FROM h1 JOIN bw USING (scene_id, y, x)),
{_box('h2', 'bs', ['sn'], 41)},
h3 AS MATERIALIZED (SELECT h2.* EXCLUDE (sn), bs.sn > {sc.SNOW_NEAR} AS snowy FROM h2 JOIN bs USING (scene_id, y, x)),
h4 AS MATERIALIZED (SELECT *, CASE WHEN (first = 1 AND ({_G['no water']} OR snow)) OR (first = 3 AND ({_G['no town']} OR snow OR (works AND snowy))) THEN second ELSE first END AS c0,
  {_G['clear water']} AND NOT green AND NOT snow AND NOT canopy AS clear, CAST({_G['deep water']} AND NOT snow AS INT) AS m,
  CAST({_MADE} AND NOT green AND NOT snow AS DOUBLE) AS made FROM h3),
{_towns('h4', 'lake', sc.LAKE_MIN)},
h5 AS MATERIALIZED (SELECT h4.* EXCLUDE (m), clear OR lake.y IS NOT NULL AS water, CASE WHEN clear OR lake.y IS NOT NULL THEN 1 ELSE c0 END AS c1 FROM h4 LEFT JOIN lake USING (scene_id, y, x)),
h6 AS MATERIALIZED (SELECT *, CAST((green OR canopy) AND c1 <> 1 AS DOUBLE) AS lf FROM h5),
{_box('h6', 'bg', ['lf'], 201)}, {_box('h6', 'bt', ['made', 'support'], 31)},
h7 AS MATERIALIZED (SELECT h6.*, bg.lf AS gf, bt.made AS md, bt.support AS su FROM h6 JOIN bg USING (scene_id, y, x) JOIN bt USING (scene_id, y, x)),
h8 AS MATERIALIZED (SELECT *, CASE WHEN snow OR (c1 IN (0, 2) AND NOT (green OR canopy) AND {_G['bare']}) THEN 4 ELSE c1 END AS c2 FROM h7),
bu AS MATERIALIZED (SELECT scene_id, y, x, CAST({_G['town']} AND NOT snowy AND c2 <> 1 AS INT) AS m FROM h8),
{_square('bu', 'k1', 'max', 4)}, {_square('k1', 'k2', 'min', 4)}, {_towns('k2', 'city', sc.TOWN_MIN)},
put AS MATERIALIZED (SELECT s.scene_id, s.y, s.x, CASE WHEN t.y IS NOT NULL AND NOT water THEN 3 ELSE c2 END AS cls FROM h8 s LEFT JOIN city t USING (scene_id, y, x)),
{_median5('put', 'cm')}"""


@query("hybrid_segment", f"""{HYBRID} SELECT scene_id, {PCT5} FROM cm GROUP BY scene_id""")
def hybrid_segment(spark, sf):
    """Model probabilities: a softmax over the tile's first ten numbers (one vector = one tile)."""
    v = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(8 * x.cast("double")))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    vec = tb.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 100).alias("scene_id"), F.floor(F.pmod("vec_id", F.lit(100)) / 10).alias("_ty"), F.pmod("vec_id", F.lit(10)).alias("_tx"),
        F.transform(v, lambda x: x / total).alias("p10"),
    )
    px = rgb(spark, sf).withColumns({"_ty": F.floor(F.col("y") / 4), "_tx": F.floor(F.col("x") / 4).cast("bigint")})
    pct = sc.class_percentages(sc.hybrid_segment(px.join(vec, ["scene_id", "_ty", "_tx"]).drop("_ty", "_tx")))
    return pct.select("scene_id", *[F.col(c).alias(c.lower()) for c in CLASSES])


# --------------------------------------------------------------------------- triage
FEAT = f"""{CH}, {MASKS}, {CLS.format(src='masks')},
f0 AS (SELECT scene_id, {', '.join(f'round_even(100.0 * count(*) FILTER (WHERE {m}) / count(*), 1) AS {m}_pct' for m in ['snow', 'burn', 'bare', 'fire', 'smoke', 'water'])}, {PCT5} FROM cm GROUP BY scene_id),
feat AS (SELECT scene_id, snow_pct, burn_pct, bare_pct, fire_pct, smoke_pct, round(greatest(water, water_pct), 1) AS water, forest + agriculture AS veg, urban, others FROM f0)"""
DET = """pr AS (SELECT a.*, b.water AS pw, b.veg AS pv, a.water - b.water AS dw, a.veg - b.veg AS dv, a.bare_pct - b.bare_pct AS db, a.burn_pct - b.burn_pct AS dburn,
    greatest(a.bare_pct, CASE WHEN a.snow_pct < 10 THEN a.others ELSE 0 END) AS bl FROM feat a JOIN feat b ON a.scene_id % 2 = 1 AND b.scene_id = a.scene_id - 1),
det AS (
  SELECT scene_id, 'Active fire / wildfire' AS type, 'fire' AS family, 0 AS ord, greatest(0, least(0.97, 0.60 + fire_pct / 5)) AS conf, fire_pct AS area FROM pr WHERE fire_pct > 0.10
  UNION ALL SELECT scene_id, 'Flood / standing water', 'flood', 1, greatest(0, least(0.9, 0.35 + water / 90)), water FROM pr WHERE water > 18 AND NOT pw > 12
  UNION ALL SELECT scene_id, 'Snow / avalanche terrain', 'snow', 2, greatest(0, least(0.92, 0.4 + snow_pct / 100)), snow_pct FROM pr WHERE snow_pct > 22
  UNION ALL SELECT scene_id, 'Drought / vegetation stress', 'drought', 3, greatest(0, least(0.88, 0.35 + (bl - 28) / 90)), bl FROM pr WHERE veg < 16 AND water < 6 AND bl > 28
  UNION ALL SELECT scene_id, 'Wildfire / burn scar', 'burn', 4, greatest(0, least(0.85, 0.3 + burn_pct / 60)), burn_pct FROM pr WHERE burn_pct > 10
  UNION ALL SELECT scene_id, 'Flood (post-event rise)', 'flood', 5, greatest(0, least(0.97, 0.5 + dw / 60)), dw FROM pr WHERE dw > 6
  UNION ALL SELECT scene_id, 'Landslide / land loss', 'landslide', 6, greatest(0, least(0.95, 0.4 + abs(dv) / 50)), abs(dv) FROM pr WHERE dv < -8 AND db > 4
  UNION ALL SELECT scene_id, 'Wildfire burn scar (post-event)', 'burn', 7, greatest(0, least(0.9, 0.42 + dburn / 30)), dburn FROM pr WHERE dburn > 4 AND dv < -4
  UNION ALL SELECT scene_id, 'Active fire (SWIR-confirmed)', 'fire', 8, least(0.98, 0.65 + round(active_fire_pct, 1) / 30), round(active_fire_pct, 1) FROM pr JOIN cover USING (scene_id) WHERE round(active_fire_pct, 1) > 1
  UNION ALL SELECT scene_id, 'Flood (NDWI-confirmed)', 'flood', 9, least(0.98, 0.6 + round(water_pct, 1) / 80), round(water_pct, 1) FROM pr JOIN cover USING (scene_id) WHERE round(water_pct, 1) > 15
  UNION ALL SELECT scene_id, 'Wildfire (NBR-confirmed)', 'fire', 10, least(0.95, 0.5 + round(cover.burn_pct, 1) / 50), round(cover.burn_pct, 1) FROM pr JOIN cover USING (scene_id) WHERE round(cover.burn_pct, 1) > 8),
best AS (SELECT DISTINCT ON (scene_id, family) scene_id, family, type, round(conf, 2) AS confidence, round(area, 1) AS affected_area_pct, ord FROM det ORDER BY scene_id, family, round(conf, 2) DESC, ord)"""


def triage_inputs(spark, sf):
    """Post-event scenes with the scene before them as the baseline."""
    px = shared(classed(spark, sf))
    before, after = paired(px)
    before = before.withColumn("scene_id", F.col("scene_id") + 1)
    spectral = sp.index_summary(sp.with_indices(tb.raster(spark, sf), BANDS), K)
    return before.drop("pair_id"), after.drop("pair_id"), spectral


@query(
    "scene_features",
    f"{R}, {FEAT} SELECT scene_id, snow_pct, burn_pct, bare_pct, fire_pct, smoke_pct, water, round(veg, 2) AS veg, urban, others FROM feat",
)
def scene_features(spark, sf):
    f = tr.scene_features(sp.with_disaster_masks(classed(spark, sf)))
    return f.select("scene_id", "snow_pct", "burn_pct", "bare_pct", "fire_pct", "smoke_pct", "water", r("veg", 2), "urban", "others")


@query("detections_best", f"{R}, {IDX}, {FEAT}, {DET} SELECT scene_id, family, type, confidence, affected_area_pct FROM best")
def detections_best(spark, sf):
    before, after, spectral = triage_inputs(spark, sf)
    feats = lambda d: tr.scene_features(sp.with_disaster_masks(d))
    flagged = tr.rule_flags(tr.with_baseline(feats(after), feats(before), K))
    best = tr.strongest(tr.detections(flagged, K, spectral))
    return best.select("scene_id", "family", "type", "confidence", "affected_area_pct")


@query(
    "triage",
    f"""{R}, {IDX}, {FEAT}, {DET},
    top AS (SELECT DISTINCT ON (scene_id) scene_id, type, confidence FROM best ORDER BY scene_id, confidence DESC, ord),
    ag AS (SELECT scene_id, round(max(affected_area_pct), 1) AS a, bool_or(contains(lower(type), 'fire')) AS fire, count(*) AS n FROM best GROUP BY 1),
    sv AS (SELECT scene_id, a, n, fire, CASE WHEN a >= 35 THEN 'Severe' WHEN a >= 15 THEN 'High' WHEN a >= 5 THEN 'Moderate' ELSE 'Low' END AS s FROM ag),
    imp AS (SELECT cm.scene_id, cls = 3 AS urban, (fire_pct > 0.10 AND cm.fire) OR (fire_pct > 0.10 AND smoke_pct > 3 AND cm.smoke) OR (pr.water > 18 AND NOT pw > 12 AND (cls = 1 OR cm.water))
        OR (snow_pct > 22 AND cm.snow) OR (pr.veg < 16 AND pr.water < 6 AND bl > 28 AND (cm.bare OR (cls = 4 AND NOT cm.snow))) OR (burn_pct > 10 AND cm.burn)
        OR (dw > 6 AND cls = 1) OR (dv < -8 AND db > 4 AND cm.bare) OR (dburn > 4 AND dv < -4 AND cm.burn) AS impact FROM cm JOIN pr USING (scene_id)),
    ex AS (SELECT scene_id, round_even(100.0 * count(*) FILTER (WHERE impact) / count(*), 1) AS impact_pct, round_even(100.0 * count(*) FILTER (WHERE urban) / count(*), 1) AS builtup_pct, round_even(100.0 * count(*) FILTER (WHERE urban AND impact) / count(*), 1) AS builtup_in_impact_pct FROM imp GROUP BY 1)
    SELECT pr.scene_id, coalesce(type, 'No disaster signature') AS "primary", confidence, coalesce(a, 0) AS affected_area_pct,
      coalesce(CASE WHEN fire AND s IN ('Low', 'Moderate') THEN 'High' ELSE s END, 'None') AS severity, coalesce(n, 0) AS n_detections, impact_pct, builtup_pct, builtup_in_impact_pct
    FROM pr LEFT JOIN top USING (scene_id) LEFT JOIN sv USING (scene_id) LEFT JOIN ex USING (scene_id)""",
)
def triage(spark, sf):
    before, after, spectral = triage_inputs(spark, sf)
    t = tr.triage(after, before, K, spectral)
    return t.select(
        "scene_id", "primary", "confidence", "affected_area_pct", "severity", "n_detections", "impact_pct", "builtup_pct", "builtup_in_impact_pct"
    )


@query(
    "stratified_split",
    "SELECT label, count(*) AS n, CAST(floor(0.8 * count(*)) AS BIGINT) AS n_train, CAST(floor(0.1 * count(*)) AS BIGINT) AS n_val FROM embeddings GROUP BY label",
)
def stratified_split(spark, sf):
    d = sc.stratified_split(tb.table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return d.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val")
    )


@query("class_weights", "SELECT label, round(1.0 / count(*), 6) AS weight FROM embeddings GROUP BY label")
def class_weights(spark, sf):
    w = sc.inverse_frequency(tb.table(spark, sf, "embeddings").select("vec_id", "label"), "label")
    return w.groupBy("label").agg(r(F.max("weight"), 6, "weight"))
