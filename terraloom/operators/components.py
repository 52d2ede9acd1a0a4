"""Connected regions of masks (8-neighbourhood) and the objects built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators import focal as fo
from terraloom.operators import tiles as ti
from terraloom.operators.spectral import CODE
from terraloom.session import cut_lineage

def _parts(fg: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Foreground pixels with ``node``, the number of the first pixel of their part of the tile."""
    schema = f"{ti.key_types(fg, keys)}, y bigint, x bigint, node bigint"

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        y, x = (np.asarray(rows.column(c)) for c in ("y", "x"))
        y0, x0 = y.min(), x.min()
        mask = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
        mask[y - y0, x - x0] = True
        part, first = ti.united(mask)
        number = (first // mask.shape[1] + y0) * ti.LINE + first % mask.shape[1] + x0
        return rows.select([*keys, "y", "x"]).append_column("node", pa.array(number[part[y - y0, x - x0] - 1]))

    d = fg.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    return ti.with_tile(d, tile).groupBy(*keys, "ty", "tx").applyInArrow(work, schema)


def _round(e: DataFrame, keys: list[str]) -> DataFrame:
    """One large-star and one small-star step. Every edge keeps a > b.

    Minima are partial aggregates joined back on the node; the aggregate side holds one row
    per node, so a node with very many neighbours is split by the adaptive skew join.
    """
    both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    m = both.groupBy(*keys, "a").agg(F.min("b").alias("_m"))
    large = both.join(m, [*keys, "a"]).filter(F.col("b") > F.col("a")).select(
        *keys, F.col("b").alias("a"), F.least("_m", "a").alias("b")
    ).distinct()
    m2 = large.groupBy(*keys, "a").agg(F.min("b").alias("_m"))
    j = large.join(m2, [*keys, "a"])
    keep = j.select(*keys, "a", F.col("_m").alias("b"))
    push = j.filter(F.col("b") > F.col("_m")).select(*keys, F.col("b").alias("a"), F.col("_m").alias("b"))
    return keep.unionByName(push).distinct()


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of every node with an edge (keys, a, b), a > b; root is the smallest node it reaches.

    Alternating large-star / small-star contraction. Each round is written to the shared checkpoint folder, so
    lost executors do not restart the loop and the plan does not grow; it stops when the edge set no longer changes.
    """
    e = cut_lineage(edges)

    def digest(d: DataFrame) -> tuple:
        h = F.xxhash64(*d.columns).cast("decimal(38,0)")
        return tuple(d.agg(F.count(F.lit(1)), F.sum(h)).first())

    seen, now = None, digest(e)
    while now != seen and now[0]:
        e = cut_lineage(_round(e, keys))
        seen, now = now, digest(e)
    own = e.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)


def label(mask_px: DataFrame, keys: list[str], mask: str = "mask", tile: int = ti.TILE) -> DataFrame:
    """Foreground pixels with ``comp``, the number of their component (its first pixel, line by line).

    Pixels are united inside their tile; only the graph of parts that touch across tile borders is contracted.
    """
    parts = ti.written(_parts(mask_px.filter(F.col(mask)), keys, tile), "parts")
    rim = lambda v: (F.col(v) % tile == 0) | (F.col(v) % tile == tile - 1)
    found = roots(ti.touching(parts.filter(rim("y") | rim("x")), keys, tile), keys)
    return parts.join(found, [*keys, "node"], "left").select(*keys, "y", "x", F.coalesce("root", "node").alias("comp"))


def big_regions(mask_px: DataFrame, keys: list[str], mask: str, min_frac: float) -> DataFrame:
    """Pixels of components that cover at least ``min_frac`` of their scene."""
    total = mask_px.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    comps = label(mask_px, keys, mask)
    big = comps.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("_n")).join(total, keys)
    big = big.filter(F.col("_n") >= F.lit(min_frac) * F.col("_total")).select(*keys, "comp")
    return comps.join(big, [*keys, "comp"], "left_semi").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


def boxes(comps: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box, area, aspect and purity of each component."""
    b = comps.groupBy(*keys, "comp").agg(
        F.min("x").alias("bx"), F.min("y").alias("by"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.count(F.lit(1)).alias("area"),
    )
    return b.withColumns(
        {"box_area": F.col("bw") * F.col("bh"), "aspect": F.col("bw") / F.col("bh"), "purity": F.col("area") / (F.col("bw") * F.col("bh"))}
    )


def largest(found: DataFrame, keys: list[str], limit: int | Column) -> DataFrame:
    """The ``limit`` largest boxes per key (ties by component number). A report of at most
    twenty objects per scene, as a feature; boxes are few next to pixels."""
    w = Window.partitionBy(*keys).orderBy(F.col("box_area").desc(), "comp")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def blob_boxes(
    px: DataFrame, keys: list[str], mask: str, min_area: float, max_area: float = 1.0,
    aspect: tuple[float, float] = (0.0, 1e9), limit: int = 20,
) -> DataFrame:
    """Opened, labelled and filtered regions; areas are shares of the scene."""
    work = px.select(*keys, "y", "x", F.col(mask).cast("int").alias("_m"))
    clean = fo.opened(work, keys, ["_m"], 3).withColumn("mask", F.col("_m") > 0)
    total = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    found = boxes(label(clean, keys), keys).join(total, keys)
    ok = F.col("area").between(F.lit(min_area) * F.col("total"), F.lit(max_area) * F.col("total"))
    return largest(found.filter(ok & F.col("aspect").between(*aspect)), keys, limit)


# Label, class, smallest and largest share of the scene, aspect range, limit,
# confidence base, confidence per purity, confidence cap, least purity.
OBJECT_RULES = [
    ("Building", "Urban", 0.0009, 0.02, 0.45, 2.4, 15, 58.0, 40.0, 98.0, 0.55),
    ("Water Body", "Water", 0.004, 1.0, 0.0, 1e9, 6, 60.0, 39.0, 99.0, 0.0),
    ("Vegetation", "Forest", 0.008, 1.0, 0.0, 1e9, 8, 58.0, 41.0, 99.0, 0.0),
    ("Farmland", "Agriculture", 0.01, 1.0, 0.0, 1e9, 6, 56.0, 43.0, 99.0, 0.0),
]


def area_objects(px: DataFrame, keys: list[str]) -> DataFrame:
    """Buildings, water bodies, vegetation and farmland from a class map ``cls`` and the
    largest channel ``vmax``.

    The four masks are opened together and labelled in one run with the object label as a
    further key, instead of one pass per label.
    """
    masks = {}
    for name, cls, *_ in OBJECT_RULES:
        m = F.col("cls") == CODE[cls]
        masks[f"_{name}"] = (m & (F.col("vmax") > 0.48) if name == "Building" else m).cast("int")
    work = fo.opened(px.withColumns(masks).select(*keys, "y", "x", *masks), keys, list(masks), 3)
    stacked = work.select(
        *keys, "y", "x", F.explode(F.array(*[F.struct(F.lit(m[1:]).alias("label"), F.col(m).alias("m")) for m in masks])).alias("_s")
    ).select(*keys, "y", "x", "_s.label", (F.col("_s.m") > 0).alias("mask"))
    by = [*keys, "label"]
    total = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    found = boxes(label(stacked.filter("mask"), by), by).join(total, keys)
    rule = None
    for name, _, lo, hi, a0, a1, limit, base, per, cap, pure in OBJECT_RULES:
        v = F.struct(*[F.lit(float(n)).alias(k) for k, n in zip(("lo", "hi", "a0", "a1", "limit", "base", "per", "cap", "pure"), (lo, hi, a0, a1, limit, base, per, cap, pure))])
        rule = F.when(F.col("label") == name, v) if rule is None else rule.when(F.col("label") == name, v)
    found = found.withColumn("_r", rule).filter(
        F.col("area").between(F.col("_r.lo") * F.col("total"), F.col("_r.hi") * F.col("total"))
        & F.col("aspect").between(F.col("_r.a0"), F.col("_r.a1"))
    )
    top = largest(found, by, F.col("_r.limit")).filter(F.col("purity") >= F.col("_r.pure"))
    conf = F.round(F.least(F.col("_r.cap"), F.col("_r.base") + F.col("_r.per") * F.col("purity")), 1)
    return top.select(*by, "bx", "by", "bw", "bh", conf.alias("confidence"))


def road_objects(px: DataFrame, keys: list[str], line: int = 27) -> DataFrame:
    """Roads: grey surfaces that survive a line opening but not a square one; elongated."""
    cand = px.select(
        *keys, "y", "x", ((F.col("grey") > 0.15) & (F.col("grey") < 0.52) & (F.col("sat") < 0.22)).cast("int").alias("_c")
    )
    lines = fo.line_opened(cand, keys, "_c", line)
    blob = fo.opened(lines.withColumn("_b", F.col("_c")), keys, ["_b"], line)
    road = blob.withColumn("_r", ((F.col("line") > 0) & (F.col("_b") == 0)).cast("int"))
    road = fo.opened(fo.closed(road, keys, ["_r"], 5), keys, ["_r"], 3).withColumn("mask", F.col("_r") > 0)
    total = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    found = boxes(label(road, keys), keys).join(total, keys)
    elong = F.greatest("bw", "bh") / (F.least("bw", "bh") + 1e-6)
    conf = F.round(F.least(F.lit(96.0), 60 + F.col("area") / F.col("total") * 400), 1)
    return found.filter((F.col("area") >= 0.0003 * F.col("total")) & (elong >= 1.8)).select(
        *keys, F.lit("Road").alias("label"), "bx", "by", "bw", "bh", conf.alias("confidence")
    )


def object_counts(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
