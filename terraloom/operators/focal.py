"""Neighbourhood operators on dense rasters (keys, y, x).

Everything is separable: one pass along the rows, one along the columns, each a window
whose partition is a single raster line. A raster of N pixels thus never puts more than a
line into one window, also when one scene holds a third of all pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.groupBy(*keys).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count(F.lit(1)).alias("n_pixels")
    )


def _line(keys: list[str], axis: str) -> Window:
    return Window.partitionBy(*keys, "y" if axis == "x" else "x").orderBy(axis)


def _padded(px: DataFrame, keys: list[str], axis: str, radius: int, border: str) -> DataFrame:
    """Copies of the border pixels outside the line; ``_in`` marks the real pixels.

    ``reflect`` mirrors without repeating the edge pixel, ``replicate`` repeats the edge.
    """
    a = F.col(axis)
    last = F.max(axis).over(Window.partitionBy(*keys, "y" if axis == "x" else "x"))
    d = px.withColumn("_last", last)
    end = F.col("_last")
    if border == "reflect":
        near = F.array_compact(F.array(F.when((a >= 1) & (a <= radius), -a), F.when((a <= end - 1) & (a >= end - radius), 2 * end - a), a))
        # a reach beyond the whole line: mirrored again and again with the period 2 * end
        times = F.ceil((radius + end) / F.greatest(2 * end, F.lit(1))).cast("int")
        shifts = F.sequence(-times, times)
        both = F.concat(F.transform(shifts, lambda k: a + 2 * k * end), F.transform(shifts, lambda k: 2 * k * end - a))
        far = F.array_distinct(F.filter(both, lambda p: (p >= -radius) & (p <= end + radius)))
        alone = F.sequence(F.lit(-radius), F.lit(radius))
        kind = f"array<{px.schema[axis].dataType.simpleString()}>"
        at = F.explode(F.when(end == 0, alone.cast(kind)).when(end >= radius, near.cast(kind)).otherwise(far.cast(kind)))
    else:
        low = F.when(a == 0, F.sequence(F.lit(-radius), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        high = F.when(a == end, F.sequence((end + 1).cast("int"), (end + radius).cast("int"))).otherwise(F.array().cast("array<int>"))
        at = F.explode(F.concat(low, F.array(a.cast("int")), high))
    d = d.withColumn("_at", at)
    return d.withColumn("_in", F.col("_at") == a).withColumn(axis, F.col("_at")).drop("_at", "_last")


def box_mean(px: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """Mean over a ``size`` x ``size`` box, mirrored at the border.

    Running sums make the cost per pixel independent of the box size.
    """
    radius = size // 2
    out = px
    for axis in ("x", "y"):
        w = _line(keys, axis)
        d = _padded(out, keys, axis, radius, "reflect")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({f"_s_{c}": F.sum(c).over(run) for c in columns})
        d = d.withColumns(
            {c: (F.lead(f"_s_{c}", radius).over(w) - F.coalesce(F.lag(f"_s_{c}", radius + 1).over(w), F.lit(0.0))) / size for c in columns}
        )
        out = d.filter("_in").drop("_in", *[f"_s_{c}" for c in columns])
    return out


def heterogeneity(px: DataFrame, keys: list[str], size: int = 21, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Adds ``het``: the mean over the channels of the local standard deviation."""
    work = px.withColumns({f"_m_{c}": F.col(c).cast("double") for c in channels}).withColumns(
        {f"_q_{c}": F.col(c).cast("double") * F.col(c) for c in channels}
    )
    names = [f"_m_{c}" for c in channels] + [f"_q_{c}" for c in channels]
    m = box_mean(work, keys, names, size)
    total = F.lit(0.0)
    for c in channels:
        total = total + F.sqrt(F.greatest(F.col(f"_q_{c}") - F.col(f"_m_{c}") * F.col(f"_m_{c}"), F.lit(0.0)))
    return m.withColumn("het", total / len(channels)).drop(*names)


def density(px: DataFrame, keys: list[str], masks: dict[str, str], size: int) -> DataFrame:
    """Neighbourhood share of masks: ``masks`` maps output names to mask columns."""
    work = px.withColumns({o: F.col(m).cast("double") for o, m in masks.items()})
    return box_mean(work, keys, list(masks), size)


def _extreme(px: DataFrame, keys: list[str], columns: list[str], size: int, axis: str, fn) -> DataFrame:
    radius = size // 2
    w = _line(keys, axis).rowsBetween(-radius, radius)
    return px.withColumns({c: fn(F.col(c)).over(w) for c in columns})


def erode(px: DataFrame, keys: list[str], columns: list[str], size: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Square erosion; pixels outside the raster are ignored."""
    for a in axes:
        px = _extreme(px, keys, columns, size, a, F.min)
    return px


def dilate(px: DataFrame, keys: list[str], columns: list[str], size: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    for a in axes:
        px = _extreme(px, keys, columns, size, a, F.max)
    return px


def opened(px: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """Opening; the two column passes share one shuffle because the axes commute."""
    return dilate(erode(px, keys, columns, size, ("x", "y")), keys, columns, size, ("y", "x"))


def closed(px: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    return erode(dilate(px, keys, columns, size, ("x", "y")), keys, columns, size, ("y", "x"))


def line_opened(px: DataFrame, keys: list[str], mask: str, length: int = 27, out: str = "line") -> DataFrame:
    """Union of openings by line segments at 0, 45, 90 and 135 degrees."""
    radius = length // 2
    d = px.withColumns({"_sum": F.col("x") + F.col("y"), "_diff": F.col("x") - F.col("y")})
    lines = {"_l0": ("y", "x"), "_l90": ("x", "y"), "_l45": ("_sum", "x"), "_l135": ("_diff", "x")}
    for name, (part, order) in lines.items():
        w = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(-radius, radius)
        d = d.withColumn("_e", F.min(mask).over(w)).withColumn(name, F.max("_e").over(w)).drop("_e")
    return d.withColumn(out, F.greatest(*lines)).drop("_sum", "_diff", *lines)


def median(px: DataFrame, keys: list[str], column: str, size: int = 5, out: str | None = None) -> DataFrame:
    """Square median (odd size) with repeated border pixels; at most size^2 values are
    gathered per pixel."""
    radius = size // 2
    d = px.withColumn("_v", F.array(F.col(column)))
    for axis in ("x", "y"):
        w = _line(keys, axis).rowsBetween(-radius, radius)
        d = _padded(d, keys, axis, radius, "replicate")
        d = d.withColumn("_v", F.flatten(F.collect_list("_v").over(w))).filter("_in").drop("_in")
    return d.withColumn(out or column, F.element_at(F.array_sort("_v"), size * size // 2 + 1)).drop("_v")


def resize_area(px: DataFrame, keys: list[str], columns: list[str], max_dim: int) -> DataFrame:
    """Area-weighted downscale so that the longer side is at most ``max_dim``.

    A source pixel is copied to the (at most four, for a downscale) target pixels it
    overlaps; the weighted sums are partial aggregates.
    """
    dims = sizes(px, keys)
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest("height", "width"))
    dims = dims.withColumn("_s", scale).withColumns(
        {"_th": F.greatest(F.lit(1), F.floor(F.col("height") * F.col("_s"))), "_tw": F.greatest(F.lit(1), F.floor(F.col("width") * F.col("_s")))}
    )
    d = px.join(dims.select(*keys, "height", "width", "_th", "_tw"), keys)

    def reach(v: str, n: str, t: str) -> tuple[Column, Column, Column]:
        f = F.col(t) / F.col(n)
        a, b = F.col(v) * f, (F.col(v) + 1) * f
        first = F.floor(a + 1e-9)
        last = F.least(F.col(t) - 1, F.ceil(b - 1e-9) - 1)
        return a, b, F.sequence(first, F.greatest(first, last))

    for v, n, t in (("y", "height", "_th"), ("x", "width", "_tw")):
        a, b, seq = reach(v, n, t)
        d = d.withColumns({"_a": a, "_b": b, f"_t{v}": seq}).withColumn(f"_t{v}", F.explode(f"_t{v}"))
        d = d.withColumn(f"_w{v}", F.least(F.col("_b"), F.col(f"_t{v}") + 1) - F.greatest(F.col("_a"), F.col(f"_t{v}").cast("double")))
    w = F.col("_wy") * F.col("_wx")
    return (
        d.groupBy(*keys, F.col("_ty").cast("int").alias("_y"), F.col("_tx").cast("int").alias("_x"))
        .agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns])
        .withColumnsRenamed({"_y": "y", "_x": "x"})
    )


# --------------------------------------------------------------------------- patches
def reflect_pad(px: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    """Scenes smaller than ``min_size`` are continued by mirror images (edge repeated)."""
    d = px.join(sizes(px, keys).select(*keys, "height", "width"), keys)
    for axis, n in (("y", "height"), ("x", "width")):
        size, a = F.greatest(F.col(n), F.lit(min_size)), F.col(axis)
        period = 2 * F.col(n)
        k = F.sequence(F.lit(0), F.floor((size - 1) / period).cast("int"))
        spots = F.flatten(F.transform(k, lambda j: F.array(j * period + a, j * period + period - 1 - a)))
        d = d.withColumn("_at", F.explode(F.filter(spots, lambda s: s < size))).withColumn(axis, F.col("_at").cast("int")).drop("_at")
    return d.drop("height", "width")


def mirror_mosaic(px: DataFrame, keys: list[str]) -> DataFrame:
    """Each block beside its left-right, up-down and double mirror image (2 x 2 block)."""
    d = px.join(sizes(px, keys).select(*keys, "height", "width"), keys)
    y, x, h, w = F.col("y"), F.col("x"), F.col("height"), F.col("width")
    spot = lambda a, b: F.struct(a.cast("int").alias("y"), b.cast("int").alias("x"))
    places = F.array(spot(y, x), spot(y, 2 * w - 1 - x), spot(2 * h - 1 - y, x), spot(2 * h - 1 - y, 2 * w - 1 - x))
    return d.withColumn("_p", F.explode(places)).withColumns({"y": F.col("_p.y"), "x": F.col("_p.x")}).drop("_p", "height", "width")


def _origins(v: Column, n: Column, patch: int, stride: int) -> Column:
    """Patch origins covering coordinate ``v`` on an axis of length ``n``; the last patch is
    flush with the edge."""
    lo = F.greatest(F.lit(0), F.ceil((v - patch + 1) / stride)).cast("int")
    hi = F.least(F.floor(v / stride), F.floor((n - patch) / stride)).cast("int")
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    flush = F.when(v >= n - patch, F.array((n - patch).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_union(regular, flush)


def patch_pixels(px: DataFrame, keys: list[str], patch: int = 64, stride: int = 32) -> DataFrame:
    """Pixels copied to every sliding patch that covers them (``py``, ``px0``): with stride
    = patch / 2 at most nine copies. Scenes must be at least one patch wide and high."""
    d = px.join(sizes(px, keys).select(*keys, "height", "width"), keys)
    d = d.withColumn("py", F.explode(_origins(F.col("y"), F.col("height"), patch, stride)))
    d = d.withColumn("px0", F.explode(_origins(F.col("x"), F.col("width"), patch, stride)))
    return d.drop("height", "width")


def patches_to_pixels(px: DataFrame, scored: DataFrame, keys: list[str], patch: int = 64, stride: int = 32, n: int = 10) -> DataFrame:
    """Average of the patch probabilities (array ``p`` of length ``n``) over every patch
    that covers a pixel."""
    j = patch_pixels(px.select(*keys, "y", "x"), keys, patch, stride).join(scored, [*keys, "py", "px0"])
    means = [F.avg(F.element_at("p", k + 1)) for k in range(n)]
    return j.groupBy(*keys, "y", "x").agg(F.array(*means).alias("p"))


def rotate_views(px: DataFrame, size: int, views: int = 4) -> DataFrame:
    """Quarter-turn copies of patch pixels (``view`` 0..3); coordinates inside the patch."""
    y, x, m = F.col("y"), F.col("x"), size - 1
    spots = [(y, x), (m - x, y), (m - y, m - x), (x, m - y)][:views]
    arr = F.array(*[F.struct(F.lit(k).alias("view"), a.cast("int").alias("y"), b.cast("int").alias("x")) for k, (a, b) in enumerate(spots)])
    return px.withColumn("_v", F.explode(arr)).withColumns({"view": F.col("_v.view"), "y": F.col("_v.y"), "x": F.col("_v.x")}).drop("_v")
