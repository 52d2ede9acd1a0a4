"""Gridded fields in long form: axes, nearest and bilinear sampling, thinning, radius joins.

The two axes of a region's grid are short arrays (their length is fixed by the bounding
box and the resolution), so looking a position up on an axis is an array expression, and
only the axes are ever broadcast. Cells themselves are joined on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axes(field: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted latitude and longitude axes per key (two short arrays)."""
    lat = field.groupBy(*keys).agg(F.sort_array(F.collect_set("lat")).alias("lats"))
    lon = field.groupBy(*keys).agg(F.sort_array(F.collect_set("lon")).alias("lons"))
    return lat.join(lon, keys)


def nearest_on_axis(axis: Column, x: Column) -> Column:
    """Axis value nearest to ``x``; the lower one on a tie."""
    best = F.array_min(F.transform(axis, lambda a: F.struct(F.abs(a - x).alias("d"), a.alias("a"))))
    return best["a"]


def target_grid(spark: SparkSession, bbox: tuple[float, float, float, float], res: float) -> DataFrame:
    """Regular target grid over ``(lat0, lat1, lon0, lon1)``, coordinates rounded to 4 digits."""
    lat0, lat1, lon0, lon1 = bbox
    nlat, nlon = int((lat1 + 1e-6 - lat0) / res), int((lon1 + 1e-6 - lon0) / res)
    lats = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(nlat))).alias("i"))
    cells = lats.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nlon))))
    return cells.select(
        F.round(F.lit(lat0) + F.col("i") * res, 4).alias("lat"), F.round(F.lit(lon0) + F.col("j") * res, 4).alias("lon")
    )


def nearest_cells(points: DataFrame, grid_axes: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the coordinates of their nearest cell (each axis on its own)."""
    return points.join(grid_axes, keys).withColumns(
        {"cell_lat": nearest_on_axis(F.col("lats"), F.col("lat")), "cell_lon": nearest_on_axis(F.col("lons"), F.col("lon"))}
    ).drop("lats", "lons")


def sample_markers(field: DataFrame, markers: DataFrame, keys: list[str], fill_zero: bool = False) -> DataFrame:
    """Value columns of ``field`` at each marker's nearest cell; an absent value stays NULL
    unless ``fill_zero``."""
    values = [c for c in field.columns if c not in (*keys, "lat", "lon")]
    at = nearest_cells(markers, axes(field, keys), keys)
    cells = field.withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
    out = at.join(cells, [*keys, "cell_lat", "cell_lon"], "left")
    return out.fillna(0.0, subset=values) if fill_zero else out


def resample_nearest(field: DataFrame, target_axes: DataFrame, keys: list[str]) -> DataFrame:
    """Field moved onto other axes by nearest neighbour on each axis."""
    source_axes = axes(field, keys).withColumnsRenamed({"lats": "slats", "lons": "slons"})
    cells = (
        target_axes.join(source_axes, keys)
        .withColumn("lat", F.explode("lats"))
        .withColumn("lon", F.explode("lons"))
        .select(
            *keys, "lat", "lon",
            nearest_on_axis(F.col("slats"), F.col("lat")).alias("cell_lat"),
            nearest_on_axis(F.col("slons"), F.col("lon")).alias("cell_lon"),
        )
    )
    src = field.withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
    return cells.join(src, [*keys, "cell_lat", "cell_lon"], "left").drop("cell_lat", "cell_lon")


def _brackets(axis_rows: DataFrame, axis: str, target: list[float], keys: list[str], out: str) -> DataFrame:
    """For every target coordinate the one or two source coordinates around it with their
    weights; targets outside the axis give no rows."""
    t = F.col("_t")
    span = axis_rows.select(*keys, F.explode(F.array(*[F.lit(float(x)) for x in target])).alias("_t"), axis)
    lo = F.array_max(F.filter(axis, lambda a: a <= t))
    hi = F.array_min(F.filter(axis, lambda a: a >= t))
    span = span.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    w = F.try_divide(t - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    pair = F.when(F.col("_lo") == F.col("_hi"), F.array(F.struct(F.col("_lo").alias("s"), F.lit(1.0).alias("w")))).otherwise(
        F.array(F.struct(F.col("_lo").alias("s"), (1 - w).alias("w")), F.struct(F.col("_hi").alias("s"), w.alias("w")))
    )
    return span.select(*keys, t.alias(f"t_{out}"), F.explode(pair).alias("_p")).select(
        *keys, f"t_{out}", F.col("_p.s").alias(out), F.col("_p.w").alias(f"w_{out}")
    )


def axis_values(lo: float, hi: float, res: float) -> list[float]:
    return [round(lo + k * res, 4) for k in range(int((hi + 1e-6 - lo) / res) + 1)]


def regrid_bilinear(
    grid: DataFrame, bbox: tuple[float, float, float, float], res: float, axis_keys: list[str], row_keys: list[str]
) -> DataFrame:
    """Bilinear interpolation onto a regular grid, one shuffle.

    Source cells are copied to the targets they support (weights by broadcast bracket
    tables, bounded by the axes) and summed per target. A target with a missing corner or
    outside the source grid gets NULL.
    ``axis_keys`` name the grids, ``row_keys`` the rows to interpolate (grid keys + time).
    """
    ax = axes(grid, axis_keys)
    lat_b = _brackets(ax, "lats", axis_values(bbox[0], bbox[1], res), axis_keys, "lat")
    lon_b = _brackets(ax, "lons", axis_values(bbox[2], bbox[3], res), axis_keys, "lon")
    w = F.col("w_lat") * F.col("w_lon")
    summed = (
        grid.filter(F.col("value").isNotNull())
        .join(lat_b, [*axis_keys, "lat"])
        .join(lon_b, [*axis_keys, "lon"])
        .groupBy(*row_keys, F.col("t_lat").alias("_a"), F.col("t_lon").alias("_o"))
        .agg(F.sum(w * F.col("value")).alias("_v"), F.sum(w).alias("_w"))
    )
    return summed.select(
        *row_keys, F.col("_a").alias("lat"), F.col("_o").alias("lon"),
        F.when(F.col("_w") > 1 - 1e-9, F.col("_v")).alias("value"),
    )


def thin(field: DataFrame, keys: list[str], max_cells: int = 28) -> DataFrame:
    """Every n-th row and column, so that at most about ``max_cells`` remain per axis.

    The rank of a coordinate is its position on the axis array; no window is needed.
    """
    a = axes(field, keys)
    j = field.join(a, keys)

    def keep(axis: str, x: str) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.size(axis) / max_cells))
        return (F.array_position(axis, F.col(x)) - 1) % step == 0

    return j.filter(keep("lats", "lat") & keep("lons", "lon")).drop("lats", "lons")


def within_radius(points: DataFrame, grid_axes: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Point x cell pairs closer than ``radius`` degrees, with ``dist2``.

    A point reaches a bounded number of cells, which are read off the axis arrays; so
    the work is linear in the points and no bucket of points is ever joined as a whole.
    """
    j = points.join(grid_axes, keys)
    near = lambda axis, x: F.filter(axis, lambda a: F.abs(a - F.col(x)) <= radius)
    j = j.withColumn("g_lat", F.explode(near("lats", "lat"))).withColumn("g_lon", F.explode(near("lons", "lon")))
    d2 = F.pow(F.col("g_lat") - F.col("lat"), 2) + F.pow(F.col("g_lon") - F.col("lon"), 2)
    return j.withColumn("dist2", d2).filter(F.col("dist2") < radius * radius).drop("lats", "lons")


def km_box(lat: Column, lon: Column, half_km: Column | float = 1.5) -> dict[str, Column]:
    """Bounding box of ``half_km`` (0.2 to 25) around a point; a degree of longitude
    shrinks with the cosine of the latitude (taken as at least 0.2)."""
    half = half_km if isinstance(half_km, Column) else F.lit(float(half_km))
    half = F.greatest(F.lit(0.2), F.least(half, F.lit(25.0)))
    dlat = half / 111.0
    dlon = half / (F.lit(111.0) * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))
    return {"lat_min": lat - dlat, "lat_max": lat + dlat, "lon_min": lon - dlon, "lon_max": lon + dlon}


def normalised_coordinates(field: DataFrame, keys: list[str]) -> DataFrame:
    """Adds coordinates centred on the axis means, in units of 5 degrees."""
    a = axes(field, keys)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    centred = a.select(*keys, mean(F.col("lats")).alias("_mlat"), mean(F.col("lons")).alias("_mlon"))
    return field.join(centred, keys).withColumns(
        {"nlat": (F.col("lat") - F.col("_mlat")) / 5.0, "nlon": (F.col("lon") - F.col("_mlon")) / 5.0}
    ).drop("_mlat", "_mlon")
