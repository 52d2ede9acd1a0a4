"""Anomaly fields, field summaries and the live state derived from grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.numeric import clip
from terraloom.operators import climatology as cl
from terraloom.operators import grid as gr
from terraloom.operators.hazards import drought_from_anomaly


def snapshot(grid: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """The newest ``days`` days of each grid."""
    newest = grid.groupBy(*keys).agg(F.max("obs_date").alias("_end"))
    return grid.join(newest, keys).filter(F.col("obs_date") > F.date_sub("_end", days)).drop("_end")


def pct_anomaly(anom: Column, normal: Column) -> Column:
    """Anomaly in % of the normal; NULL where the normal is at most 0.1."""
    return F.when(normal > 0.1, anom / normal * 100)


def grid_anomaly(window: DataFrame, clim: DataFrame, keys: list[str]) -> DataFrame:
    """Time-mean field minus the equal-weight normal of the months in the window."""
    value = cl.field_mean(window, keys)
    months = window.select(*keys, F.month("obs_date").alias("month"))
    normal = cl.month_set_normal(clim, months, keys, [*keys, "lat", "lon"])
    out = value.join(normal, [*keys, "lat", "lon"], "left")
    anom = F.col("value") - F.col("normal")
    return out.withColumn("anomaly", anom).withColumn("anomaly_pct", pct_anomaly(anom, F.col("normal")))


def field_summary(field: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Extent and statistics of a field in one aggregate."""
    v = F.col(value)
    return field.groupBy(*keys).agg(
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
        F.avg(v).alias("mean"),
        F.count(v).alias("valid_cells"),
        F.size(F.collect_set("lat")).alias("n_lat"),
        F.size(F.collect_set("lon")).alias("n_lon"),
    ).withColumn("n_cells", F.col("n_lat") * F.col("n_lon"))


def ingest_statistics(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue statistics of stored grids: days, shape, cells, mean/min/max of the
    time-mean field."""
    span = grid.groupBy(*keys).agg(
        F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"),
        F.size(F.collect_set("obs_date")).alias("days"),
    )
    return field_summary(cl.field_mean(grid, keys), keys).join(span, keys)


def field_view(grid: DataFrame, catalogue: DataFrame, keys: list[str], max_cells: int = 28) -> DataFrame:
    """Thinned time-mean field with its catalogue metadata (NULL when uncatalogued)."""
    thin = gr.thin(cl.field_mean(grid, keys), keys, max_cells)
    return thin.join(catalogue, keys, "left")


def live_state(temp_anomaly: DataFrame, rain_anomaly: DataFrame, keys: list[str]) -> DataFrame:
    """Current state from two anomaly fields: means, clipped rain anomaly, soil proxy and
    drought class."""
    t = temp_anomaly.groupBy(*keys).agg(F.avg("anomaly").alias("temp_anomaly"), F.avg("value").alias("mean_temp"))
    r = rain_anomaly.groupBy(*keys).agg(
        clip(F.coalesce(F.avg("anomaly_pct"), F.lit(0.0)), -70, 100).alias("rain_anomaly_pct"),
        (F.avg("value") * 30).alias("precip_30d"),
    )
    j = t.join(r, keys)
    return j.withColumn("soil_moisture", clip(0.40 + F.col("rain_anomaly_pct") / 320.0, 0.08, 0.9)).withColumn(
        "drought_class", drought_from_anomaly(F.col("rain_anomaly_pct"))
    )


def as_nested(field: DataFrame, keys: list[str], value: str = "value", digits: int = 2) -> DataFrame:
    """Field as axes and a nested array (rows by latitude, NULL for missing cells), for
    output. Meant for thinned fields: a row of the array holds one latitude."""
    a = gr.axes(field, keys)
    cells = field.groupBy(*keys, "lat").agg(F.map_from_entries(F.collect_list(F.struct("lon", F.round(value, digits)))).alias("_m"))
    rows = cells.join(a, keys).select(
        *keys, "lat", "lats", "lons", F.transform("lons", lambda x: F.try_element_at(F.col("_m"), x)).alias("_row")
    )
    return rows.groupBy(*keys, "lats", "lons").agg(F.sort_array(F.collect_list(F.struct("lat", "_row"))).alias("_r")).select(
        *keys, F.transform("lats", lambda x: F.round(x, 3)).alias("lats"), F.transform("lons", lambda x: F.round(x, 3)).alias("lons"),
        F.col("_r._row").alias("values"),
    )
