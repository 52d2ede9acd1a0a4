"""Sinks: stored fields, the catalogue, document logs, metrics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.text import file_stem
from terraloom.operators import anomaly as an
from terraloom.operators import catalog as ct
from terraloom.operators import documents as dc
from terraloom.schemas import MANIFEST_ENTRY

GRID_KEYS = ["source", "var", "region"]


def write_grid(grid: DataFrame, path: str) -> None:
    """Store fields as one set per source, variable, region and period (first and last day); only a set of
    the same period is replaced, so a later window leaves the earlier days as they are.

    Rows are spread by set and month first, so that a large set is written by many tasks and
    holds files of moderate size.
    """
    dated = "obs_date" in grid.columns
    month = F.date_format("obs_date", "yyyyMM") if dated else F.col("month").cast("string")
    if dated:
        day = lambda c: F.date_format(c, "yyyyMMdd")
        period = grid.groupBy(*GRID_KEYS).agg(F.concat_ws("_", day(F.min("obs_date")), day(F.max("obs_date"))).alias("period"))
        out = grid.join(period, GRID_KEYS)
    else:
        out = grid.withColumn("period", F.lit("clim"))
    out = out.repartition(*[F.col(k) for k in [*GRID_KEYS, "period"]], month)
    out.write.partitionBy(*GRID_KEYS, "period").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def catalogue_entries(grid: DataFrame, created_at: str, climatology: bool = False) -> DataFrame:
    """Catalogue rows of the grids in ``grid`` with the statistics of their mean field."""
    if climatology:
        st = an.field_summary(grid, GRID_KEYS)
        st = st.withColumns({"start": F.lit(None).cast("string"), "end": F.lit(None).cast("string"), "days": F.lit(None).cast("bigint")})
        ident = F.concat_ws("_", *GRID_KEYS, F.lit("clim"))
    else:
        st = an.ingest_statistics(grid, GRID_KEYS).withColumns(
            {"start": F.date_format("start_date", "yyyyMMdd"), "end": F.date_format("end_date", "yyyyMMdd")}
        )
        ident = F.concat_ws("_", *GRID_KEYS, "start", "end")
    cols = {
        "id": ident, "grid_shape": F.array(F.col("n_lat").cast("bigint"), F.col("n_lon").cast("bigint")),
        "n_cells": F.col("n_cells").cast("bigint"), "mean": F.round("mean", 3), "min": F.round("vmin", 3), "max": F.round("vmax", 3),
        "kind": F.lit("climatology" if climatology else None).cast("string"), "created_at": F.lit(created_at), "status": F.lit("ingested"),
        "days": F.col("days").cast("bigint"),
    }
    d = st.withColumns(cols)
    return d.select(*[
        (F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST_ENTRY.fields
    ])


def write_catalogue(entries: DataFrame, current: DataFrame | None, path: str) -> None:
    """The upserted catalogue as one JSON-lines table at a new path; the caller points the
    readers there (a table is never overwritten while it is read)."""
    out = entries if current is None else ct.upsert(current, entries)
    out.write.mode("errorifexists").json(path)


def append_documents(docs: DataFrame, path: str, deleted: bool = False) -> None:
    """Append to the change log. An update is a newer row of the same key, a deletion a
    tombstone; readers take :func:`terraloom.operators.documents.latest`."""
    docs.withColumn("deleted", F.lit(deleted)).write.mode("append").parquet(path)


def current_documents(spark: SparkSession, path: str, order: str = "seq") -> DataFrame:
    return dc.latest(spark.read.parquet(path), "id", order)


HISTORY_COLUMNS = ["id", "owner", "name", "created_at", "region", "mode", "primary", "severity", "affected_area_pct", "overlay_url", "location"]


def write_history(results: DataFrame, path: str) -> None:
    """Compact history record of triage results; the scene name is the file's stem, cut to
    80 characters (a fixed display width)."""
    dc.project(results.withColumn("name", file_stem(F.col("name"))), HISTORY_COLUMNS).write.mode("append").parquet(path)


def route_presets(docs: DataFrame, paths: dict[str, str]) -> None:
    """Each document goes to the collection of its category; an analysis with a severity
    goes to the disasters as well."""
    c, has = F.coalesce("category", F.lit("analysis")), F.col("severity").isNotNull()
    parts = {
        "analyses": c == "analysis",
        "changes": c == "change",
        "disasters": (c == "disaster") | ((c == "analysis") & has),
    }
    for name, cond in parts.items():
        docs.filter(cond).write.mode("append").json(paths[name])


def write_metrics(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)
