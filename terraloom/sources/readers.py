"""Readers: landed files and payload tables to the long-form schemas.

Readers give columns explicit types, turn sentinels and NaN into NULL and drop a bad row
as a whole. Downloads are not part of the library; payloads are files or text columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom import schemas as sch
from terraloom.functions.numeric import finite, sentinel_to_null
from terraloom.session import ship_package


# --------------------------------------------------------------------------- daily records
def _number(c: str) -> Column:
    return finite(F.col(c).try_cast("double"))


def parse_record(text: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of text (ds, temp_mean, temp_min, temp_max, precip) to a daily record; a row
    with a bad date, mean temperature or rain is dropped as a whole; rain is at least 0."""
    d = text.select(
        *(keys or []),
        F.try_to_date(F.substring("ds", 1, 10), "yyyy-MM-dd").alias("obs_date"),
        _number("temp_mean").alias("tmean"), _number("temp_min").alias("tmin"), _number("temp_max").alias("tmax"),
        _number("precip").alias("_p"),
    )
    ok = F.col("obs_date").isNotNull() & F.col("tmean").isNotNull() & F.col("_p").isNotNull()
    return d.filter(ok).withColumn("precip", F.greatest("_p", F.lit(0.0))).drop("_p")


def parse_record_with_defaults(text: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As :func:`parse_record`, but only the date, maximum and rain are required: a missing
    minimum is the maximum, a missing mean the middle of both."""
    d = text.select(
        *(keys or []),
        F.try_to_date(F.substring("ds", 1, 10), "yyyy-MM-dd").alias("obs_date"),
        _number("temp_max").alias("tmax"), F.coalesce(_number("temp_min"), _number("temp_max")).alias("tmin"),
        _number("temp_mean").alias("_m"), _number("precip").alias("_p"),
    )
    ok = F.col("obs_date").isNotNull() & F.col("tmax").isNotNull() & F.col("_p").isNotNull()
    return d.filter(ok).select(
        *(keys or []), "obs_date", F.coalesce("_m", (F.col("tmax") + F.col("tmin")) / 2).alias("tmean"), "tmin", "tmax",
        F.greatest("_p", F.lit(0.0)).alias("precip"),
    )


def read_record_csv(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    text = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    for c in sch.RECORD_TEXT.fieldNames():
        if c not in text.columns:
            text = text.withColumn(c, F.lit(None).cast("string"))
    out = parse_record_with_defaults(text)
    return out.withColumn("station", F.lit(station)) if station else out


POINT_VARS = {"T2M": "tmean", "T2M_MAX": "tmax", "T2M_MIN": "tmin", "PRECTOTCORR": "precip"}  # fixed values


def parse_point_feed(payloads: DataFrame, payload: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """Parallel date-to-value maps per variable to one row per day; sentinels are masked in
    every variable, days without mean temperature or rain are dropped."""
    keys = keys or []
    p = payloads.select(*keys, F.from_json(payload, sch.POINT_FEED)["properties"]["parameter"].alias("_m"))
    long = p.select(*keys, F.explode("_m").alias("code", "_v")).select(*keys, "code", F.explode("_v").alias("ymd", "value"))
    long = long.withColumn("value", sentinel_to_null(F.col("value")))
    pick = lambda code, alias: F.max(F.when(F.col("code") == code, F.col("value"))).alias(alias)
    wide = long.groupBy(*keys, "ymd").agg(*[pick(c, a) for c, a in POINT_VARS.items()])
    ok = F.col("tmean").isNotNull() & F.col("precip").isNotNull()
    return wide.filter(ok).select(
        *keys, F.try_to_date("ymd", "yyyyMMdd").alias("obs_date"), "tmean", "tmax", "tmin", F.greatest("precip", F.lit(0.0)).alias("precip")
    )


# --------------------------------------------------------------------------- grids
def parse_archive(payloads: DataFrame, cells: DataFrame, variable: str, keys: list[str]) -> DataFrame:
    """Multi-location archive payload: the n-th location belongs to the n-th requested cell.

    ``payloads``: keys, payload (JSON array of ``{"daily": {"time": [..], var: [..]}}``);
    ``cells``: keys, pos, lat, lon. NULL values stay NULL rows.
    """
    schema = f"array<struct<daily: struct<time: array<string>, `{variable}`: array<double>>>>"
    locs = payloads.select(*keys, F.posexplode(F.from_json("payload", schema)).alias("pos", "loc"))
    days = locs.select(*keys, "pos", F.explode(F.arrays_zip(F.col("loc.daily.time").alias("t"), F.col(f"loc.daily.{variable}").alias("v"))).alias("_d"))
    return days.join(cells, [*keys, "pos"]).select(
        *keys, F.to_date("_d.t").alias("obs_date"), "lat", "lon", finite(F.col("_d.v")).alias("value")
    )


def read_grid(spark: SparkSession, path: str, var: str, region: str, start: str, end: str) -> DataFrame:
    """Partition-pruned scan of stored fields between two yyyyMMdd days.

    Where the periods of stored sets overlap, a day comes from the set that ends last (then starts
    last): the trailing window that was refreshed last.
    """
    g = spark.read.schema(T.StructType([*sch.GRID_OBS.fields, T.StructField("period", T.StringType())])).parquet(path)
    first, last = F.substring_index("period", "_", 1), F.substring_index("period", "_", -1)
    g = g.filter((F.col("var") == var) & (F.col("region") == region) & (first <= end) & (last >= start)).filter(
        F.col("obs_date").between(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd"))
    )
    newest = g.groupBy("source", "obs_date").agg(F.max_by("period", F.struct(last, first)).alias("period"))
    return g.join(newest, ["source", "obs_date", "period"], "left_semi").drop("period")


def concat_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Calendar-year chunks of one grid behind each other."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def mosaic(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles put together; a cell on a shared border is kept from the lowest tile.

    ``tiles``: keys, tile, lat, lon, value. The minimum over (tile, value) is a partial
    aggregate, no ranking window is needed.
    """
    first = F.min(F.struct("tile", "value")).alias("_f")
    return tiles.groupBy(*keys, "lat", "lon").agg(first).select(*keys, "lat", "lon", F.col("_f.value").alias("value"))


def tile_edges(lo: float, hi: float, step: float = 8.0) -> list[float]:
    """Even split of a range into tiles of at most ``step``."""
    n = max(1, -(-(hi - lo) // step))
    return [round(lo + (hi - lo) / n * k, 4) for k in range(int(n) + 1)]


def climatology_steps(raw: DataFrame) -> DataFrame:
    """13-step climatology: step 1..12 are the months, 13 the annual mean."""
    return raw.withColumnRenamed("time", "month") if "time" in raw.columns else raw


def agency_grid(field: DataFrame, start: str, end: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Station-agency grid: sentinel masked, cut to dates (yyyyMMdd) and bounding box."""
    lat0, lat1, lon0, lon1 = bbox
    day = F.col("obs_date").between(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd"))
    inside = F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)
    return field.filter(day & inside).withColumn("value", sentinel_to_null(F.col("value")))


def agency_mean(tmax: DataFrame, tmin: DataFrame, keys: list[str]) -> DataFrame:
    """Mean temperature from the maximum and minimum grids."""
    on = [*keys, "obs_date", "lat", "lon"]
    a = tmax.select(*on, sentinel_to_null(F.col("value")).alias("_a"))
    b = tmin.select(*on, sentinel_to_null(F.col("value")).alias("_b"))
    return a.join(b, on).select(*on, ((F.col("_a") + F.col("_b")) / 2).alias("value"))


def standard_coordinates(raw: DataFrame) -> DataFrame:
    """Usual spellings of the coordinate columns to ``lat`` and ``lon``."""
    return raw.withColumnsRenamed({k: v for k, v in sch.COORDINATE_NAMES.items() if k in raw.columns})


# --------------------------------------------------------------------------- catalogue, documents
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries; no rows when the file is absent or damaged."""
    try:
        m = spark.read.schema(sch.MANIFEST).json(path, multiLine=True, mode="PERMISSIVE")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], sch.MANIFEST_ENTRY)
    return m.select(F.explode("datasets").alias("d")).select("d.*")


def find_documents(rows: DataFrame, **equal: str) -> DataFrame:
    """Stored documents (id, email, owner, data) that match: indexed columns are filtered
    before the JSON is parsed, the others after; blank or damaged rows are dropped."""
    for k in ("id", "email", "owner"):
        if k in equal:
            rows = rows.filter(F.col(k) == F.lit(equal[k]))
    docs = rows.filter(F.length(F.coalesce("data", F.lit(""))) > 0).select(F.from_json("data", sch.DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), "data")
    # a damaged text parses to a struct of NULLs; a valid document is a JSON object
    docs = docs.filter(F.col("d").isNotNull() & F.expr("try_parse_json(data)").isNotNull()).select("d.*")
    for k, v in equal.items():
        docs = docs.filter(F.col(k) == F.lit(v))
    return docs


def read_backtest(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Backtest JSON to (var, method, lead, rmse) rows."""
    method = sch.BACKTEST_METHOD.simpleString()
    schema = f"variables map<string, struct<methods: map<string, {method}>, blend_weights: array<array<double>>>>"
    b = spark.read.schema(schema).json(path, multiLine=True)
    m = b.select(F.explode("variables").alias("var", "v")).filter(F.col("var").isin(*variables))
    m = m.select("var", F.explode("v.methods").alias("method", "s"))
    return m.select("var", "method", F.posexplode("s.rmse_by_lead").alias("_k", "rmse"), F.col("s.mae").alias("mae"), F.col("s.skill_pct").alias("skill_pct")).select(
        "var", "method", (F.col("_k") + 1).alias("lead"), "rmse", "mae", "skill_pct"
    )


def read_preset(spark: SparkSession, folder: str, preset_id: str) -> DataFrame:
    """One preset document by id; ids hold lower-case letters, digits and underscores."""
    if not preset_id or any(ch not in "abcdefghijklmnopqrstuvwxyz0123456789_" for ch in preset_id):
        raise ValueError(f"bad preset id {preset_id!r}")
    return spark.read.schema(sch.DOCUMENT).json(folder, multiLine=True, pathGlobFilter=f"{preset_id}.json")


# --------------------------------------------------------------------------- scenes
def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Image files to pixels (scene_id, y, x, r, g, b in 0..1).

    The source decodes to blue-green-red bytes (one or four channels are taken as they are). An image
    is cut into its lines of bytes, the lines are spread over the cluster, and each task decodes its
    lines as arrays: the work is linear in the pixels and a large image is many tasks' work.
    """
    ship_package(spark)
    img = spark.read.format("image").option("dropInvalid", True).load(path)
    i = img.select(F.col("image.origin").alias("scene_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("_data"))
    size = F.col("w") * F.col("c")
    lines = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.substring(F.col("_data"), y * size + 1, size))
    lines = i.select("scene_id", "c", F.posexplode(lines).alias("y", "_line")).repartition("scene_id", "y")
    return lines.select("scene_id", "y", "c", "_line").mapInArrow(_decode_lines, "scene_id string, y int, x int, r double, g double, b double")


def _decode_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One output batch for each line of pixels."""
    for batch in batches:
        for scene, y, c, line in zip(*(col.to_pylist() for col in batch.columns)):
            px = np.frombuffer(line, np.uint8).reshape(-1, c)
            n = len(px)
            channels = [pa.array(px[:, min(k, c - 1)] / 255.0) for k in (2, 1, 0)]
            cols = [pa.array([scene] * n, pa.string()), pa.array(np.full(n, y, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *channels]
            yield pa.RecordBatch.from_arrays(cols, names=["scene_id", "y", "x", "r", "g", "b"])


def read_labelled_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles in one folder per class, with the folder name as ``label``."""
    px = read_scenes(spark, path)
    return px.withColumn("label", F.regexp_extract("scene_id", r"([^/]+)/[^/]+$", 1))


def band_stack(stack: DataFrame, band_map: dict[str, int], keys: list[str]) -> DataFrame:
    """Stacked bands (keys, y, x, ``bands`` array, bands numbered from 1) to named columns;
    scenes with fewer bands than the map needs are left out."""
    need = max(band_map.values())
    return stack.filter(F.size("bands") >= need).select(
        *keys, "y", "x", *[F.element_at("bands", k).cast("double").alias(n) for n, k in band_map.items()]
    )


def bands_first(stack: DataFrame) -> DataFrame:
    """Index triples (i, j, k, value) of a stack stored rows-columns-bands, told by a first
    axis longer than the last, to (band, y, x)."""
    n = stack.groupBy("scene_id").agg((F.max("i") + 1).alias("_ni"), (F.max("k") + 1).alias("_nk"))
    j = stack.join(n, "scene_id")
    last = F.col("_ni") > F.col("_nk")
    pick = lambda a, b: F.when(last, F.col(a)).otherwise(F.col(b))
    return j.select("scene_id", pick("k", "i").alias("band"), pick("i", "j").alias("y"), pick("j", "k").alias("x"), "value")


# --------------------------------------------------------------------------- feeds
def parse_weather(payloads: DataFrame, stations: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Current weather: the n-th location belongs to the n-th station; a payload with
    another number of locations fails. ``stations``: pos, name, lat, lon (a short list).
    """
    p = payloads.select(*keys, F.from_json("payload", sch.WEATHER_PAYLOAD).alias("_p"))
    n = F.lit(stations.count())
    wrong = F.format_string("payload has %d locations for %d stations", F.size("_p"), n)
    checked = F.when(F.size("_p") == n, F.col("_p")).otherwise(F.raise_error(wrong).cast(sch.WEATHER_PAYLOAD))
    locs = p.select(*keys, F.posexplode(checked).alias("pos", "loc")).join(F.broadcast(stations), "pos")
    first = lambda c: F.try_element_at(F.col(f"loc.daily.{c}"), F.lit(1))
    cur = lambda c: F.col(f"loc.current.{c}")
    out = locs.select(
        *keys, "pos", "name", "lat", "lon", cur("temperature_2m").alias("temp_c"), cur("apparent_temperature").alias("feels_c"),
        cur("relative_humidity_2m").alias("humidity_pct"), cur("precipitation").alias("precip_mm"), cur("wind_speed_10m").alias("wind_kmh"),
        cur("weather_code").alias("weather_code"), first("temperature_2m_max").alias("high_c"), first("temperature_2m_min").alias("low_c"),
        first("precipitation_probability_max").alias("rain_chance_pct"), cur("time").alias("observed_at"),
    )
    return out.join(F.broadcast(codes), "weather_code", "left").withColumn("condition", F.coalesce("condition", F.lit("unknown")))


def parse_news(payloads: DataFrame, provider: str, keys: list[str] | None = None) -> DataFrame:
    """Articles of either provider in one shape, with their position in the payload."""
    image = "urlToImage" if provider == "a" else "image"
    schema = "articles array<" + (sch.ARTICLE_A if provider == "a" else sch.ARTICLE_B).simpleString() + ">"
    a = payloads.select(*(keys or []), F.posexplode(F.from_json("payload", schema)["articles"]).alias("position", "a"))
    return a.select(
        *(keys or []), "position", F.col("a.title").alias("title"), F.col("a.description").alias("summary"), F.col("a.url").alias("url"),
        F.col(f"a.{image}").alias("image"), F.col("a.source.name").alias("source"), F.col("a.publishedAt").alias("published_at"),
    )


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    """Source registry: a reader returns (obs_date, lat, lon, value) rows for a variable."""
    SOURCES[name] = reader


def fetch(name: str, *args, **kwargs) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r} (known: {sorted(SOURCES)})")
    return SOURCES[name](*args, **kwargs)
