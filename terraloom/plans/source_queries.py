"""Queries that run the readers on payloads derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom import schemas as sch
from terraloom.operators import catalog as ct
from terraloom.plans.registry import query
from terraloom.plans.shape import r, s, shared
from terraloom.sources import readers as rd
from terraloom.sources import tables as tb

DOI = "dayofyear(obs_date)"


@query(
    "record_parse",
    f"""WITH {tb.DAILY} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(tmean, 4) AS tmean, round(CASE WHEN {DOI} % 7 = 0 THEN tmax ELSE tmin END, 4) AS tmin, round(greatest(precip - 1, 0), 4) AS precip
      FROM daily WHERE {DOI} % 11 <> 0 AND {DOI} % 13 <> 0""",
)
def record_parse(spark, sf):
    """Daily records written as text with gaps, then parsed: bad rows go as a whole."""
    d, n = tb.daily(spark, sf), F.dayofyear("obs_date")
    text = d.select(
        "station",
        F.when(n % 11 == 0, "not a date").otherwise(F.concat(F.col("obs_date").cast("string"), F.lit("T00:00"))).alias("ds"),
        F.col("tmean").cast("string").alias("temp_mean"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("tmin")).cast("string").alias("temp_min"),
        F.col("tmax").cast("string").alias("temp_max"),
        F.when(n % 13 == 0, "").otherwise((F.col("precip") - 1).cast("string")).alias("precip"),
    )
    p = rd.parse_record_with_defaults(text, ["station"])
    return p.select("station", s("obs_date"), r("tmean"), r("tmin"), r("precip"))


@query(
    "point_feed",
    f"""WITH {tb.DAILY} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(tmean, 4) AS tmean, round(CASE WHEN {DOI} % 5 = 0 THEN NULL ELSE tmax END, 4) AS tmax, round(precip, 4) AS precip
      FROM daily WHERE {DOI} % 9 <> 0""",
)
def point_feed(spark, sf):
    """Daily records packed into yearly point-feed payloads (date-to-value maps), sentinels
    included, then parsed back."""
    d, n = tb.daily(spark, sf), F.dayofyear("obs_date")
    ymd = F.date_format("obs_date", "yyyyMMdd")
    d = d.withColumns({"tmean": F.when(n % 9 == 0, -999.0).otherwise(F.col("tmean")), "tmax": F.when(n % 5 == 0, -999.0).otherwise(F.col("tmax"))})
    maps = [
        F.struct(F.lit(code), F.map_from_entries(F.collect_list(F.struct(ymd, F.col(name))))) for code, name in rd.POINT_VARS.items()
    ]
    packed = d.groupBy("station", F.year("obs_date").alias("year")).agg(F.map_from_entries(F.array(*maps)).alias("parameter"))
    text = packed.select("station", "year", F.to_json(F.struct(F.struct("parameter").alias("properties"))).alias("payload"))
    p = rd.parse_point_feed(text, "payload", ["station", "year"])
    return p.select("station", s("obs_date"), r("tmean"), r("tmax"), r("precip"))


@query(
    "archive_feed",
    f"""WITH {tb.GRID_EVENTS} SELECT source, CAST(obs_date AS VARCHAR) AS obs_date, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value, 4) AS value FROM grid_events""",
)
def archive_feed(spark, sf):
    """Fields packed into multi-location payloads, one per source and longitude, then
    unpacked by position."""
    g = shared(tb.grid_events(spark, sf))
    cells = g.select("source", "lon", "lat").distinct()
    cells = cells.groupBy("source", "lon").agg(F.sort_array(F.collect_set("lat")).alias("lats"))
    cells = cells.select("source", "lon", F.posexplode("lats").alias("pos", "lat"))
    per_cell = g.groupBy("source", "lon", "lat").agg(F.sort_array(F.collect_list(F.struct(F.col("obs_date").cast("string").alias("t"), F.col("value").alias("v")))).alias("_d"))
    loc = F.struct(F.struct(F.col("_d.t").alias("time"), F.col("_d.v").alias("precipitation_sum")).alias("daily"))
    text = per_cell.groupBy("source", "lon").agg(F.sort_array(F.collect_list(F.struct("lat", loc.alias("l")))).alias("_a"))
    text = text.select("source", F.col("lon").alias("strip"), F.to_json(F.col("_a.l")).alias("payload"))
    p = rd.parse_archive(text, cells.withColumn("strip", F.col("lon")), "precipitation_sum", ["source", "strip"])
    return p.select("source", s("obs_date"), r("lat"), r("lon"), r("value"))


@query(
    "tile_mosaic",
    f"""WITH {tb.GRID_SHIP} SELECT CAST(obs_date AS VARCHAR) AS obs_date, lat, lon, round(value, 4) AS value FROM grid_ship""",
)
def tile_mosaic(spark, sf):
    """Fields cut into two tiles that share a border row, then put together again."""
    g = shared(tb.grid_ship(spark, sf))
    a = g.filter(F.col("lat") <= 32).withColumn("tile", F.lit(0))
    b = g.filter(F.col("lat") >= 32).withColumn("tile", F.lit(1)).withColumn("value", F.when(F.col("lat") == 32, F.col("value") + 1).otherwise(F.col("value")))
    m = rd.mosaic(a.unionByName(b), ["obs_date"])
    return m.select(s("obs_date"), "lat", "lon", r("value"))


@query(
    "agency_mean",
    f"""WITH {tb.GRID_SHIP}, {tb.GRID_ORDERS} SELECT CAST(obs_date AS VARCHAR) AS obs_date, lat, lon, round((CASE WHEN day(obs_date) = 5 THEN NULL ELSE a.value END + b.value) / 2, 4) AS value
      FROM grid_ship a JOIN grid_orders b USING (obs_date, lat, lon) WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND lat BETWEEN 31 AND 33 AND lon BETWEEN 70 AND 73""",
)
def agency_mean(spark, sf):
    cut = lambda g: rd.agency_grid(g, "19960101", "19991231", (31.0, 33.0, 70.0, 73.0))
    a = tb.grid_ship(spark, sf).withColumn("value", F.when(F.dayofmonth("obs_date") == 5, -999.0).otherwise(F.col("value")))
    m = rd.agency_mean(cut(a), cut(tb.grid_orders(spark, sf)), [])
    return m.select(s("obs_date"), "lat", "lon", r("value"))


@query(
    "weather_feed",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS hi, min(value) AS lo, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(d AS VARCHAR) AS day, s.name, round(hi, 4) AS temp_c, CASE n % 4 WHEN 0 THEN 'Clear sky' WHEN 1 THEN 'Mainly clear' WHEN 2 THEN 'Partly cloudy' ELSE 'Overcast' END AS condition, round(lo, 4) AS low_c
    FROM e CROSS JOIN (VALUES ('Srinagar'), ('Jammu'), ('Gulmarg'), ('Pahalgam'), ('Leh (Ladakh)'), ('Kupwara')) s(name)""",
)
def weather_feed(spark, sf):
    """Station payloads built from daily event summaries (six locations each)."""
    e = tb.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    loc = F.struct(
        F.struct(F.col("hi").alias("temperature_2m"), (F.col("n") % 4).alias("weather_code"), F.col("day").cast("string").alias("time")).alias("current"),
        F.struct(F.array("hi").alias("temperature_2m_max"), F.array("lo").alias("temperature_2m_min")).alias("daily"),
    )
    text = e.select("user_id", "day", F.to_json(F.array(*[loc] * len(sch.WEATHER_STATIONS))).alias("payload"))
    stations = spark.createDataFrame([(k, *w) for k, w in enumerate(sch.WEATHER_STATIONS)], "pos int, name string, lat double, lon double")
    p = rd.parse_weather(text, stations, sch.dim_weather_code(spark), ["user_id", "day"])
    return p.select("user_id", s("day"), "name", r("temp_c"), "condition", r("low_c"))


@query(
    "news_merge",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, text AS title, source, 'img' || CAST(doc_id AS VARCHAR) AS image FROM documents""",
)
def news_merge(spark, sf):
    """Articles in the two providers' shapes, brought to one."""
    d = tb.table(spark, sf, "documents")
    title, image = F.col("text").alias("title"), F.concat(F.lit("img"), F.col("doc_id").cast("string"))
    src = F.struct(F.col("source").alias("name")).alias("source")

    def payload(field: str):
        return F.to_json(F.struct(F.array(F.struct(title, src, image.alias(field))).alias("articles"))).alias("payload")

    a = rd.parse_news(d.filter("doc_id % 2 = 0").select("doc_id", payload("urlToImage")), "a", ["doc_id"]).withColumn("provider", F.lit("a"))
    b = rd.parse_news(d.filter("doc_id % 2 = 1").select("doc_id", payload("image")), "b", ["doc_id"]).withColumn("provider", F.lit("b"))
    return a.unionByName(b).select("doc_id", "provider", "title", "source", "image")


@query(
    "stored_documents",
    """SELECT CAST(doc_id AS VARCHAR) AS id, source AS owner, CAST(n_chars % 100 AS DOUBLE) AS confidence FROM documents WHERE source = 'src3' AND doc_id % 9 > 1""",
)
def stored_documents(spark, sf):
    """Stored JSON documents of one owner; blank and damaged rows are dropped."""
    d = tb.table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    body = F.to_json(F.struct(ident.alias("id"), F.col("source").alias("owner"), (F.col("n_chars") % 100).cast("double").alias("confidence")))
    data = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, F.substring(body, 1, 12)).otherwise(body)
    rows = d.select(ident.alias("id"), F.lit(None).cast("string").alias("email"), F.col("source").alias("owner"), data.alias("data"))
    return rd.find_documents(rows, owner="src3").select("id", "owner", "confidence")


@query(
    "registry_check",
    "SELECT event_type AS var, count(*) AS n FROM events WHERE event_type NOT IN ('tmean', 'tmax', 'tmin', 'rain', 'lst') GROUP BY 1",
)
def registry_check(spark, sf):
    """Quality report of incoming rows whose variable is not registered."""
    rows = tb.table(spark, sf, "events").withColumnRenamed("event_type", "var")
    bad = ct.invalid_rows(rows, sch.dim_variable(spark), "var")
    return bad.groupBy("var").agg(F.count(F.lit(1)).alias("n"))
