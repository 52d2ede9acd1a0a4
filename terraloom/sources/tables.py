"""Adapters: the given relational tables seen as daily records, grids, rasters and documents.

Every adapter has an SQL twin (a common table expression) for the side-by-side check.
The divisors carry a large prime factor, so that averages do not land on rounding ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- daily record
DAILY = """daily AS (
  SELECT l_returnflag || l_linestatus AS station, CAST(l_shipdate AS DATE) AS obs_date,
         avg(l_extendedprice) / 1999.3 AS tmean, min(l_extendedprice) / 1500.7 - 12 AS tmin,
         max(l_extendedprice) / 2500.9 AS tmax, sum(greatest(l_quantity - 40, 0)) / 3.0011 AS precip
  FROM lineitem GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, obs_date) record; one row per station and day, so a station's series is
    bounded by the calendar however large ``lineitem`` grows."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("station"),
            F.to_date("l_shipdate").alias("obs_date"),
        )
        .agg(
            (F.avg("l_extendedprice") / 1999.3).alias("tmean"),
            (F.min("l_extendedprice") / 1500.7 - 12).alias("tmin"),
            (F.max("l_extendedprice") / 2500.9).alias("tmax"),
            (F.sum(F.greatest(F.col("l_quantity") - 40, F.lit(0.0))) / 3.0011).alias("precip"),
        )
    )


ORDER_DAILY = """order_daily AS (
  SELECT 'all' AS station, CAST(o_orderdate AS DATE) AS obs_date,
         avg(o_totalprice) / 9999.1 AS tmean, min(o_totalprice) / 9999.1 - 3 AS tmin,
         max(o_totalprice) / 9999.1 AS tmax,
         coalesce(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 0) / 19999.7 AS precip
  FROM orders GROUP BY 1, 2)"""


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    return (
        o.groupBy(F.lit("all").alias("station"), F.to_date("o_orderdate").alias("obs_date"))
        .agg(
            (F.avg("o_totalprice") / 9999.1).alias("tmean"),
            (F.min("o_totalprice") / 9999.1 - 3).alias("tmin"),
            (F.max("o_totalprice") / 9999.1).alias("tmax"),
            (F.coalesce(F.avg(urgent), F.lit(0.0)) / 19999.7).alias("precip"),
        )
    )


SHIP_DAILY = """ship_daily AS (
  SELECT 'all' AS station, CAST(l_shipdate AS DATE) AS obs_date,
         avg(l_extendedprice) / 1999.3 AS tmean, min(l_extendedprice) / 1500.7 - 12 AS tmin,
         max(l_extendedprice) / 2500.9 AS tmax, avg(greatest(l_quantity - 40, 0)) / 0.30011 AS precip
  FROM lineitem GROUP BY 1, 2)"""


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.lit("all").alias("station"), F.to_date("l_shipdate").alias("obs_date"))
        .agg(
            (F.avg("l_extendedprice") / 1999.3).alias("tmean"),
            (F.min("l_extendedprice") / 1500.7 - 12).alias("tmin"),
            (F.max("l_extendedprice") / 2500.9).alias("tmax"),
            (F.avg(F.greatest(F.col("l_quantity") - 40, F.lit(0.0))) / 0.30011).alias("precip"),
        )
    )


# --------------------------------------------------------------------------- gridded fields
GRID_EVENTS = """grid_events AS (
  SELECT event_type AS source, 'rain' AS var, 'r' AS region, CAST(ts AS DATE) AS obs_date,
         CAST(30 + (user_id % 10) * 0.25 AS DOUBLE) AS lat,
         CAST(70 + floor(user_id / 10) % 120 * 0.25 AS DOUBLE) AS lon, avg(value) / 9.9991 AS value
  FROM events GROUP BY 1, 2, 3, 4, 5, 6)"""


def grid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily fields per event type over 10 x 120 cells (like a regional grid, the number of
    cells is fixed); users share the cells."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("source"),
        F.lit("rain").alias("var"),
        F.lit("r").alias("region"),
        F.to_date("ts").alias("obs_date"),
        (F.lit(30.0) + F.pmod("user_id", F.lit(10)) * 0.25).alias("lat"),
        (F.lit(70.0) + F.pmod(F.floor(F.col("user_id") / 10), F.lit(120)) * 0.25).alias("lon"),
    ).agg((F.avg("value") / 9.9991).alias("value"))


GRID_SHIP = """grid_ship AS (
  SELECT 'ship' AS source, CAST(l_shipdate AS DATE) AS obs_date,
         CAST(30 + floor(s_nationkey / 5) AS DOUBLE) AS lat, CAST(70 + s_nationkey % 5 AS DOUBLE) AS lon,
         avg(l_extendedprice) / 1999.3 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""


def named(label: str, key: str):
    """Source name as data (not a constant), as it is in stored grids: joins on it stay
    equality joins instead of being folded into nested loops."""
    return F.when(F.col(key).isNotNull(), label)


def _nation_cell(key: str) -> list:
    return [
        (F.lit(30.0) + F.floor(F.col(key) / 5)).alias("lat"),
        (F.lit(70.0) + F.pmod(F.col(key), F.lit(5))).alias("lon"),
    ]


def grid_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year daily fields over 25 cells (the supplier's nation).

    Prices are summed per supplier and day before the join, so the join sees the
    pre-aggregated rows only.
    """
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("obs_date"))
        .agg(F.sum("l_extendedprice").alias("s"), F.count("l_extendedprice").alias("n"))
    )
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        per_supplier.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(named("ship", "s_nationkey").alias("source"), "obs_date", *_nation_cell("s_nationkey"))
        .agg((F.sum("s") / F.sum("n") / 1999.3).alias("value"))
    )


GRID_ORDERS = """grid_orders AS (
  SELECT 'orders' AS source, CAST(o_orderdate AS DATE) AS obs_date,
         CAST(30 + floor(c_nationkey / 5) AS DOUBLE) AS lat, CAST(70 + c_nationkey % 5 AS DOUBLE) AS lon,
         avg(o_totalprice) / 9999.1 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def grid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # summed per customer and day first: a customer with very many orders is reduced in
    # every task before the join
    o = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.to_date("o_orderdate").alias("obs_date"))
        .agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(named("orders", "c_nationkey").alias("source"), "obs_date", *_nation_cell("c_nationkey"))
        .agg((F.sum("s") / F.sum("n") / 9999.1).alias("value"))
    )


MARKERS = """markers AS (
  SELECT s_name AS name, CAST(30 + abs(s_acctbal) / 2499.7 AS DOUBLE) AS lat,
         CAST(70 + (s_suppkey % 997) / 249.3 AS DOUBLE) AS lon, CAST(abs(s_acctbal) / 199.3 AS DOUBLE) AS obs
  FROM supplier)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point stations scattered over the 5 x 5 degree grid, one per supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_name").alias("name"),
        (30 + F.abs("s_acctbal") / 2499.7).alias("lat"),
        (70 + F.pmod("s_suppkey", F.lit(997)) / 249.3).alias("lon"),
        (F.abs("s_acctbal") / 199.3).alias("obs"),
        named("ship", "s_suppkey").alias("source"),
    )


# --------------------------------------------------------------------------- catalogue, documents
CATALOGUE = """catalogue AS (
  SELECT event_type || '_' || CASE WHEN user_id % 2 = 0 THEN 'rain' ELSE 'tmean' END || '_' || CAST(user_id AS VARCHAR) AS id,
         event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'rain' ELSE 'tmean' END AS var,
         'r' || CAST(user_id % 3 AS VARCHAR) AS region,
         CASE WHEN event_type = 'signup' THEN 'climatology' END AS kind,
         strftime(min(ts), '%Y%m%d') AS start_ymd, strftime(max(ts), '%Y%m%d') AS end_ymd,
         CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS BIGINT) AS days,
         strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS created_at, user_id AS ord
  FROM events GROUP BY event_type, user_id)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue entry per (event type, user)."""
    e = table(spark, sf_dir, "events")
    var = F.when(F.pmod("user_id", F.lit(2)) == 0, "rain").otherwise("tmean")
    return (
        e.groupBy("event_type", "user_id")
        .agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
        .select(
            F.concat_ws("_", "event_type", var, F.col("user_id").cast("string")).alias("id"),
            F.col("event_type").alias("source"),
            var.alias("var"),
            F.concat(F.lit("r"), F.pmod("user_id", F.lit(3)).cast("string")).alias("region"),
            F.when(F.col("event_type") == "signup", "climatology").alias("kind"),
            F.date_format("t0", "yyyyMMdd").alias("start_ymd"),
            F.date_format("t1", "yyyyMMdd").alias("end_ymd"),
            (F.datediff(F.to_date("t1"), F.to_date("t0")) + 1).cast("bigint").alias("days"),
            F.date_format("t1", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
            F.col("user_id").alias("ord"),
        )
    )


NEWS = """news AS (
  SELECT doc_id AS position, split_part(text, chr(10), 1) AS title,
         CASE WHEN n_chars % 11 > 0 THEN 'doc://' || CAST(doc_id AS VARCHAR) END AS url, source
  FROM documents)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("position"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.pmod("n_chars", F.lit(11)) > 0, F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("url"),
        "source",
    )


DOCS = """docs AS (
  SELECT doc_id AS id, source AS owner, lang AS name, doc_id AS created_at,
         CAST(n_chars % 100 AS DOUBLE) AS confidence,
         CASE WHEN n_chars % 3 = 0 THEN 'r://' || CAST(doc_id AS VARCHAR) END AS report_url,
         CAST(n_chars % 41 AS DOUBLE) AS lc_forest, CAST(n_chars % 37 AS DOUBLE) AS lc_water,
         CAST(n_chars % 31 AS DOUBLE) AS lc_agriculture,
         CASE WHEN n_chars % 5 > 0 THEN CAST(n_chars % 29 AS DOUBLE) END AS lc_urban,
         CAST(n_chars % 23 AS DOUBLE) AS lc_others,
         CAST(n_chars % 7 AS BIGINT) AS n_building,
         CASE WHEN n_chars % 4 = 0 THEN CAST(n_chars % 6 AS BIGINT) END AS n_road
  FROM documents)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis documents with map-typed land cover and object counts."""
    n = F.col("n_chars")

    def m(k: int):
        return F.pmod(n, F.lit(k))

    cover = F.create_map(
        F.lit("Forest"), m(41).cast("double"),
        F.lit("Water"), m(37).cast("double"),
        F.lit("Agriculture"), m(31).cast("double"),
        F.lit("Urban"), F.when(m(5) > 0, m(29).cast("double")),
        F.lit("Others"), m(23).cast("double"),
    )
    counts = F.create_map(
        F.lit("Building"), m(7).cast("bigint"),
        F.lit("Road"), F.when(m(4) == 0, m(6).cast("bigint")),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("owner"),
        F.col("lang").alias("name"),
        F.col("doc_id").alias("created_at"),
        m(100).cast("double").alias("confidence"),
        F.when(m(3) == 0, F.concat(F.lit("r://"), F.col("doc_id").cast("string"))).alias("report_url"),
        F.map_filter(cover, lambda k, v: v.isNotNull()).alias("land_cover"),
        F.map_filter(counts, lambda k, v: v.isNotNull()).alias("object_counts"),
    )


# --------------------------------------------------------------------------- rasters
RASTER = """raster AS (
  SELECT vec_id // 100 AS scene_id, CAST((vec_id % 100) // 10 * 4 + p // 4 AS INT) AS y, CAST(vec_id % 10 * 4 + p % 4 AS INT) AS x,
         label, max(CASE WHEN band = 0 THEN v END) AS b0, max(CASE WHEN band = 1 THEN v END) AS b1,
         max(CASE WHEN band = 2 THEN v END) AS b2, max(CASE WHEN band = 3 THEN v END) AS b3
  FROM (SELECT vec_id, label, pos // 16 AS band, pos % 16 AS p,
               least(1.0, greatest(0.0, 0.5 + 2 * CAST(v AS DOUBLE))) AS v
        FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))
  GROUP BY vec_id, label, p)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of 40 x 40 pixels with four bands: 100 vectors are the 4 x 4 tiles of a scene.

    A vector's 64 numbers are read in place (array access), so no shuffle is needed.
    """
    e = table(spark, sf_dir, "embeddings")
    p = F.col("p")

    def band(k: int):
        v = F.element_at("embedding", p + F.lit(16 * k + 1)).cast("double")
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * v)).alias(f"b{k}")

    tiles = e.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    v = F.col("vec_id")
    return tiles.select(
        F.floor(v / 100).alias("scene_id"),
        (F.floor(F.pmod(v, F.lit(100)) / 10) * 4 + F.floor(p / 4)).cast("int").alias("y"),
        (F.pmod(v, F.lit(10)) * 4 + F.pmod(p, F.lit(4))).cast("int").alias("x"),
        "label",
        *[band(k) for k in range(4)],
    )
