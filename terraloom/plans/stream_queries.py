"""Streaming queries: the events table as a file stream, processed with ``availableNow``.

Only windows the watermark has passed are emitted, so the SQL twins carry that condition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.plans.registry import query
from terraloom.plans.shape import i, r, s
from terraloom.sources import tables as tb
from terraloom.streaming import feeds as fd

WM = "wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 DAY AS wm FROM events)"


def events(spark, sf):
    schema = tb.table(spark, sf, "events").schema
    return fd.landed(spark, f"{sf}/events.parquet", schema, "ts", max_files=16)


@query(
    "stream_daily",
    f"""WITH {WM} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, round(avg(value) / 9.9991, 4) AS mean, count(*) AS n FROM events, wm
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= wm GROUP BY 1, 2""",
)
def stream_daily(spark, sf):
    d = fd.drain(fd.tumbling_means(events(spark, sf), ["event_type"], "value"), "daily")
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", r(F.col("mean") / 9.9991, 4, "mean"), "n")


@query(
    "stream_sliding",
    f"""WITH {WM}, w AS (SELECT e.*, CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k.range AS INT)) AS st FROM events e, range(0, 7) k)
    SELECT strftime(st, '%Y-%m-%d') AS start, event_type, round(sum(value) / 9.9991, 3) AS total, count(*) AS n FROM w, wm WHERE st + INTERVAL 7 DAY <= wm GROUP BY 1, 2""",
)
def stream_sliding(spark, sf):
    d = fd.drain(fd.sliding_sums(events(spark, sf), ["event_type"], "value"), "sliding")
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", r(F.col("total") / 9.9991, 3, "total"), "n")


@query(
    "stream_sessions",
    """WITH h AS (SELECT user_id, ts FROM events WHERE value > 60), wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 DAY AS wm FROM h),
    m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '86401 seconds' THEN 0 ELSE 1 END AS brk FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM g, wm GROUP BY user_id, sid, wm
    HAVING max(ts) + INTERVAL '86401 seconds' <= wm""",
)
def stream_sessions(spark, sf):
    """The watermark follows the flagged events: Spark pushes the filter below it."""
    d = fd.drain(fd.spells(events(spark, sf), ["user_id"], F.col("value") > 60), "sessions")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return d.select("user_id", fmt("first"), fmt("last"), "n")


@query(
    "stream_latest",
    f"""WITH {WM}, k AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS slot FROM events)
    SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, event_type, round(arg_max(value, ts), 4) AS latest FROM k, wm WHERE slot + INTERVAL 6 HOUR <= wm GROUP BY 1, 2""",
)
def stream_latest(spark, sf):
    d = fd.drain(fd.latest_per_station(events(spark, sf), ["event_type"], "value", ttl="6 hours"), "latest")
    return d.select(F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "event_type", r("latest"))


@query(
    "stream_upsert",
    """SELECT user_id, event_type, round(arg_max(value, ts), 4) AS value FROM events GROUP BY user_id, event_type""",
)
def stream_upsert(spark, sf):
    """Landed events upserted by batch; the view keeps the newest value per key."""
    path = fd.drain_upsert(events(spark, sf).select("user_id", "event_type", "ts", "value"), "upsert")
    return fd.current_observations(spark, path, ["user_id", "event_type"], "ts").select("user_id", "event_type", r("value"))


@query(
    "stream_anomaly",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, least(dayofyear(ts), 365) AS doy, value FROM events),
    per AS (SELECT DISTINCT event_type, doy FROM d),
    c AS (SELECT p.event_type, p.doy, avg(d.value) AS m FROM per p JOIN d ON d.event_type = p.event_type AND abs((((d.doy - p.doy + 182) % 365 + 365) % 365) - 182) <= 3 GROUP BY ALL)
    SELECT event_type, CAST(d AS VARCHAR) AS day, count(*) AS n, round(avg((value - m) / 9.9991), 4) AS anomaly FROM d JOIN c USING (event_type, doy) GROUP BY ALL""",
)
def stream_anomaly(spark, sf):
    """Stream joined with static day-of-year normals."""
    e = tb.table(spark, sf, "events").withColumn("obs_date", F.to_date("ts"))
    clim = cl.doy_climatology(e, ["value"], ["event_type"])
    d = fd.drain(fd.with_anomaly(events(spark, sf), clim, "value", "value_mean", ["event_type"]).select("event_type", "ts", "anomaly"), "anomaly")
    return d.groupBy("event_type", s_day("ts")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("anomaly") / 9.9991), 4, "anomaly"))


def s_day(c):
    return F.to_date(c).cast("string").alias("day")


@query(
    "stream_rate_limit",
    """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts, 1 AS n FROM events GROUP BY user_id
      UNION ALL SELECT a.user_id, min(e.ts), a.n + 1 FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 36 HOUR WHERE a.n < 6 GROUP BY a.user_id, a.n)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n FROM a""",
)
def stream_rate_limit(spark, sf):
    """At most six passes per user, at least 36 hours apart."""
    d = fd.drain(fd.rate_limited(events(spark, sf), ["user_id"], cooldown=36 * 3600.0, cap=6), "limit")
    return d.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), i("n"))


@query(
    "stream_alert_dedupe",
    """WITH a AS (SELECT user_id, event_type, ts, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2024-01-01') AS slot FROM events WHERE value > 100),
    wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 DAY AS wm FROM a)
    SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM a, wm GROUP BY user_id, event_type, slot, wm HAVING slot + INTERVAL 3 HOUR <= wm""",
)
def stream_alert_dedupe(spark, sf):
    """Alerts per (user, type): the first of each three-hour slot."""
    alerts = events(spark, sf).filter(F.col("value") > 100).select("user_id", "event_type", "ts")
    d = fd.drain(fd.first_in_slot(alerts, ["user_id", "event_type"]), "alerts")
    return d.select("user_id", "event_type", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")
