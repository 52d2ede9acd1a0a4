"""Queries over gridded fields: anomalies, sampling, regridding, forecasts, fusion, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions.calendar import daily_normals, refresh_window
from terraloom.operators import anomaly as an
from terraloom.operators import catalog as ct
from terraloom.operators import climatology as cl
from terraloom.operators import fusion as fu
from terraloom.operators import grid as gr
from terraloom.operators import grid_forecast as gf
from terraloom.plans.registry import query
from terraloom.plans.shape import i, r, s, shared
from terraloom.session import scratch_path
from terraloom.sources import readers as rd
from terraloom.sources import sinks as sk
from terraloom.sources import tables as tb

K = ["source"]
SHIP = f"WITH {tb.GRID_SHIP}"
GCLIM = """gclim AS (SELECT lat, lon, month(obs_date) AS month, avg(value) AS value FROM grid_ship GROUP BY 1, 2, 3
  UNION ALL SELECT lat, lon, 13, avg(value) FROM grid_ship GROUP BY 1, 2)"""
SNAP = """fin AS (SELECT max(obs_date) AS end_date FROM grid_ship),
snap AS (SELECT grid_ship.* FROM grid_ship, fin WHERE obs_date > end_date - 30),
val AS (SELECT lat, lon, avg(value) AS value FROM snap GROUP BY 1, 2),
nrm AS (SELECT lat, lon, avg(value) AS normal FROM gclim WHERE month IN (SELECT month(obs_date) FROM snap) GROUP BY 1, 2),
anom AS (SELECT lat, lon, value, normal, value - normal AS anomaly, CASE WHEN normal > 0.1 THEN (value - normal) / normal * 100 END AS anomaly_pct
  FROM val LEFT JOIN nrm USING (lat, lon))"""


def ship(spark, sf):
    g = shared(tb.grid_ship(spark, sf))
    return g, shared(cl.monthly_grid_climatology(g, K))


def anomaly_of(spark, sf):
    g, c = ship(spark, sf)
    snap = an.snapshot(g, K)
    return g, c, snap, shared(an.grid_anomaly(snap, c, K))


@query(
    "grid_mean_field",
    f"WITH {tb.GRID_EVENTS} SELECT source, round(lat, 4) AS lat, round(lon, 4) AS lon, round(avg(value), 4) AS value FROM grid_events GROUP BY source, lat, lon",
)
def grid_mean_field(spark, sf):
    return cl.field_mean(tb.grid_events(spark, sf), K).select("source", r("lat"), r("lon"), r("value"))


@query(
    "grid_refresh",
    f"""WITH {tb.GRID_EVENTS}, e AS (SELECT max(obs_date) - 3 AS b FROM grid_events),
    m AS (SELECT source, obs_date, value + CASE WHEN obs_date >= b - 10 THEN 1 ELSE 0 END AS value FROM grid_events, e WHERE obs_date <= b)
    SELECT source, CAST(obs_date AS VARCHAR) AS day, count(*) AS n, round(sum(value), 3) AS total FROM m GROUP BY 1, 2""",
)
def grid_refresh(spark, sf):
    """A grid stored up to five days before the end, the trailing window pulled later (here: one higher),
    and both read as one."""
    g = tb.grid_events(spark, sf).select("source", F.lit("rain").alias("var"), F.lit("all").alias("region"), "obs_date", "lat", "lon", "value")
    path = scratch_path(spark, "grid")
    start, end = refresh_window(F.max("obs_date"), days=10)
    a, b = g.agg(start, end).first()
    sk.write_grid(g.filter(F.col("obs_date") <= F.date_sub(F.lit(b), 5)), path)
    sk.write_grid(g.filter(F.col("obs_date").between(a, b)).withColumn("value", F.col("value") + 1), path)
    d = rd.read_grid(spark, path, "rain", "all", "00010101", "99991231")
    return d.groupBy("source", F.col("obs_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3, "total"))


@query(
    "field_stats",
    f"""WITH {tb.GRID_EVENTS}, m AS (SELECT source, lat, lon, avg(value) AS value FROM grid_events GROUP BY 1, 2, 3),
    d AS (SELECT source, count(DISTINCT obs_date) AS days, min(obs_date) AS a, max(obs_date) AS b FROM grid_events GROUP BY 1)
    SELECT source, round(min(value), 4) AS vmin, round(max(value), 4) AS vmax, round(avg(value), 4) AS mean, count(value) AS valid_cells,
      count(DISTINCT lat) * count(DISTINCT lon) AS n_cells, any_value(days) AS days, CAST(any_value(a) AS VARCHAR) AS start_date,
      CAST(any_value(b) AS VARCHAR) AS end_date FROM m JOIN d USING (source) GROUP BY source""",
)
def field_stats(spark, sf):
    f = an.ingest_statistics(shared(tb.grid_events(spark, sf)), K)
    return f.select("source", r("vmin"), r("vmax"), r("mean"), "valid_cells", i("n_cells"), i("days"), s("start_date"), s("end_date"))


@query("grid_climatology", f"{SHIP}, {GCLIM} SELECT lat, lon, month, round(value, 4) AS value FROM gclim")
def grid_climatology(spark, sf):
    _, c = ship(spark, sf)
    return c.select("lat", "lon", i("month"), r("value"))


@query(
    "daily_normals",
    f"""{SHIP}, {GCLIM}, pts AS (SELECT lat, lon, month, value, CAST(day(make_date(2021, month, 1)) AS INT) AS one,
      [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5][month] AS mid FROM gclim WHERE month <= 12),
    ring AS (SELECT lat, lon, mid, value FROM pts UNION ALL SELECT lat, lon, mid - 365, value FROM pts WHERE month = 12
      UNION ALL SELECT lat, lon, mid + 365, value FROM pts WHERE month = 1),
    seg AS (SELECT lat, lon, mid AS a, value AS va, lead(mid) OVER w AS b, lead(value) OVER w AS vb FROM ring WINDOW w AS (PARTITION BY lat, lon ORDER BY mid))
    SELECT lat, lon, d.range AS doy, round(va + (vb - va) * (d.range - a) / (b - a), 4) AS normal
    FROM seg JOIN range(1, 367) d ON d.range >= a AND d.range < b""",
)
def daily_normals_query(spark, sf):
    _, c = ship(spark, sf)
    return daily_normals(c, [*K, "lat", "lon"]).select("lat", "lon", i("doy"), r("normal"))


@query(
    "grid_anomaly",
    f"{SHIP}, {GCLIM}, {SNAP} SELECT lat, lon, round(value, 4) AS value, round(anomaly, 4) AS anomaly, round(anomaly_pct, 4) AS anomaly_pct FROM anom",
)
def grid_anomaly(spark, sf):
    return anomaly_of(spark, sf)[3].select("lat", "lon", r("value"), r("anomaly"), r("anomaly_pct"))


@query(
    "live_state",
    f"""{SHIP}, {GCLIM}, {SNAP}, st AS (SELECT avg(anomaly) AS ta, avg(value) AS mt, greatest(-70, least(100, avg(anomaly_pct))) AS ra, avg(value) * 30 AS p30 FROM anom)
    SELECT round(ta, 4) AS temp_anomaly, round(mt, 4) AS mean_temp, round(ra, 4) AS rain_anomaly_pct, round(p30, 4) AS precip_30d,
      round(greatest(0.08, least(0.9, 0.40 + ra / 320)), 4) AS soil_moisture,
      CASE WHEN ra < -40 THEN 'Severe' WHEN ra < -20 THEN 'Moderate' WHEN ra < -10 THEN 'Mild' ELSE 'Normal' END AS drought_class FROM st""",
)
def live_state(spark, sf):
    a = anomaly_of(spark, sf)[3]
    out = an.live_state(a, a, K)
    return out.select(r("temp_anomaly"), r("mean_temp"), r("rain_anomaly_pct"), r("precip_30d"), r("soil_moisture"), "drought_class")


@query(
    "marker_sample",
    f"""{SHIP}, {GCLIM}, {SNAP}, {tb.MARKERS},
    la AS (SELECT name, x.lat AS clat FROM markers m, (SELECT DISTINCT lat FROM anom) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(x.lat - m.lat), x.lat) = 1),
    lo AS (SELECT name, x.lon AS clon FROM markers m, (SELECT DISTINCT lon FROM anom) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(x.lon - m.lon), x.lon) = 1)
    SELECT name, clat AS cell_lat, clon AS cell_lon, round(value, 4) AS value, round(anomaly, 4) AS anomaly
    FROM la JOIN lo USING (name) LEFT JOIN anom ON anom.lat = clat AND anom.lon = clon""",
)
def marker_sample(spark, sf):
    field = anomaly_of(spark, sf)[3].select("source", "lat", "lon", "value", "anomaly")
    points = tb.markers(spark, sf)
    m = gr.sample_markers(field, points, K)
    return m.select("name", "cell_lat", "cell_lon", r("value"), r("anomaly"))


REGRID = """tlat AS (SELECT DISTINCT round(29.5 + i * 0.25, 4) AS t FROM range(0, 21) x(i)), tlon AS (SELECT round(69.5 + i * 0.25, 4) AS t FROM range(0, 21) x(i)),
slat AS (SELECT DISTINCT lat AS v FROM grid_ship), slon AS (SELECT DISTINCT lon AS v FROM grid_ship),
blat AS (SELECT t, max(v) FILTER (WHERE v <= t) AS lo, min(v) FILTER (WHERE v >= t) AS hi FROM tlat, slat GROUP BY t),
blon AS (SELECT t, max(v) FILTER (WHERE v <= t) AS lo, min(v) FILTER (WHERE v >= t) AS hi FROM tlon, slon GROUP BY t)"""
W4 = """wlat AS (SELECT t, lo, hi, CASE WHEN hi = lo THEN 0 ELSE (t - lo) / (hi - lo) END AS f FROM blat WHERE lo IS NOT NULL AND hi IS NOT NULL),
wlon AS (SELECT t, lo, hi, CASE WHEN hi = lo THEN 0 ELSE (t - lo) / (hi - lo) END AS f FROM blon WHERE lo IS NOT NULL AND hi IS NOT NULL)"""
BBOX = (29.5, 34.5, 69.5, 74.5)


@query(
    "bilinear_regrid",
    f"""{SHIP}, {GCLIM}, {REGRID}, {W4}
    SELECT g00.month AS month, CAST(a.t AS DOUBLE) AS lat, CAST(o.t AS DOUBLE) AS lon, round((1 - a.f) * ((1 - o.f) * g00.value + o.f * g01.value) + a.f * ((1 - o.f) * g10.value + o.f * g11.value), 4) AS value
    FROM wlat a CROSS JOIN wlon o JOIN gclim g00 ON g00.lat = a.lo AND g00.lon = o.lo
      JOIN gclim g01 ON g01.lat = a.lo AND g01.lon = o.hi AND g01.month = g00.month
      JOIN gclim g10 ON g10.lat = a.hi AND g10.lon = o.lo AND g10.month = g00.month
      JOIN gclim g11 ON g11.lat = a.hi AND g11.lon = o.hi AND g11.month = g00.month""",
)
def bilinear_regrid(spark, sf):
    _, c = ship(spark, sf)
    out = gr.regrid_bilinear(c, BBOX, 0.25, K, [*K, "month"]).filter("value is not null")
    return out.select(i("month"), "lat", "lon", r("value"))


@query(
    "regrid_daily_stats",
    f"""{SHIP}, {REGRID}, {W4},
    parts AS (SELECT g.obs_date, a.t AS lat, o.t AS lon, sum(g.value * (CASE WHEN g.lat = a.lo THEN 1 - a.f ELSE a.f END) * (CASE WHEN g.lon = o.lo THEN 1 - o.f ELSE o.f END)) AS v,
        sum((CASE WHEN g.lat = a.lo THEN 1 - a.f ELSE a.f END) * (CASE WHEN g.lon = o.lo THEN 1 - o.f ELSE o.f END)) AS w
      FROM grid_ship g JOIN wlat a ON g.lat IN (a.lo, a.hi) JOIN wlon o ON g.lon IN (o.lo, o.hi) GROUP BY ALL)
    SELECT CAST(obs_date AS VARCHAR) AS obs_date, count(*) AS valid_cells, round(avg(v), 4) AS mean, round(min(v), 4) AS vmin, round(max(v), 4) AS vmax
    FROM parts WHERE w > 1 - 1e-9 GROUP BY obs_date""",
)
def regrid_daily_stats(spark, sf):
    g = shared(tb.grid_ship(spark, sf))
    out = gr.regrid_bilinear(g, BBOX, 0.25, K, [*K, "obs_date"])
    st = an.field_summary(out, ["obs_date"]).filter("valid_cells > 0")
    return st.select(s("obs_date"), "valid_cells", r("mean"), r("vmin"), r("vmax"))


@query(
    "field_thinned",
    f"""WITH {tb.GRID_EVENTS}, m AS (SELECT source, lat, lon, avg(value) AS value FROM grid_events GROUP BY 1, 2, 3),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY lat) - 1 AS ry, dense_rank() OVER (PARTITION BY source ORDER BY lon) - 1 AS rx FROM m),
    n AS (SELECT source, greatest(1, (max(ry) + 1) // 7) AS sy, greatest(1, (max(rx) + 1) // 7) AS sx FROM k GROUP BY source)
    SELECT source, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value, 4) AS value, 'mm/day' AS units FROM k JOIN n USING (source) WHERE ry % sy = 0 AND rx % sx = 0""",
)
def field_thinned(spark, sf):
    g = shared(tb.grid_events(spark, sf))
    meta = g.select("source").distinct().withColumn("units", F.lit("mm/day"))
    return an.field_view(g, meta, K, max_cells=7).select("source", r("lat"), r("lon"), r("value"), "units")


@query(
    "field_nested",
    f"""WITH {tb.GRID_EVENTS}, m AS (SELECT source, lat, lon, avg(value) AS value FROM grid_events GROUP BY 1, 2, 3),
    ax AS (SELECT source, count(DISTINCT lat) AS ny, count(DISTINCT lon) AS nx FROM m GROUP BY 1)
    SELECT source, ny, nx, n, checksum FROM ax JOIN (SELECT source, count(value) AS n, round(sum(round(value, 2) * ry), 2) AS checksum
      FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY lat) AS ry FROM m) GROUP BY source) USING (source)""",
)
def field_nested(spark, sf):
    """Fields as nested arrays; shape and a row-weighted checksum of each."""
    d = an.as_nested(cl.field_mean(shared(tb.grid_events(spark, sf)), K), K)
    flat = F.flatten(F.transform("values", lambda row, k: F.transform(row, lambda v: v * (k + 1))))
    total = F.aggregate(F.array_compact(flat), F.lit(0.0), lambda a, x: a + x)
    return d.select("source", i(F.size("lats"), "ny"), i(F.size("lons"), "nx"), i(F.size(F.array_compact(flat)), "n"), r(total, 2, "checksum"))


@query(
    "nearest_resample",
    f"""{SHIP}, {GCLIM}, {SNAP}, tl AS (SELECT round(29.8 + i * 0.7, 4) AS t FROM range(0, 7) x(i)), tn AS (SELECT round(69.9 + i * 0.7, 4) AS t FROM range(0, 7) x(i)),
    la AS (SELECT t, v.lat AS c FROM tl, (SELECT DISTINCT lat FROM anom) v QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(v.lat - t), v.lat) = 1),
    lo AS (SELECT t, v.lon AS c FROM tn, (SELECT DISTINCT lon FROM anom) v QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(v.lon - t), v.lon) = 1)
    SELECT CAST(la.t AS DOUBLE) AS lat, CAST(lo.t AS DOUBLE) AS lon, round(value, 4) AS value FROM la CROSS JOIN lo LEFT JOIN anom ON anom.lat = la.c AND anom.lon = lo.c""",
)
def nearest_resample(spark, sf):
    field = anomaly_of(spark, sf)[3].select("source", "lat", "lon", "value")
    ax = field.select("source").distinct().withColumns(
        {
            "lats": F.array(*[F.lit(v) for v in gr.axis_values(29.8, 34.0, 0.7)]),
            "lons": F.array(*[F.lit(v) for v in gr.axis_values(69.9, 74.1, 0.7)]),
        }
    )
    return gr.resample_nearest(field, ax, K).select("lat", "lon", r("value"))


@query(
    "grid_persistence",
    f"""{SHIP}, {GCLIM}, {SNAP} SELECT a.lat, a.lon, l.range AS lead, CAST(CAST(end_date + CAST(l.range AS INT) AS DATE) AS VARCHAR) AS target_date,
      round(c.value + a.anomaly * pow(0.6, l.range), 4) AS value, round(a.anomaly * pow(0.6, l.range), 4) AS anomaly
      FROM anom a CROSS JOIN fin CROSS JOIN range(1, 15) l LEFT JOIN gclim c ON c.lat = a.lat AND c.lon = a.lon AND c.month = month(CAST(end_date + CAST(l.range AS INT) AS DATE))""",
)
def grid_persistence(spark, sf):
    g, c, _, a = anomaly_of(spark, sf)
    ends = g.groupBy(*K).agg(F.max("obs_date").alias("end_date"))
    f = gf.persistence_forecast(a, c, ends, K)
    return f.select("lat", "lon", i("lead"), s("target_date"), r("value"), r("anomaly"))


@query(
    "grid_persistence_skill",
    f"""{SHIP}, {GCLIM}, a AS (SELECT g.lat, g.lon, g.obs_date, g.value - c.value AS anom FROM grid_ship g JOIN gclim c ON c.lat = g.lat AND c.lon = g.lon AND c.month = month(g.obs_date)),
    t AS (SELECT * FROM a WHERE obs_date > (SELECT max(obs_date) - 365 FROM a)),
    base AS (SELECT sqrt(avg(anom * anom)) AS clim_rmse FROM t),
    p AS (SELECT l AS lead, sqrt(avg(pow(b.anom * pow(0.6, l) - t.anom, 2))) AS rmse, count(*) AS n FROM t CROSS JOIN (VALUES (1), (7), (14)) v(l)
      JOIN a b ON b.lat = t.lat AND b.lon = t.lon AND b.obs_date = CAST(t.obs_date - CAST(l AS INT) AS DATE) GROUP BY l)
    SELECT CAST(lead AS BIGINT) AS lead, n, round(clim_rmse, 4) AS clim_rmse, round(rmse, 4) AS rmse, round((1 - rmse / clim_rmse) * 100, 4) AS skill_pct FROM p, base""",
)
def grid_persistence_skill(spark, sf):
    g, c = ship(spark, sf)
    return gf.persistence_skill(g, c, K).select(i("lead"), "n", r("clim_rmse"), r("rmse"), r("skill_pct"))


NORMALS = """pts AS (SELECT lat, lon, month, value, [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5][month] AS mid FROM gclim WHERE month <= 12),
ring AS (SELECT lat, lon, mid, value FROM pts UNION ALL SELECT lat, lon, mid - 365, value FROM pts WHERE month = 12 UNION ALL SELECT lat, lon, mid + 365, value FROM pts WHERE month = 1),
seg AS (SELECT lat, lon, mid AS a, value AS va, lead(mid) OVER w AS b, lead(value) OVER w AS vb FROM ring WINDOW w AS (PARTITION BY lat, lon ORDER BY mid)),
normals AS (SELECT lat, lon, d.range AS doy, va + (vb - va) * (d.range - a) / (b - a) AS normal FROM seg JOIN range(1, 367) d ON d.range >= a AND d.range < b),
an AS (SELECT g.lat, g.lon, g.obs_date, g.value - n.normal AS anom, date_diff('day', DATE '1970-01-01', g.obs_date) AS t FROM grid_ship g JOIN normals n ON n.lat = g.lat AND n.lon = g.lon AND n.doy = dayofyear(g.obs_date)),
sp AS (SELECT min(t) AS t0, max(t) - min(t) + 1 AS n FROM an),
past AS (SELECT lat, lon, t, anom, avg(anom) OVER (c RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s1, avg(anom) OVER (c RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING) AS s3,
    avg(anom) OVER (c RANGE BETWEEN 9 PRECEDING AND 7 PRECEDING) AS s7, avg(anom) OVER (c RANGE BETWEEN 16 PRECEDING AND 14 PRECEDING) AS s14 FROM an WINDOW c AS (PARTITION BY lat, lon ORDER BY t)),
rws AS (SELECT y.lat, y.lon, y.t, l AS lead, y.t - t0 - l AS issue, y.t - t0 - l < floor(n * 0.75) AS fit, y.anom AS y,
    coalesce(CASE l WHEN 1 THEN s1 WHEN 3 THEN s3 WHEN 7 THEN s7 ELSE s14 END, 0) AS s
  FROM past y CROSS JOIN sp CROSS JOIN (VALUES (1), (3), (7), (14)) v(l) WHERE y.t - t0 - l >= 3 AND (y.t - t0 - l - 3) % 2 = 0),
ph AS (SELECT lead, greatest(0, least(1, sum(s * y) / (sum(s * s) + 1e-9))) AS phi FROM rws WHERE fit GROUP BY lead)"""


def phi_rows(spark, sf):
    g, c = ship(spark, sf)
    return g, c, gf.issue_rows(gf.daily_anomaly(g, c, K), K)


@query(
    "phi_decay",
    f"""{SHIP}, {GCLIM}, {NORMALS} SELECT CAST(lead AS BIGINT) AS lead, round(any_value(phi), 5) AS phi, round(sqrt(avg(pow(phi * s - y, 2))), 4) AS rmse, round(sqrt(avg(y * y)), 4) AS clim_rmse,
      round(sqrt(avg(pow(pow(0.6, lead) * s - y, 2))), 4) AS persist_rmse, count(*) AS n_test,
      round((1 - sqrt(avg(pow(phi * s - y, 2))) / sqrt(avg(y * y))) * 100, 4) AS skill_vs_clim_pct FROM rws JOIN ph USING (lead) WHERE NOT fit GROUP BY lead""",
)
def phi_decay(spark, sf):
    _, _, rows = phi_rows(spark, sf)
    p = gf.fit_phi(rows, K)
    return p.select(i("lead"), r("phi", 5), r("rmse"), r("clim_rmse"), r("persist_rmse"), "n_test", r("skill_vs_clim_pct"))


@query(
    "grid_forecast",
    f"""{SHIP}, {GCLIM}, {NORMALS.replace("normals AS (", "normals AS MATERIALIZED (").replace("an AS (", "an AS MATERIALIZED (").replace("ph AS (", "ph AS MATERIALIZED (")},
    nd AS (SELECT obs_date, count(value) AS n FROM grid_ship GROUP BY 1), nc AS (SELECT count(*) AS c FROM (SELECT DISTINCT lat, lon FROM grid_ship)),
    sd AS MATERIALIZED (SELECT max(obs_date) AS d FROM nd, nc WHERE n / c > 0.5),
    seed AS MATERIALIZED (SELECT lat, lon, avg(anom) AS s FROM an, sd WHERE obs_date BETWEEN d - 2 AND d GROUP BY 1, 2),
    lp AS (SELECT lead AS l0, ln(greatest(1e-4, phi)) AS p0, lead(lead) OVER (ORDER BY lead) AS l1, lead(ln(greatest(1e-4, phi))) OVER (ORDER BY lead) AS p1 FROM ph),
    days AS MATERIALIZED (SELECT x.range AS lead, CAST(d + CAST(x.range AS INT) AS DATE) AS target, dayofyear(CAST(d + CAST(x.range AS INT) AS DATE)) AS doy,
        exp(CASE WHEN x.range = l0 OR l1 IS NULL THEN p0 ELSE p0 + (p1 - p0) * (x.range - l0) / (l1 - l0) END) AS phi
      FROM range(1, 15) x, sd, lp WHERE x.range >= l0 AND (l1 IS NULL OR x.range < l1)),
    cells AS (SELECT DISTINCT lat, lon FROM gclim)
    SELECT c.lat, c.lon, p.lead, CAST(target AS VARCHAR) AS target_date, round(greatest(0, n.normal + phi * coalesce(s, 0)), 4) AS value, round(phi * coalesce(s, 0), 4) AS anomaly
    FROM cells c JOIN normals n USING (lat, lon) JOIN days p USING (doy) LEFT JOIN seed USING (lat, lon)""",
)
def grid_forecast(spark, sf):
    g, c, rows = phi_rows(spark, sf)
    f = gf.damped_forecast(g, c, gf.fit_phi(rows, K), K, floor=0.0)
    return f.select("lat", "lon", i("lead"), s("target_date"), r("value"), r("anomaly"))


PAIRS = f"""WITH {tb.GRID_ORDERS}, {tb.GRID_SHIP}, {tb.SHIP_DAILY},
pairs AS (SELECT o.obs_date, o.lat, o.lon, o.value AS a, s.value AS b, d.tmean AS truth FROM grid_orders o JOIN grid_ship s USING (obs_date, lat, lon) LEFT JOIN ship_daily d USING (obs_date)),
bias AS (SELECT lat, lon, avg(a - truth) AS ba, avg(b - truth) AS bb, count(*) AS n FROM pairs WHERE truth IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
mom AS (SELECT lat, lon, any_value(n) AS n, any_value(ba) AS bias_a, any_value(bb) AS bias_b, avg(pow(a - truth - ba, 2)) AS va, avg(pow(b - truth - bb, 2)) AS vb, avg((a - truth - ba) * (b - truth - bb)) AS c
  FROM pairs JOIN bias USING (lat, lon) WHERE truth IS NOT NULL GROUP BY 1, 2),
wts AS (SELECT *, CASE WHEN va + vb - 2 * c > 1e-9 THEN greatest(0, least(1, (vb - c) / (va + vb - 2 * c))) ELSE 0.5 END AS w_a FROM mom)"""


def pairs_of(spark, sf):
    p = fu.pair_sources(tb.grid_orders(spark, sf), shared(tb.grid_ship(spark, sf)))
    truth = tb.ship_daily(spark, sf).select("obs_date", F.col("tmean").alias("truth"))
    return shared(p.join(truth, "obs_date", "left"))


@query(
    "blue_fusion",
    f"""{PAIRS} SELECT lat, lon, n, round(bias_a, 4) AS bias_a, round(bias_b, 4) AS bias_b, round(sqrt(va), 4) AS rmse_a, round(sqrt(vb), 4) AS rmse_b,
      round(w_a, 4) AS w_a, round(c / (sqrt(va * vb) + 1e-12), 4) AS error_corr, round(sqrt(w_a * w_a * va + (1 - w_a) * (1 - w_a) * vb + 2 * w_a * (1 - w_a) * c), 4) AS rmse_fused FROM wts""",
)
def blue_fusion(spark, sf):
    b = fu.blue_statistics(pairs_of(spark, sf), ["lat", "lon"])
    cols = ["bias_a", "bias_b", "rmse_a", "rmse_b", "w_a", "error_corr", "rmse_fused"]
    return b.select("lat", "lon", "n", *[r(c) for c in cols])


FUSED = f"""WITH {tb.GRID_ORDERS}, {tb.GRID_SHIP}, {tb.SHIP_DAILY}, {GCLIM},
pairs AS (SELECT o.obs_date, o.lat, o.lon, o.value AS a, s.value AS b, d.tmean AS truth, strftime(obs_date, '%Y') AS wid
  FROM grid_orders o JOIN grid_ship s USING (obs_date, lat, lon) LEFT JOIN ship_daily d USING (obs_date)),
stn AS (SELECT * FROM pairs WHERE lat = 32 AND lon = 73 AND truth IS NOT NULL),
cand AS (SELECT wid, count(*) AS n, avg(a - truth) AS ba, avg(b - truth) AS bb, var_pop(a - truth) AS va, var_pop(b - truth) AS vb, covar_pop(a - truth, b - truth) AS c FROM stn GROUP BY wid HAVING count(*) >= 5),
pick AS (SELECT * FROM cand ORDER BY wid DESC LIMIT 1),
live AS (SELECT max(wid) AS live_id FROM pairs),
w AS (SELECT live_id, wid AS weights_from, coalesce(ba, 0) AS ba, coalesce(bb, 0) AS bb,
  CASE WHEN wid IS NULL THEN 0.5 WHEN va + vb - 2 * c > 1e-9 THEN greatest(0, least(1, (vb - c) / (va + vb - 2 * c))) ELSE 0.5 END AS wa FROM live LEFT JOIN pick ON true),
mn AS (SELECT lat, lon, avg(a) AS fa, avg(b) AS fb FROM pairs, live WHERE wid = live_id GROUP BY 1, 2),
nrm AS (SELECT lat, lon, avg(value) AS normal FROM gclim WHERE month IN (SELECT month(obs_date) FROM pairs, live WHERE wid = live_id) GROUP BY 1, 2),
fused AS (SELECT lat, lon, wa * fa + (1 - wa) * (fb - (bb - ba)) AS value, abs(fa - (fb - (bb - ba))) AS spread, wa * fa + (1 - wa) * (fb - (bb - ba)) - normal AS anomaly FROM mn CROSS JOIN w LEFT JOIN nrm USING (lat, lon))"""


def fused_of(spark, sf):
    """Live window = newest calendar year of the pair; older years calibrate."""
    p = pairs_of(spark, sf).withColumns({"region": tb.named("r", "lat"), "window_id": F.date_format("obs_date", "yyyy")})
    keys = ["region"]
    windows = p.groupBy("region", "window_id").agg(F.max("window_id").alias("window_end"))
    station = p.filter((F.col("lat") == 32.0) & (F.col("lon") == 73.0))
    weights = shared(fu.choose_weights(windows, fu.blue_statistics(station, ["region", "window_id"]), keys))
    live = p.join(weights.select("region", F.col("live_id").alias("window_id")), ["region", "window_id"], "left_semi")
    clim = cl.monthly_grid_climatology(shared(tb.grid_ship(spark, sf)), []).withColumn("region", tb.named("r", "lat"))
    return weights, fu.fuse_fields(live, weights, clim, keys)


@query(
    "fused_field",
    f"{FUSED} SELECT lat, lon, round(value, 4) AS value, round(spread, 4) AS spread, round(anomaly, 4) AS anomaly FROM fused",
)
def fused_field(spark, sf):
    return fused_of(spark, sf)[1].select("lat", "lon", r("value"), r("spread"), r("anomaly"))


@query(
    "fusion_weights",
    f"""{FUSED} SELECT live_id, weights_from, CAST(coalesce(weights_from <> live_id, true) AS INT) AS calibrated, round(wa, 4) AS w_a, round(spread_mean, 4) AS spread_mean, round(spread_max, 4) AS spread_max
      FROM w, (SELECT avg(spread) AS spread_mean, max(spread) AS spread_max FROM fused)""",
)
def fusion_weights(spark, sf):
    w, f = fused_of(spark, sf)
    j = w.join(fu.spread_summary(f, ["region"]), "region")
    return j.select("live_id", "weights_from", F.col("calibrated").cast("int").alias("calibrated"), r("w_a"), r("spread_mean"), r("spread_max"))


@query(
    "cressman_field",
    f"""{SHIP}, {GCLIM}, {SNAP}, {tb.MARKERS},
    la AS (SELECT name, x.lat AS clat FROM markers m, (SELECT DISTINCT lat FROM anom) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(x.lat - m.lat), x.lat) = 1),
    lo AS (SELECT name, x.lon AS clon FROM markers m, (SELECT DISTINCT lon FROM anom) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(x.lon - m.lon), x.lon) = 1),
    ob AS (SELECT m.lat, m.lon, m.obs - a.value AS incr FROM markers m JOIN la USING (name) JOIN lo USING (name) JOIN anom a ON a.lat = clat AND a.lon = clon),
    k AS (SELECT g.lat, g.lon, o.incr, (1 - d2) / (1 + d2) AS w FROM (SELECT g.lat AS glat, g.lon AS glon, ob.*, pow(g.lat - ob.lat, 2) + pow(g.lon - ob.lon, 2) AS d2 FROM val g, ob) o JOIN val g ON g.lat = glat AND g.lon = glon WHERE d2 < 1)
    SELECT v.lat, v.lon, round(v.value, 4) AS value, round(v.value + coalesce(0.6 * c.wi / greatest(1, c.wn), 0), 4) AS fused
    FROM val v LEFT JOIN (SELECT lat, lon, sum(w * incr) AS wi, sum(w) AS wn FROM k GROUP BY 1, 2) c USING (lat, lon)""",
)
def cressman_field(spark, sf):
    field = anomaly_of(spark, sf)[3].select("source", "lat", "lon", "value")
    obs = tb.markers(spark, sf)
    return fu.cressman(field, obs, K).select("lat", "lon", r("value"), r("fused"))


def monthly_fields(grid):
    return shared(cl.field_mean(grid.withColumn("ym", F.date_format("obs_date", "yyyy-MM")), ["ym"]))


# the order-exact replay: one step of the recursion for each cell of a month, on lists of its cells
SURFACE = f"""WITH RECURSIVE {tb.GRID_SHIP}, {tb.GRID_ORDERS},
air AS (SELECT strftime(obs_date, '%Y-%m') AS ym, lat, lon, avg(value) AS v FROM grid_ship GROUP BY ALL),
skin AS (SELECT strftime(obs_date, '%Y-%m') AS ym, lat, lon, avg(value) AS v FROM grid_orders GROUP BY ALL),
la AS (SELECT ym, a.lat, s.lat AS clat FROM (SELECT DISTINCT ym, lat FROM air) a JOIN (SELECT DISTINCT ym, lat FROM skin) s USING (ym) QUALIFY row_number() OVER (PARTITION BY ym, a.lat ORDER BY abs(s.lat - a.lat), s.lat) = 1),
lo AS (SELECT ym, a.lon, s.lon AS clon FROM (SELECT DISTINCT ym, lon FROM air) a JOIN (SELECT DISTINCT ym, lon FROM skin) s USING (ym) QUALIFY row_number() OVER (PARTITION BY ym, a.lon ORDER BY abs(s.lon - a.lon), s.lon) = 1),
cells AS (SELECT air.ym, air.lat, air.lon, air.v, skin.v AS obs FROM air LEFT JOIN la ON la.ym = air.ym AND la.lat = air.lat LEFT JOIN lo ON lo.ym = air.ym AND lo.lon = air.lon
  LEFT JOIN skin ON skin.ym = air.ym AND skin.lat = la.clat AND skin.lon = lo.clon),
ls AS (SELECT ym, count(*) AS n, list(v ORDER BY lat, lon) AS v, list(obs ORDER BY lat, lon) AS o, list(lat ORDER BY lat, lon) AS ys, list(lon ORDER BY lat, lon) AS xs FROM cells GROUP BY ym),
step AS (SELECT ym, 1::BIGINT AS k, v AS g FROM ls
  UNION ALL SELECT ym, k + 1, CASE WHEN o[k] IS NULL OR g[k] IS NULL THEN g ELSE list_transform(range(1, n + 1), lambda i: g[i] + 0.5::DOUBLE
    * greatest((0.36::DOUBLE - (pow(ys[i] - ys[k], 2) + pow(xs[i] - xs[k], 2))) / (0.36::DOUBLE + (pow(ys[i] - ys[k], 2) + pow(xs[i] - xs[k], 2))), 0) * (o[k] - g[k])) END
  FROM step JOIN ls USING (ym) WHERE k <= n),
done AS (SELECT ym, unnest(ys) AS lat, unnest(xs) AS lon, unnest(v) AS value, unnest(o) AS obs, unnest(g) AS fused FROM step JOIN ls USING (ym) WHERE k = n + 1)"""


@query(
    "surface_fusion",
    f"""{SURFACE} SELECT ym, lat, lon, round(value, 4) AS value, round(fused, 4) AS fused, round(fused - value, 4) AS adjustment FROM done""",
)
def surface_fusion(spark, sf):
    """Order-exact assimilation for every month of the record."""
    f = fu.surface_fusion(monthly_fields(tb.grid_ship(spark, sf)), monthly_fields(tb.grid_orders(spark, sf)), ["ym"])
    return f.select("ym", "lat", "lon", r("value"), r("fused"), r("adjustment"))


@query(
    "surface_fusion_summary",
    f"""{SURFACE} SELECT ym, count(obs) AS n_obs, round(coalesce(avg(abs(fused - value)), 0), 4) AS mean_abs_adjustment, round(coalesce(max(abs(fused - value)), 0), 4) AS max_abs_adjustment FROM done GROUP BY ym""",
)
def surface_fusion_summary(spark, sf):
    f = fu.surface_fusion(monthly_fields(tb.grid_ship(spark, sf)), monthly_fields(tb.grid_orders(spark, sf)), ["ym"])
    a = fu.adjustment_summary(f, ["ym"])
    return a.select("ym", "n_obs", r("mean_abs_adjustment"), r("max_abs_adjustment"))


# --------------------------------------------------------------------------- catalogue
CAT = f"WITH {tb.CATALOGUE}"


@query(
    "catalog_pick",
    f"""{CAT} SELECT DISTINCT ON (var, region) var, region, id, source, days FROM catalogue WHERE kind IS NULL AND days <= 30 AND contains(lower(source), 'i')
      ORDER BY var, region, created_at DESC, ord""",
)
def catalog_pick(spark, sf):
    c = ct.find(tb.catalogue(spark, sf), False, max_days=30, source_contains="I")
    return ct.newest(c, ["var", "region"]).select("var", "region", "id", "source", "days")


@query(
    "catalog_fallback",
    f"""{CAT} SELECT DISTINCT ON (var, region) var, region, id, days FROM catalogue WHERE kind IS NULL
      ORDER BY var, region, CASE WHEN days <= 29 AND contains(lower(source), 'click') THEN 2 WHEN days <= 29 THEN 1 ELSE 0 END DESC, created_at DESC, ord""",
)
def catalog_fallback(spark, sf):
    return ct.preferred(tb.catalogue(spark, sf), ["var", "region"], "Click", max_days=29).select("var", "region", "id", "days")


@query(
    "catalog_available",
    f"""{CAT} SELECT var, region FROM catalogue WHERE kind IS NULL INTERSECT SELECT var, region FROM catalogue WHERE kind = 'climatology'""",
)
def catalog_available(spark, sf):
    return ct.available(tb.catalogue(spark, sf), ["var", "region"])


@query(
    "catalog_both_sources",
    f"""{CAT} SELECT var, region FROM catalogue WHERE source = 'view' AND days <= 180 INTERSECT SELECT var, region FROM catalogue WHERE source = 'error' AND days <= 180""",
)
def catalog_both_sources(spark, sf):
    return ct.available_in_both(tb.catalogue(spark, sf), ["var", "region"], "view", "error")


@query(
    "interval_overlap",
    f"""{CAT}, l AS (SELECT * FROM catalogue WHERE source = 'view'), rr AS (SELECT * FROM catalogue WHERE source = 'click'),
    j AS (SELECT l.var, l.region, l.id AS left_id, rr.id AS right_id, rr.days, rr.end_ymd,
        date_diff('day', strptime(greatest(l.start_ymd, rr.start_ymd), '%Y%m%d'), strptime(least(l.end_ymd, rr.end_ymd), '%Y%m%d')) AS overlap_days,
        rr.start_ymd FROM l JOIN rr ON l.var = rr.var AND l.region = rr.region AND rr.end_ymd >= l.start_ymd AND rr.start_ymd <= l.end_ymd),
    g AS (SELECT var, region, start_ymd, end_ymd, days, min(id) AS first_id FROM rr GROUP BY ALL)
    SELECT DISTINCT ON (left_id) j.var, j.region, left_id, first_id AS right_id, overlap_days FROM j JOIN g USING (var, region, start_ymd, end_ymd, days)
    ORDER BY left_id, overlap_days DESC, days, end_ymd DESC, first_id DESC""",
)
def interval_overlap(spark, sf):
    c = tb.catalogue(spark, sf)
    o = fu.overlapping_pairs(c.filter("source = 'view'"), c.filter("source = 'click'"), ["var", "region"])
    return o.select("var", "region", "left_id", "right_id", i("overlap_days"))


@query(
    "catalog_staleness",
    f"""{CAT}, n AS (SELECT source, var, region, max(end_ymd) AS newest_end FROM catalogue WHERE kind IS NULL GROUP BY ALL),
    jobs AS (SELECT DISTINCT source, var, region FROM catalogue)
    SELECT source, var, region, newest_end, CAST(coalesce(newest_end, '') < '20240130' AS INT) AS stale,
      CASE WHEN date_diff('day', strptime(newest_end, '%Y%m%d'), TIMESTAMP '2024-02-06') <= 7 THEN 'active' ELSE 'stale' END AS status
    FROM jobs LEFT JOIN n USING (source, var, region)""",
)
def catalog_staleness(spark, sf):
    c = tb.catalogue(spark, sf)
    keys = ["source", "var", "region"]
    st = ct.stale_jobs(c.select(*keys).distinct(), c, F.lit("20240130"), keys)
    feed = ct.feed_status(c, F.lit("2024-02-06").cast("date"), keys).select(*keys, "status")
    out = st.join(feed, keys, "left").fillna("stale", subset=["status"])
    return out.select(*keys, "newest_end", F.col("stale").cast("int").alias("stale"), "status")


@query(
    "catalog_upsert",
    f"""{CAT}, inc AS (SELECT id, 'refreshed' AS status FROM catalogue WHERE source = 'click')
    SELECT id, status FROM inc UNION ALL SELECT id, 'ingested' FROM catalogue WHERE id NOT IN (SELECT id FROM inc)""",
)
def catalog_upsert(spark, sf):
    c = tb.catalogue(spark, sf)
    cur = c.select("id", F.lit("ingested").alias("status"))
    inc = c.filter("source = 'click'").select("id", F.lit("refreshed").alias("status"))
    return ct.upsert(cur, inc).select("id", "status")
