"""Queries that land a given table in the shared folder with a sink, read it back, and go on from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions.calendar import dataset_id
from terraloom.operators import climatology as cl
from terraloom.operators import components as co
from terraloom.operators import focal as fo
from terraloom.operators import forecast as fc
from terraloom.operators import grid as gr
from terraloom.operators import grid_forecast as gf
from terraloom.plans import forecast_queries as fq
from terraloom.plans import grid_queries as gq
from terraloom.plans import scene_queries as sq
from terraloom.plans.registry import ORACLES, query
from terraloom.plans.shape import i, r, s, shared
from terraloom.session import scratch_path
from terraloom.sources import readers as rd
from terraloom.sources import sinks as sk
from terraloom.sources import tables as tb

SHIP = f"WITH {tb.GRID_SHIP}"


@query(
    "record_file",
    f"""WITH {tb.DAILY} SELECT CAST(obs_date AS VARCHAR) AS obs_date, round(tmean, 4) AS tmean, round(CASE WHEN dayofyear(obs_date) % 7 = 0 THEN tmax ELSE tmin END, 4) AS tmin, round(tmax, 4) AS tmax,
      round(greatest(precip - 1, 0), 4) AS precip FROM daily WHERE dayofyear(obs_date) % 11 <> 0""",
)
def record_file(spark, sf):
    """Daily records written as delimited text with gaps and read as a file."""
    n, path = F.dayofyear("obs_date"), scratch_path(spark, "record")
    tb.daily(spark, sf).select(
        F.when(n % 11 == 0, "no date").otherwise(F.col("obs_date").cast("string")).alias("ds"), F.col("tmean").cast("string").alias("temp_mean"),
        F.when(n % 7 != 0, F.col("tmin").cast("string")).alias("temp_min"), F.col("tmax").cast("string").alias("temp_max"), (F.col("precip") - 1).cast("string").alias("precip"),
    ).write.option("header", True).csv(path)
    return rd.read_record_csv(spark, path).select(s("obs_date"), r("tmean"), r("tmin"), r("tmax"), r("precip"))


@query(
    "grid_chunks",
    f"""{SHIP} SELECT CAST(obs_date AS VARCHAR) AS obs_date, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value, 4) AS value FROM grid_ship""",
)
def grid_chunks(spark, sf):
    """A field stored as one set for each calendar year; the years' scans put together again."""
    g = shared(tb.grid_ship(spark, sf).withColumns({"var": F.lit("rain"), "region": F.lit("r")}))
    path = scratch_path(spark, "chunks")
    first, last = g.agg(F.min(F.year("obs_date")), F.max(F.year("obs_date"))).first()
    for year in range(first, last + 1):
        sk.write_grid(g.filter(F.year("obs_date") == year), path)
    chunks = [rd.read_grid(spark, path, "rain", "r", f"{year}0101", f"{year}1231") for year in range(first, last + 1)]
    return rd.concat_chunks(chunks).select(s("obs_date"), r("lat"), r("lon"), r("value"))


@query("climatology_steps", f"""{SHIP}, {gq.GCLIM} SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, CAST(month AS BIGINT) AS month, round(value, 4) AS value FROM gclim""")
def climatology_steps(spark, sf):
    """The 13 steps of a stored climatology whose axis is called time."""
    path = scratch_path(spark, "steps")
    cl.monthly_grid_climatology(tb.grid_ship(spark, sf), ["source"]).withColumnRenamed("month", "time").write.parquet(path)
    return rd.climatology_steps(spark.read.parquet(path)).select(r("lat"), r("lon"), i("month"), r("value"))


@query("coordinate_names", f"""WITH {tb.GRID_EVENTS} SELECT source, round(lat, 4) AS lat, round(lon, 4) AS lon, count(*) AS n, round(avg(value), 4) AS value FROM grid_events GROUP BY ALL""")
def coordinate_names(spark, sf):
    """A field stored with other spellings of its coordinates."""
    path = scratch_path(spark, "names")
    tb.grid_events(spark, sf).withColumnsRenamed({"lat": "Latitude", "lon": "x"}).write.parquet(path)
    g = rd.standard_coordinates(spark.read.parquet(path))
    return g.groupBy("source", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")).select("source", r("lat"), r("lon"), "n", r("value"))


@query(
    "stacked_bands",
    f"""WITH {tb.RASTER} SELECT scene_id, k.range AS band, y, x, round([b0, b1, b2, b3][k.range + 1], 5) AS value FROM raster, range(0, 4) k""",
)
def stacked_bands(spark, sf):
    """Stacks whose bands come first in odd scenes and last in even ones, told apart and put in one order."""
    px = tb.raster(spark, sf)
    d = px.select("scene_id", "y", "x", F.posexplode(F.array("b0", "b1", "b2", "b3")).alias("b", "value"))
    even = F.pmod("scene_id", F.lit(2)) == 0
    pick = lambda a, b: F.when(even, F.col(a)).otherwise(F.col(b))
    out = rd.bands_first(d.select("scene_id", pick("y", "b").alias("i"), pick("x", "y").alias("j"), pick("b", "x").alias("k"), "value"))
    return out.select("scene_id", i("band"), i("y"), i("x"), r("value", 5))


@query("named_bands", f"""WITH {tb.RASTER} SELECT scene_id, y, x, round(b3, 5) AS swir, round(b0, 5) AS green FROM raster WHERE scene_id % 3 <> 0""")
def named_bands(spark, sf):
    """Bands by number; scenes with too few bands are left out."""
    px = tb.raster(spark, sf)
    full = F.pmod("scene_id", F.lit(3)) != 0
    stack = px.select("scene_id", "y", "x", F.when(full, F.array("b0", "b1", "b2", "b3")).otherwise(F.array("b0", "b1")).alias("bands"))
    return rd.band_stack(stack, {"swir": 4, "green": 1}, ["scene_id"]).select("scene_id", i("y"), i("x"), r("swir", 5), r("green", 5))


@query(
    "grid_axes",
    f"""WITH {tb.GRID_EVENTS} SELECT source, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, round(min(lat), 4) AS lat0, round(max(lat), 4) AS lat1, round(min(lon), 4) AS lon0, round(max(lon), 4) AS lon1 FROM grid_events GROUP BY source""",
)
def grid_axes(spark, sf):
    a = gr.axes(tb.grid_events(spark, sf), ["source"])
    ends = lambda c, n: [r(F.element_at(c, 1), 4, f"{n}0"), r(F.element_at(c, -1), 4, f"{n}1")]
    return a.select("source", i(F.size("lats"), "n_lat"), i(F.size("lons"), "n_lon"), *ends("lats", "lat"), *ends("lons", "lon"))


@query("registered_sources", f"""WITH {tb.GRID_SHIP}, {tb.GRID_EVENTS} SELECT 'ship' AS feed, count(*) AS n, round(avg(value), 4) AS value FROM grid_ship UNION ALL SELECT 'events', count(*), round(avg(value), 4) FROM grid_events""")
def registered_sources(spark, sf):
    """Two readers of the registry, fetched by name."""
    rd.register_source("ship", lambda: tb.grid_ship(spark, sf))
    rd.register_source("events", lambda: tb.grid_events(spark, sf))
    both = [rd.fetch(n).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4, "value")).select(F.lit(n).alias("feed"), "n", "value") for n in ("ship", "events")]
    return both[0].unionByName(both[1])


@query(
    "catalog_file",
    f"""WITH {tb.CATALOGUE} SELECT id, source, var, region, days, CASE WHEN source = 'click' THEN 'refreshed' ELSE 'ingested' END AS status FROM catalogue WHERE region <> 'r1' OR source = 'click'""",
)
def catalog_file(spark, sf):
    """The catalogue written as a file, read, upserted with newer entries and written at a new place."""
    c = tb.catalogue(spark, sf).select("id", "source", "var", "region", "days")
    old, new = scratch_path(spark, "catalogue"), scratch_path(spark, "catalogue")
    sk.write_catalogue(c.filter("region <> 'r1'").withColumn("status", F.lit("ingested")), None, old)
    schema = "id string, source string, var string, region string, days bigint, status string"
    sk.write_catalogue(c.filter("source = 'click'").withColumn("status", F.lit("refreshed")), spark.read.schema(schema).json(old), new)
    return spark.read.schema(schema).json(new)


@query(
    "history_log",
    """SELECT CAST(doc_id AS VARCHAR) AS id, source AS owner, left(lang || '_' || CAST(doc_id AS VARCHAR) || repeat('x', n_chars % 90), 80) AS name, CASE WHEN n_chars % 3 = 0 THEN 'High' END AS severity,
      CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 1 END AS batch FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""",
)
def history_log(spark, sf):
    """Compact history records appended in two goes, named by the file's stem."""
    path, d = scratch_path(spark, "history"), tb.table(spark, sf, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    n = F.col("n_chars")
    name = F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.repeat(F.lit("x"), F.pmod(n, F.lit(90)).cast("int")), F.lit(".tif"))
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("owner"), name.alias("name"), F.when(F.pmod(n, F.lit(3)) == 0, "High").alias("severity"), F.pmod(n, F.lit(2)).cast("string").alias("mode"))
    for k in ("0", "1"):
        sk.write_history(rows.filter(F.col("mode") == k), path)
    return spark.read.parquet(path).select("id", "owner", "name", "severity", F.col("mode").cast("int").alias("batch"))


@query(
    "routed_documents",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, [NULL, 'analysis', 'change', 'disaster'][n_chars % 4 + 1] AS category, CASE WHEN n_chars % 5 = 0 THEN 'High' END AS severity FROM documents)
    SELECT 'analyses' AS kind, id, category, severity FROM d WHERE coalesce(category, 'analysis') = 'analysis' UNION ALL SELECT 'changes', * FROM d WHERE category = 'change'
    UNION ALL SELECT 'disasters', * FROM d WHERE category = 'disaster' OR (coalesce(category, 'analysis') = 'analysis' AND severity IS NOT NULL)""",
)
def routed_documents(spark, sf):
    """Documents routed to the collections of their category and read from there."""
    n = F.col("n_chars")
    kind = F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in ("analysis", "change", "disaster")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    d = tb.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), kind.alias("category"), F.when(F.pmod(n, F.lit(5)) == 0, "High").alias("severity"))
    paths = {k: scratch_path(spark, k) for k in ("analyses", "changes", "disasters")}
    sk.route_presets(d, paths)
    parts = [spark.read.schema("id string, category string, severity string").json(p).select(F.lit(k).alias("kind"), "*") for k, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("metrics_file", ORACLES["model_cards"])
def metrics_file(spark, sf):
    """Scores written as a metrics file and read back."""
    path, m = scratch_path(spark, "metrics"), fq.model_cards(spark, sf)
    sk.write_metrics(m, path)
    return spark.read.schema(m.schema).json(path)


@query(
    "model_gate",
    f"""{fq.BASE}, {fq.frame_sql('tmean')} SELECT station, CASE WHEN max((1 - p.rmse / c.rmse) * 100) > 0 THEN 'persist' ELSE 'clim' END AS method
      FROM sc p JOIN sc c USING (station) WHERE p.method = 'persist' AND c.method = 'clim' AND p.lead IS NULL AND c.lead IS NULL GROUP BY station""",
)
def model_gate(spark, sf):
    """Persistence where it has skill, climatology elsewhere."""
    scores = fq.scored(spark, sf, "tmean")[4]
    return fc.gate(scores.filter("lead IS NULL") if "lead" in scores.columns else scores, "persist", "clim", ["station"])


@query("dataset_ids", f"""WITH {tb.GRID_EVENTS} SELECT source || '_rain_r_' || strftime(min(obs_date), '%Y%m%d') || '_' || strftime(max(obs_date), '%Y%m%d') AS id, count(*) AS n FROM grid_events GROUP BY source""")
def dataset_ids(spark, sf):
    day = lambda c: F.date_format(c, "yyyyMMdd")
    g = tb.grid_events(spark, sf).groupBy("source").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(dataset_id(F.col("source"), F.lit("rain"), F.lit("r"), day("a"), day("b")).alias("id"), "n")


@query(
    "padded_scenes",
    f"""WITH {tb.RASTER}, spots AS (SELECT a.range AS y, b.range AS x, least(a.range % 80, 79 - a.range % 80) AS sy, least(b.range % 80, 79 - b.range % 80) AS sx FROM range(0, 64) a, range(0, 64) b)
    SELECT scene_id, spots.y, spots.x, round(b0, 5) AS b0 FROM spots JOIN raster ON raster.y = sy AND raster.x = sx""",
)
def padded_scenes(spark, sf):
    """Scenes continued by mirror images to the size of a patch."""
    return fo.reflect_pad(tb.raster(spark, sf), ["scene_id"], 64).select("scene_id", i("y"), i("x"), r("b0", 5))


@query("object_counts", f"""{sq.OBJECTS}, found AS ({ORACLES['objects'][len(sq.OBJECTS):]}) SELECT scene_id, label, count(*) AS n FROM found GROUP BY ALL""")
def object_counts(spark, sf):
    return co.object_counts(sq.objects(spark, sf), ["scene_id"])


@query(
    "forecast_lead_skill",
    f"""WITH f AS ({ORACLES['grid_forecast']}), p AS ({ORACLES['phi_decay']}) SELECT f.lat, f.lon, f.lead, f.value, p.skill_vs_clim_pct FROM f LEFT JOIN p USING (lead)""",
)
def forecast_lead_skill(spark, sf):
    """The grid forecast beside the skill of its lead, null where no lead was scored."""
    g, c, rows = gq.phi_rows(spark, sf)
    phi = gf.fit_phi(rows, gq.K)
    f = gf.with_lead_skill(gf.damped_forecast(g, c, phi, gq.K, floor=0.0), phi, gq.K)
    return f.select("lat", "lon", i("lead"), r("value"), r("skill_vs_clim_pct"))
