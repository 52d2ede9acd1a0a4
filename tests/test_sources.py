import datetime as dt
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terraloom import schemas as sch
from terraloom.operators import catalog as ct
from terraloom.operators import documents as dc
from terraloom.sources import readers as rd
from terraloom.sources import sinks as sk

TEXT = "ds string, temp_mean string, temp_min string, temp_max string, precip string"


def test_bad_rows_go_as_a_whole(spark):
    rows = [
        ("2020-01-01", "1.0", "0.0", "2.0", "-3"), ("2020-01-02T00:00", "2.0", None, "4.0", "1"), ("bad", "1", "1", "1", "1"),
        ("2020-01-04", "x", "1", "5", "1"), ("2020-01-05", "1", "1", "2", ""), ("2020-01-06", "NaN", "1", "3", "2"),
    ]
    df = spark.createDataFrame(rows, TEXT)
    strict = rd.parse_record(df).orderBy("obs_date").collect()
    assert [(r.obs_date.day, r.tmean, r.tmin, r.precip) for r in strict] == [(1, 1.0, 0.0, 0.0), (2, 2.0, None, 1.0)]
    loose = rd.parse_record_with_defaults(df).orderBy("obs_date").collect()
    assert [(r.obs_date.day, r.tmean, r.tmin) for r in loose] == [(1, 1.0, 0.0), (2, 2.0, 4.0), (4, 3.0, 1.0), (6, 2.0, 1.0)]


def test_csv_without_optional_columns(spark, tmp_path):
    p = tmp_path / "rec.csv"
    p.write_text("ds,temp_max,precip\n2020-01-01,5,2\n2020-01-02,,1\n")
    r = rd.read_record_csv(spark, str(p), "s1").collect()
    assert [(x.station, x.tmean, x.tmin, x.precip) for x in r] == [("s1", 5.0, 5.0, 2.0)]


def test_point_feed_masks_every_variable(spark):
    m = {"T2M": {"20240101": 1.0, "20240102": -999, "20240103": 2.0}, "T2M_MAX": {"20240101": -999.0, "20240103": 5.0},
         "T2M_MIN": {"20240101": 0.0}, "PRECTOTCORR": {"20240101": -1.0, "20240102": 1.0, "20240103": 3.0}}
    df = spark.createDataFrame([("s", json.dumps({"properties": {"parameter": m}}))], "station string, payload string")
    r = rd.parse_point_feed(df, "payload", ["station"]).orderBy("obs_date").collect()
    assert [(x.obs_date.day, x.tmean, x.tmax, x.tmin, x.precip) for x in r] == [(1, 1.0, None, 0.0, 0.0), (3, 2.0, 5.0, None, 3.0)]


def test_archive_by_position(spark):
    payload = json.dumps([{"daily": {"time": ["2024-01-01", "2024-01-02"], "v": [1.0, None]}}, {"daily": {"time": ["2024-01-01"], "v": [3.0]}}])
    p = spark.createDataFrame([("g", payload)], "g string, payload string")
    cells = spark.createDataFrame([("g", 0, 1.0, 2.0), ("g", 1, 1.0, 3.0)], "g string, pos int, lat double, lon double")
    r = {(x.obs_date.day, x.lon): x.value for x in rd.parse_archive(p, cells, "v", ["g"]).collect()}
    assert r == {(1, 2.0): 1.0, (2, 2.0): None, (1, 3.0): 3.0}


def test_tiles_and_coordinates(spark):
    assert rd.tile_edges(6.5, 38.5) == [6.5, 14.5, 22.5, 30.5, 38.5] and rd.tile_edges(32.0, 37.0) == [32.0, 37.0]
    t = spark.createDataFrame([("d", 1, 5.0, 0.0, 9.0), ("d", 0, 5.0, 0.0, 7.0), ("d", 1, 6.0, 0.0, None)], "d string, tile int, lat double, lon double, value double")
    assert {x.lat: x.value for x in rd.mosaic(t, ["d"]).collect()} == {5.0: 7.0, 6.0: None}
    raw = spark.createDataFrame([(1.0, 2.0, 3)], "Latitude double, x double, time int")
    assert rd.standard_coordinates(raw).columns == ["lat", "lon", "time"]
    assert rd.climatology_steps(raw).columns[-1] == "month"
    assert rd.concat_chunks([t, t]).count() == 6


def test_agency_mean_masks_sentinels(spark):
    s = "obs_date date, lat double, lon double, value double"
    d = dt.date(2020, 5, 1)
    a = spark.createDataFrame([(d, 33.0, 75.0, 10.0), (d, 33.0, 76.0, -999.0), (d, 50.0, 75.0, 1.0)], s)
    b = spark.createDataFrame([(d, 33.0, 75.0, 4.0), (d, 33.0, 76.0, 4.0), (d, 50.0, 75.0, 1.0)], s)
    cut = lambda g: rd.agency_grid(g, "20200501", "20200531", (32.0, 37.0, 73.0, 80.0))
    r = {x.lon: x.value for x in rd.agency_mean(cut(a), cut(b), []).collect()}
    assert r == {75.0: 7.0, 76.0: None}


def test_manifest_absent_or_damaged(spark, tmp_path):
    assert rd.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"datasets": [')
    assert rd.read_manifest(spark, str(bad)).count() == 0
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"datasets": [{"id": "a", "bbox": [1, 2, 3, 4], "days": 3}, {"id": "b", "kind": "climatology"}]}))
    r = {x.id: x for x in rd.read_manifest(spark, str(good)).collect()}
    assert r["a"].bbox == [1.0, 2.0, 3.0, 4.0] and r["b"].kind == "climatology" and r["b"].days is None


def test_documents(spark):
    rows = [("1", None, "o", '{"id":"1","owner":"o","severity":"High"}'), ("2", None, "o", ""), ("3", None, "o", "{bad"), ("4", None, "p", '{"id":"4","owner":"p"}')]
    df = spark.createDataFrame(rows, "id string, email string, owner string, data string")
    assert [r.id for r in rd.find_documents(df, owner="o").collect()] == ["1"]
    assert rd.find_documents(df, owner="o", severity="Low").count() == 0


def test_backtest_and_presets(spark, tmp_path):
    p = tmp_path / "bt.json"
    p.write_text(json.dumps({"variables": {"t": {"methods": {"clim": {"rmse": 1.0, "mae": 0.5, "skill_pct": 0.0, "rmse_by_lead": [1.0, 2.0]}}}}}))
    assert [(r.lead, r.rmse) for r in rd.read_backtest(spark, str(p), ["t"]).orderBy("lead").collect()] == [(1, 1.0), (2, 2.0)]
    (tmp_path / "presets").mkdir()
    (tmp_path / "presets" / "lake_2014.json").write_text(json.dumps({"id": "lake_2014", "transitions": [{"from": "a", "to": "b", "percent": 3.0}]}, indent=1))
    r = rd.read_preset(spark, str(tmp_path / "presets"), "lake_2014").first()
    assert r.id == "lake_2014" and r.transitions[0]["percent"] == 3.0
    with pytest.raises(ValueError):
        rd.read_preset(spark, str(tmp_path), "../x")


def png(path, pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + b"".join(bytes(p) for p in row) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scenes_from_images(spark, tmp_path):
    (tmp_path / "Forest").mkdir()
    png(tmp_path / "Forest" / "a.png", [[(255, 0, 0), (0, 255, 0), (51, 102, 153)], [(0, 0, 255), (1, 2, 3), (9, 9, 9)]])
    got = {(r.y, r.x): (r.r, r.g, r.b, r.label) for r in rd.read_labelled_tiles(spark, str(tmp_path / "Forest")).collect()}
    assert len(got) == 6 and got[(0, 0)][:3] == (1.0, 0.0, 0.0) and got[(1, 0)][:3] == (0.0, 0.0, 1.0)
    assert got[(0, 2)] == pytest.approx((0.2, 0.4, 0.6, "Forest"))


def test_band_stacks(spark):
    s = spark.createDataFrame([("a", 0, 0, [1.0, 2.0, 3.0, 4.0]), ("b", 0, 0, [1.0, 2.0])], "scene_id string, y int, x int, bands array<double>")
    r = rd.band_stack(s, {"green": 1, "swir": 4}, ["scene_id"]).collect()
    assert [(x.scene_id, x.green, x.swir) for x in r] == [("a", 1.0, 4.0)]
    hwb = [("s", i, j, k, float(100 * i + 10 * j + k)) for i in range(5) for j in range(4) for k in range(2)]
    t = rd.bands_first(spark.createDataFrame(hwb, "scene_id string, i int, j int, k int, value double"))
    assert {(x.band, x.y, x.x): x.value for x in t.collect()}[(1, 4, 3)] == 431.0


def test_weather_counts_locations(spark):
    stations = spark.createDataFrame([(0, "A", 1.0, 2.0), (1, "B", 3.0, 4.0)], "pos int, name string, lat double, lon double")
    codes = sch.dim_weather_code(spark)
    ok = json.dumps([{"current": {"temperature_2m": 5.0, "weather_code": 95}, "daily": {"temperature_2m_max": [7.0, 8.0]}}, {}])
    df = spark.createDataFrame([(1, ok)], "k int, payload string")
    r = {x["name"]: x for x in rd.parse_weather(df, stations, codes, ["k"]).collect()}
    assert r["A"].condition == "Thunderstorm" and r["A"].high_c == 7.0 and r["B"].condition == "unknown" and r["B"].temp_c is None
    with pytest.raises(Exception, match="1 locations for 2 stations"):
        rd.parse_weather(spark.createDataFrame([(1, "[{}]")], "k int, payload string"), stations, codes, ["k"]).collect()


def test_news(spark):
    a = [{"title": " Flood ", "url": "u1", "urlToImage": "i"}, {"title": "", "url": "u2"}, {"title": "flood", "url": "u3"}, {"title": "Rain", "url": None}, {"title": "Snow", "url": "u5"}]
    df = spark.createDataFrame([(json.dumps({"articles": a}),)], "payload string")
    news = rd.parse_news(df, "a")
    assert news.first().image == "i"
    assert [r.url for r in dc.headlines(news).orderBy("position").collect()] == ["u1", "u5"]
    assert dc.headlines(news, 0).count() == 1
    many = spark.range(60).select(F.col("id").alias("position"), F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit("u").alias("url"))
    assert dc.headlines(many, 50).count() == 20


def test_registry(spark):
    rd.register_source("x", lambda var: var)
    assert rd.fetch("x", "rain") == "rain"
    with pytest.raises(ValueError):
        rd.fetch("nope")
    rows = spark.createDataFrame([("rain",), ("fog",)], "var string")
    assert [r["var"] for r in ct.invalid_rows(rows, sch.dim_variable(spark), "var").collect()] == ["fog"]
    assert sch.dim_region(spark).count() == 2 and sch.dim_marker(spark).count() == 24 and sch.dim_class(spark).count() == 10


def grid(spark, region, day, value):
    return spark.createDataFrame([("p", "rain", region, day, 1.0, float(k), value) for k in range(3)], sch.GRID_OBS)


def test_grid_sink_replaces_only_its_partitions(spark, tmp_path):
    p = str(tmp_path / "grid")
    sk.write_grid(grid(spark, "a", dt.date(2024, 1, 1), 1.0).unionByName(grid(spark, "b", dt.date(2024, 1, 1), 2.0)), p)
    sk.write_grid(grid(spark, "b", dt.date(2024, 2, 1), 5.0), p)
    assert rd.read_grid(spark, p, "rain", "a", "20240101", "20240131").count() == 3
    b = rd.read_grid(spark, p, "rain", "b", "20240101", "20241231").collect()
    assert sorted(r.value for r in b) == [2.0] * 3 + [5.0] * 3
    sk.write_grid(grid(spark, "b", dt.date(2024, 2, 1), 6.0), p)  # the same period again: replaced
    late = grid(spark, "b", dt.date(2024, 2, 1), 7.0).unionByName(grid(spark, "b", dt.date(2024, 2, 2), 8.0))
    assert sorted({r.value for r in rd.read_grid(spark, p, "rain", "b", "20240101", "20241231").collect()}) == [2.0, 6.0]
    sk.write_grid(late, p)  # an overlapping later window: its days win
    assert sorted({r.value for r in rd.read_grid(spark, p, "rain", "b", "20240101", "20241231").collect()}) == [2.0, 7.0, 8.0]
    plan = rd.read_grid(spark, p, "rain", "b", "20240101", "20241231")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "region" in plan


def test_catalogue_sink(spark, tmp_path):
    e = sk.catalogue_entries(grid(spark, "a", dt.date(2024, 1, 1), 1.0), "2024-02-01")
    r = e.first()
    assert (r.id, r.days, r.n_cells, r.valid_cells, r.mean) == ("p_rain_a_20240101_20240101", 1, 3, 3, 1.0)
    sk.write_catalogue(e, None, str(tmp_path / "c1"))
    first = spark.read.schema(sch.MANIFEST_ENTRY).json(str(tmp_path / "c1"))
    again = sk.catalogue_entries(grid(spark, "a", dt.date(2024, 1, 1), 9.0), "2024-03-01")
    sk.write_catalogue(again, first, str(tmp_path / "c2"))
    r = spark.read.schema(sch.MANIFEST_ENTRY).json(str(tmp_path / "c2")).collect()
    assert len(r) == 1 and r[0].mean == 9.0
    clim = spark.createDataFrame([("p", "rain", "a", 1, 1.0, 1.0, 2.0)], sch.GRID_CLIM)
    assert sk.catalogue_entries(clim, "x", climatology=True).first().id == "p_rain_a_clim"


def test_document_log(spark, tmp_path):
    p = str(tmp_path / "log")
    mk = lambda rows: spark.createDataFrame(rows, "id string, seq int, v string")
    sk.append_documents(mk([("a", 1, "x"), ("b", 1, "y")]), p)
    sk.append_documents(mk([("a", 2, "z")]), p)
    sk.append_documents(mk([("b", 2, None)]), p, deleted=True)
    assert [(r.id, r.v) for r in sk.current_documents(spark, p).collect()] == [("a", "z")]
    maps = str(tmp_path / "maps")
    sk.append_documents(spark.createDataFrame([("a", 1, {"x": 1.0}), ("a", 2, {"x": 2.0})], "id string, seq int, land_cover map<string,double>"), maps)
    assert [r.land_cover for r in sk.current_documents(spark, maps).collect()] == [{"x": 2.0}]
    k = spark.createDataFrame([("", "e@x"), ("i", "e"), (None, None)], "id string, email string").select(dc.document_key(F.col("id"), F.col("email"))).collect()
    assert [r[0] for r in k][:2] == ["e@x", "i"] and len(k[2][0]) == 36


def test_history_presets_metrics(spark, tmp_path):
    h = spark.createDataFrame([("1", "o", "x" * 100 + ".tif")], "id string, owner string, name string")
    sk.write_history(h, str(tmp_path / "h"))
    r = spark.read.parquet(str(tmp_path / "h")).first()
    assert r["name"] == "x" * 80 and r.severity is None
    d = spark.createDataFrame([("1", "analysis", None), ("2", "analysis", "High"), ("3", "change", None), ("4", "disaster", "Low")], "id string, category string, severity string")
    paths = {n: str(tmp_path / n) for n in ("analyses", "changes", "disasters")}
    sk.route_presets(d, paths)
    ids = {n: sorted(x.id for x in spark.read.json(p).collect()) for n, p in paths.items()}
    assert ids == {"analyses": ["1", "2"], "changes": ["3"], "disasters": ["2", "4"]}
    sk.write_metrics(d, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4


def test_dashboard(spark):
    docs = spark.createDataFrame(
        [(k, "o", f"n{k}", k, float(10 * k), {"Forest": float(k), "Water": 5.0}, {"Building": k}, "r" if k % 2 else None) for k in range(1, 8)],
        "id int, owner string, name string, created_at int, confidence double, land_cover map<string,double>, object_counts map<string,bigint>, report_url string",
    )
    t = dc.totals(docs, ["owner"]).first()
    assert (t.images, t.reports, t.objects, t.avg_confidence) == (7, 4, 28, 40.0)
    d = dc.land_cover_delta(docs, ["owner"], "created_at", "id").first()
    assert d.Forest == 3.5 and d.Water == 0.0 and d.Urban == 0.0
    rec = dc.recent(docs, ["owner"], "created_at", "id").orderBy("rank").collect()
    assert [r.id for r in rec] == [7, 6, 5, 4, 3, 2] and [r.dominant for r in rec] == ["Forest"] * 3 + ["Water"] * 3 or rec[2].dominant in ("Forest", "Water")
    one = dc.land_cover_delta(docs.filter("id = 1"), ["owner"], "created_at", "id").first()
    assert one.Forest == 0.0
    assert dc.project(docs, ["id", "nope"]).columns == ["id", "nope"]
    assert [r["name"] for r in dc.confidence_trend(docs, ["owner"], "created_at").collect()] == [f"n{k}" for k in range(1, 8)]
