import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import anomaly as an
from terraloom.operators import catalog as ct
from terraloom.operators import climatology as cl
from terraloom.operators import fusion as fu
from terraloom.operators import grid as gr
from terraloom.operators import grid_forecast as gf

K = ["source"]


def field(spark, values, lats, lons, name="value"):
    rows = [("g", float(a), float(o), None if v is None else float(v)) for a, row in zip(lats, values) for o, v in zip(lons, row)]
    return spark.createDataFrame(rows, f"source string, lat double, lon double, {name} double")


def test_nearest_tie_takes_lower_axis_value(spark):
    f = field(spark, [[1, 2], [3, 4]], [0, 1], [10, 11])
    m = spark.createDataFrame([("g", "mid", 0.5, 10.5), ("g", "far", 9.0, -5.0)], "source string, name string, lat double, lon double")
    got = {r["name"]: r["value"] for r in gr.sample_markers(f, m, K).collect()}
    assert got == {"mid": 1.0, "far": 3.0}


def test_marker_on_missing_cell_is_null_or_zero(spark):
    f = field(spark, [[None, 2]], [0], [0, 1])
    m = spark.createDataFrame([("g", "a", 0.0, 0.0)], "source string, name string, lat double, lon double")
    assert gr.sample_markers(f, m, K).first()["value"] is None
    assert gr.sample_markers(f, m, K, fill_zero=True).first()["value"] == 0.0


def test_bilinear_against_numpy_and_missing_corner(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4, 5))
    lats, lons = np.arange(4) * 1.0, np.arange(5) * 1.0
    vals = v.tolist()
    vals[0][0] = None
    out = {(r.lat, r.lon): r.value for r in gr.regrid_bilinear(field(spark, vals, lats, lons), (-0.5, 3.5, 0, 4), 0.25, K, K).collect()}
    assert all(0 <= a <= 3 for a, _ in out)  # outside the grid there is no support
    for (a, o), got in out.items():
        i, j = min(int(a), 2), min(int(o), 3)
        fa, fo = a - i, o - j
        corners = [(i, j, (1 - fa) * (1 - fo)), (i, j + 1, (1 - fa) * fo), (i + 1, j, fa * (1 - fo)), (i + 1, j + 1, fa * fo)]
        if any(w > 0 and (p, q) == (0, 0) for p, q, w in corners):
            assert got is None
        else:
            assert got == pytest.approx(sum(w * v[p, q] for p, q, w in corners if w > 0))


def test_target_grid_and_thin(spark):
    t = gr.target_grid(spark, (32.0, 37.0, 73.0, 80.0), 0.25)
    assert t.count() == 21 * 29 and t.agg(F.max("lon")).first()[0] == 80.0
    f = t.withColumns({"source": F.lit("g"), "value": F.col("lat")})
    thin = gr.thin(f, K, max_cells=7)
    assert sorted({r.lat for r in thin.select("lat").distinct().collect()}) == [32.0 + 0.75 * k for k in range(7)]
    assert thin.select("lon").distinct().count() == 8


def test_within_radius_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 5, (40, 2))
    f = field(spark, np.zeros((6, 6)), np.arange(6), np.arange(6))
    p = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(pts)], "source string, id int, lat double, lon double")
    got = {(r.id, r.g_lat, r.g_lon) for r in gr.within_radius(p, gr.axes(f, K), K, 1.3).collect()}
    want = {(k, float(i), float(j)) for k, (a, b) in enumerate(pts) for i in range(6) for j in range(6) if (a - i) ** 2 + (b - j) ** 2 < 1.69}
    assert got == want


def test_km_box_and_coordinates(spark):
    b = spark.range(1).select(*[c.alias(n) for n, c in gr.km_box(F.lit(60.0), F.lit(10.0), 11.1).items()]).first()
    assert b.lat_max - b.lat_min == pytest.approx(0.2)
    assert b.lon_max - b.lon_min == pytest.approx(0.4)
    n = gr.normalised_coordinates(field(spark, [[1, 2, 3]], [5], [0, 5, 10]), K).orderBy("lon").collect()
    assert [r.nlon for r in n] == [-1.0, 0.0, 1.0]


def test_cressman_invariants(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(20, 3, (5, 5))
    f = field(spark, v, np.arange(5), np.arange(5))
    obs = lambda rows: spark.createDataFrame(rows, "source string, lat double, lon double, obs double")
    same = fu.cressman(f, obs([]), K).collect()
    assert all(r.value == r.fused for r in same)
    got = {(r.lat, r.lon): r.fused for r in fu.cressman(f, obs([("g", 2.2, 2.1, 30.0)]), K, 1.0, 0.6).collect()}
    incr = 30.0 - v[2, 2]
    for i in range(5):
        for j in range(5):
            d2 = (i - 2.2) ** 2 + (j - 2.1) ** 2
            assert got[(i, j)] == pytest.approx(v[i, j] + 0.6 * max(0, (1 - d2) / (1 + d2)) * incr)
    vv = v.tolist()
    vv[2][2] = None  # an observation next to a missing cell changes nothing
    out = fu.cressman(field(spark, vv, np.arange(5), np.arange(5)), obs([("g", 2.2, 2.1, 30.0), ("g", 0.0, 0.0, float("nan"))]), K).collect()
    assert all(r.value == r.fused for r in out)


def test_ordered_assimilation_equals_replay(spark):
    rng = np.random.default_rng(5)
    air, lst = rng.normal(20, 3, (4, 6)), rng.normal(25, 3, (4, 6))
    lst[1, 2] = np.nan
    lat, lon = np.arange(4) * 0.25, np.arange(6) * 0.25
    fa = field(spark, air, lat, lon)
    fs = field(spark, [[None if np.isnan(x) else x for x in row] for row in lst], lat, lon)
    g = air.copy()
    la, lo = np.meshgrid(lat, lon, indexing="ij")
    for i in range(4):
        for j in range(6):
            if np.isfinite(lst[i, j]):
                d2 = (la - lat[i]) ** 2 + (lo - lon[j]) ** 2
                g = g + 0.5 * np.clip((0.36 - d2) / (0.36 + d2), 0, None) * (lst[i, j] - g[i, j])
    out = fu.surface_fusion(fa, fs, K)
    for r in out.collect():
        assert r.fused == pytest.approx(g[int(r.lat / 0.25), int(r.lon / 0.25)])
    s = fu.adjustment_summary(out, K).first()
    assert s.n_obs == 23 and s.max_abs_adjustment == pytest.approx(np.abs(g - air).max())


def test_blue_against_numpy(spark):
    rng = np.random.default_rng(6)
    t = rng.normal(size=60) + 1000.0
    a, b = t + 2 + rng.normal(size=60), t - 1 + rng.normal(scale=0.5, size=60)
    df = spark.createDataFrame([("k", float(x), float(y), float(z)) for x, y, z in zip(a, b, t)] + [("k", 1.0, None, 2.0), ("few", 1.0, 1.0, 1.0)], "k string, a double, b double, truth double")
    for debias in (True, False):
        rows = fu.blue_statistics(df, ["k"], debias).collect()
        assert len(rows) == 1
        r, ea, eb = rows[0], a - t, b - t
        ba, bb = (ea.mean(), eb.mean()) if debias else (0, 0)
        da, db = ea - ba, eb - bb
        va, vb, c = (da**2).mean(), (db**2).mean(), (da * db).mean()
        w = np.clip((vb - c) / (va + vb - 2 * c), 0, 1)
        assert r.n == 60 and r.w_a == pytest.approx(w) and r.bias_a == pytest.approx(ba)
        assert r.rmse_fused == pytest.approx(np.sqrt(((w * da + (1 - w) * db) ** 2).mean()))


def test_weights_fall_back(spark):
    win = spark.createDataFrame([("x", "w1", "1"), ("x", "w2", "2"), ("x", "w3", "3"), ("y", "w1", "1")], "k string, window_id string, window_end string")
    one = spark.createDataFrame([("x", "w1", 0.2), ("x", "w2", 0.7)], "k string, window_id string, w_a double")
    stats = one.withColumns({"w_b": 1 - F.col("w_a"), **{c: F.lit(1.0) for c in ("bias_a", "bias_b", "rmse_a", "rmse_b", "rmse_fused")}})
    got = {r.k: r for r in fu.choose_weights(win, stats, ["k"]).collect()}
    assert got["x"].w_a == 0.7 and got["x"].weights_from == "w2" and got["x"].calibrated
    assert got["y"].w_a == 0.5 and got["y"].weights_from is None and got["y"].bias_a == 0.0


def test_phi_against_numpy(spark):
    rng = np.random.default_rng(7)
    T, n = 80, 3
    a = np.zeros((T, n))
    for t in range(1, T):
        a[t] = 0.7 * a[t - 1] + rng.normal(size=n)
    miss = rng.uniform(size=(T, n)) < 0.1
    miss[0, 0] = miss[-1, 0] = False
    rows = [("g", 0.0, float(c), t, t % 365 + 1, float(a[t, c])) for t in range(T) for c in range(n) if not miss[t, c]]
    df = spark.createDataFrame(rows, "source string, lat double, lon double, t int, doy int, anom double")
    got = {r.lead: r for r in gf.fit_phi(gf.issue_rows(df, K), K).collect()}
    x = np.where(miss, np.nan, a)
    for lead in (1, 3, 7, 14):
        fit, test = [], []
        for t in range(3, T - lead, 2):
            seed = x[t - 2 : t + 1]
            for c in range(n):
                if not np.isnan(x[t + lead, c]):
                    s = 0.0 if np.all(np.isnan(seed[:, c])) else np.nanmean(seed[:, c])
                    (fit if t < int(T * 0.75) else test).append((s, x[t + lead, c]))
        s, y = np.array(fit).T
        phi = np.clip(s @ y / (s @ s + 1e-9), 0, 1)
        assert got[lead].phi == pytest.approx(phi)
        s, y = np.array(test).T
        assert got[lead].rmse == pytest.approx(np.sqrt(((phi * s - y) ** 2).mean()))
        assert got[lead].clim_rmse == pytest.approx(np.sqrt((y**2).mean()))


def test_last_valid_day_and_clipped_rain(spark):
    d = dt.date(2024, 1, 1)
    rows = [("g", d + dt.timedelta(days=k), 0.0, float(c), 1.0 if (k < 4 or c == 0) else None) for k in range(6) for c in range(4)]
    g = spark.createDataFrame(rows, "source string, obs_date date, lat double, lon double, value double")
    assert gf.last_valid_day(g, K).first().seed_date == d + dt.timedelta(days=3)
    clim = spark.createDataFrame([("g", m, 0.0, float(c), 0.1) for m in range(1, 14) for c in range(4)], "source string, month int, lat double, lon double, value double")
    phi = spark.createDataFrame([("g", n, 0.5) for n in (1, 3, 7, 14)], "source string, lead int, phi double")
    low = g.withColumn("value", F.col("value") - 5)
    f = gf.damped_forecast(low, clim, phi, K, floor=0.0)
    assert f.count() == 4 * 14 and f.agg(F.min("value")).first()[0] == 0.0
    scored = spark.createDataFrame([("g", 1, 3.0)], "source string, lead int, skill_vs_clim_pct double")
    s = {r.lead: r.skill_vs_clim_pct for r in gf.with_lead_skill(f, scored, K).collect()}
    assert s[1] == 3.0 and s[2] is None


def test_anomaly_uses_equal_month_weights(spark):
    rows = [("g", dt.date(2024, 1, 31), 0.0, 0.0, 10.0)] + [("g", dt.date(2024, 2, k), 0.0, 0.0, 10.0) for k in range(1, 21)]
    g = spark.createDataFrame(rows, "source string, obs_date date, lat double, lon double, value double")
    clim = spark.createDataFrame([("g", m, 0.0, 0.0, float(m)) for m in range(1, 14)], "source string, month int, lat double, lon double, value double")
    r = an.grid_anomaly(g, clim, K).first()
    assert r.normal == 1.5 and r.anomaly == 8.5
    zero = an.grid_anomaly(g, clim.withColumn("value", F.lit(0.05)), K).first()
    assert zero.anomaly_pct is None
    assert an.ingest_statistics(g, K).first().days == 21
    c = {r.month: r.value for r in cl.monthly_grid_climatology(g.withColumn("value", F.month("obs_date").cast("double")), K).collect()}
    assert c[1] == 1.0 and c[2] == 2.0 and c[13] == pytest.approx(41 / 21)


def test_catalogue_choices(spark):
    cols = "id string, source string, var string, region string, kind string, start_ymd string, end_ymd string, days bigint, created_at string, ord int"
    c = spark.createDataFrame([
        ("a", "NASA POWER", "rain", "jk", None, "20240101", "20240130", 30, "2024-02-01", 0),
        ("b", "Open-Meteo", "rain", "jk", None, "20240105", "20240203", 30, "2024-03-01", 1),
        ("c", "NASA POWER", "rain", "jk", None, "20210101", "20231231", 1095, "2024-04-01", 2),
        ("d", "NASA POWER", "rain", "jk", "climatology", None, None, None, "2024-01-01", 3),
        ("e", "Open-Meteo", "tmean", "jk", None, "20240101", "20240130", 30, "2024-01-01", 4),
        ("f", "Open-Meteo", "tmean", "jk", None, "20240101", "20240130", 30, "2024-01-01", 5),
    ], cols)
    k = ["var", "region"]
    pick = {r["var"]: r["id"] for r in ct.preferred(c, k, "power").collect()}
    assert pick == {"rain": "a", "tmean": "e"}  # ties keep the first listed
    assert ct.newest(ct.find(c, min_days=200), k).first()["id"] == "c"
    assert ct.newest(ct.find(c, True, source_contains="power"), k).first()["id"] == "d"
    assert [r["var"] for r in ct.available(c, k).collect()] == ["rain"]
    assert [r["var"] for r in ct.available_in_both(c, k, "POWER", "open-meteo").collect()] == ["rain"]
    jobs = spark.createDataFrame([("rain", "jk"), ("lst", "jk")], "var string, region string")
    stale = {r["var"]: r["stale"] for r in ct.stale_jobs(jobs, c, F.lit("20240203"), k).collect()}
    assert stale == {"rain": False, "lst": True}
    feed = {r["source"]: r["status"] for r in ct.feed_status(c, F.lit("2024-02-08").cast("date"), ["source"]).collect()}
    assert feed == {"Open-Meteo": "active", "NASA POWER": "stale"}
    over = fu.overlapping_pairs(c.filter("source = 'Open-Meteo' and var = 'rain'"), c.filter("source = 'NASA POWER' and kind is null"), k).first()
    assert (over.left_id, over.right_id, over.overlap_days) == ("b", "a", 25)
    new = spark.createDataFrame([("a", "fresh")], "id string, source string")
    up = {r["id"]: r["source"] for r in ct.upsert(c, new).collect()}
    assert up["a"] == "fresh" and len(up) == 6
