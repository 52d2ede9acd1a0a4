import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.operators import forecast as fc
from terraloom.operators import hazards as hz
from terraloom.operators import impact as im
from terraloom.operators import skill as sk
from terraloom.operators import windows as wn
from tests.test_hazards import frame, series


def brute_nnls(X, y):
    best = (0.0, np.zeros(3))
    for k in range(1, 4):
        for s in itertools.combinations(range(3), k):
            w, *_ = np.linalg.lstsq(X[:, s], y, rcond=None)
            if (w >= 0).all():
                full = np.zeros(3)
                full[list(s)] = w
                f = ((X @ full - y) ** 2).sum() - (y**2).sum()
                if f < best[0]:
                    best = (f, full)
    return best[1]


def test_nnls_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(12):
        X = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 3))
        y = X @ rng.normal(size=3) + rng.normal(size=30)
        want[k] = brute_nnls(X, y)
        rows += [(k, float(a), float(b), float(c), float(t), 0.0) for (a, b, c), t in zip(X, y)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, obs double, clim_trend double")
    for r in fc.nnls3(fc.gram(df, ["a", "b", "c"], ["k"])).collect():
        assert np.allclose([r.w0, r.w1, r.w2], want[r.k], atol=1e-8)
        assert r.weight_norm == pytest.approx(np.linalg.norm(want[r.k])) and r.n == 30


def test_nnls_with_a_constant_zero_member(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 2.0, 3.0, 0.0), (0, 2.0, 0.0, 1.0, 4.0, 0.0)], "k int, a double, b double, c double, obs double, clim_trend double")
    r = fc.nnls3(fc.gram(df, ["a", "b", "c"], ["k"])).first()
    assert (r.w0, r.w1, r.w2) == pytest.approx((5 / 3, 0.0, 2 / 3))


@pytest.fixture(scope="module")
def world(spark):
    rows = series("2012-01-01", 365 * 8, seed=3)
    obs = frame(spark, rows).persist()
    return rows, obs, cl.doy_climatology(obs, ["tmean", "precip"]).persist()


def test_backtest_frame_against_numpy(spark, world):
    rows, obs, clim = world
    split = fc.split_years(obs)
    trend = cl.leak_free_trend(obs, split)
    f = fc.backtest_frame(obs, clim, "tmean", trend)
    t = np.array([r[2] for r in rows])
    yr = np.array([r[1].year for r in rows])
    doy = np.array([min(r[1].timetuple().tm_yday, 365) for r in rows])
    c = np.array([t[np.abs(((doy - k + 182) % 365) - 182) <= 3].mean() for k in range(366)])
    sp = yr.max() - 3
    full = [y for y in sorted(set(yr[yr <= sp])) if (yr == y).sum() >= 330]
    slope = np.polyfit(full, [t[yr == y].mean() for y in full], 1)[0]
    mid = yr[yr <= sp].mean()
    a = 1500
    got = {r.lead: r for r in f.filter(F.col("issue_date") == F.lit(rows[a][1])).collect()}
    assert sorted(got) == list(range(1, 15))
    off = slope * (yr[a] - mid)
    last = t[a - 4 : a + 1].mean() - off - c[doy[a - 4 : a + 1]].mean()
    for h, r in got.items():
        assert r.obs == pytest.approx(t[a + h]) and r.clim == pytest.approx(c[doy[a + h]])
        assert r.persist == pytest.approx(c[doy[a + h]] + off + last * 0.7**h)
    assert f.count() == (len(rows) - 14 - 60) * 14


def test_blend_bands_and_floor(spark, world):
    _, obs, clim = world
    for v in ("tmean", "precip"):
        split = fc.split_years(obs)
        trend = cl.leak_free_trend(obs, split)
        f = fc.with_fitted(fc.backtest_frame(obs, clim, v, trend), fc.fitted_decay(fc.backtest_frame(obs, clim, v, trend), split), v)
        members = ["persist", "naive", "damped"]
        w = fc.nnls3(fc.gram(f.filter("year = 2017"), members, ["station", "lead"]))
        test = fc.blend(f, w, members, v).filter("year > 2017")
        by = sk.scores_by_lead(test, ["clim", "blend"], ["station"])
        live = fc.with_fitted(fc.live_rows(obs, clim, v, trend), fc.fitted_decay(f, split), v)
        out = fc.blended_forecast(live, w, by.filter("method = 'blend' and lead is not null"), members, v).collect()
        assert len(out) == 14 and all(r.lower <= r.value <= r.upper for r in out)
        if v == "precip":
            assert all(r.lower >= 0 for r in out)
        best = sk.best_method(by, ["station"], ["clim", "blend"]).first().best
        overall = {r.method: r.rmse for r in by.filter("lead is null").collect()}
        assert best == min(overall, key=overall.get)
        per = [r.rmse**2 for r in by.filter("lead is not null and method = 'clim'").collect()]
        assert overall["clim"] ** 2 == pytest.approx(np.mean(per))


def test_gate_and_fallback(spark):
    s = spark.createDataFrame([("t", "seq", 3.0), ("t", "gbt", 9.0), ("p", "seq", -2.0)], "var string, method string, skill_pct double")
    assert {r["var"]: r["method"] for r in fc.gate(s, "seq", "gbt", ["var"]).collect()} == {"t": "seq", "p": "gbt"}
    d = spark.createDataFrame([(2.0, 1.0, 4.0, 1, 0.5, 0.0)], "model double, clim double, anom5 double, lead int, resid_std double, half_trend double")
    r = fc.fallback_forecast(d, "tmean").first()
    member = 1 + 4 * 0.7
    assert r.value == pytest.approx(0.6 * 2 + 0.4 * member)
    assert r.upper - r.value == pytest.approx((0.5 + abs(2 - member) / 2) * 1.04)


def test_soil_outlook_step_by_step(spark, world):
    rows, obs, clim = world
    last = rows[-1][1]
    mk = lambda v, up: spark.createDataFrame([("s", last + dt.timedelta(days=h), h, v + h / 10, v + h / 10 + up, 0.0) for h in range(1, 15)], "station string, target_date date, lead int, value double, upper double, clim double")
    rain, temp = mk(2.0, 1.5), mk(12.0, 2.0)
    state = spark.createDataFrame([("s", 0.4)], "station string, soil_moisture double")
    got = fc.soil_outlook(wn.last_rows(obs, 7, ["station"]), rain, temp, clim, state).orderBy("step").collect()
    c = {r.doy: r for r in clim.collect()}
    seq = [(r[1], r[5], r[2]) for r in rows[-7:]] + [(last + dt.timedelta(days=h), 2 + h / 10, 12 + h / 10) for h in range(1, 15)]
    raw = [0.0]
    for d, p, t in seq[1:]:
        n = c[min(d.timetuple().tm_yday, 365)]
        raw.append(raw[-1] + 0.012 * (p - n.precip_mean) - 0.007 * (t - n.tmean_mean))
    assert len(got) == 21
    for i, r in enumerate(got):
        soil = min(0.95, max(0.08, raw[i] + 0.4 - raw[6]))
        assert r.soil == pytest.approx(soil) and r.drought_risk == pytest.approx(min(100, max(0, (0.55 - soil) * 185)))
        band = 0.012 * 1.5 * max(0, i - 6) ** 0.5
        assert r.soil_upper == pytest.approx(min(0.95, soil + band)) and r.soil_lower == pytest.approx(max(0, soil - band))


def test_scenarios_are_monotonic(spark):
    b = spark.createDataFrame([("s", 3.0, 15.0, 4.0, 0.4)], "station string, rain double, tmean double, et0 double, sm double")
    r = {(x.rain_pct, x.temp_c): x for x in im.narrative(im.scenario_sweep(b, [(-50, 3), (0, 0), (50, -2)])).collect()}
    dry, now, wet = r[(-50, 3)], r[(0, 0)], r[(50, -2)]
    assert dry.drought_score > now.drought_score >= wet.drought_score and dry.crop_score > wet.crop_score
    assert dry.soil_moisture < now.soil_moisture < wet.soil_moisture and now.soil_moisture == pytest.approx(0.4)
    assert now.inflow_change_pct == 0 and dry.inflow_change_pct == -85 and "deficit" in dry.narrative
    assert im.sector_risks(im.scenario_sweep(b, [(0, 0)])).count() == 3


def test_districts_and_advisories(spark):
    cols = "station string, rain_anomaly_pct double, temp_anomaly double, soil_moisture double, drought_class string"
    st = spark.createDataFrame([("dry", -60.0, 1.5, 0.2, "Severe"), ("wet", 80.0, -1.5, 0.7, "Normal"), ("mid", 0.0, 0.0, 0.5, "Normal")], cols)
    layer = im.districts(st)
    assert layer.count() == 27 and layer.filter("rain < -72 or rain > 100").count() == 0
    ranked = im.ranked_districts(layer)
    flags = lambda on: spark.createDataFrame([("dry", on), ("wet", False), ("mid", False)], "station string, active boolean")
    out = spark.createDataFrame([("dry", 10.0, 20.0, 15.0, 14.0)], "station string, rain_total double, rain_normal double, temp_mean double, temp_normal double")
    a = im.advisories(st, ranked, flags(True), flags(False), out).collect()
    titles = {}
    for r in a:
        titles.setdefault(r.station, []).append(r.title)
    assert "mid" not in titles
    assert titles["dry"][:2] == ["Severe drought watch", "Elevated surface temperature"] and "Heatwave conditions" in titles["dry"]
    assert len(titles["wet"]) == 3
    first = [r for r in a if r.station == "dry"][0]
    assert first.districts.split(", ")[0] == "Baramulla" and len(first.districts.split(", ")) == 4


def test_outlook_and_clim_rmse(spark, world):
    _, obs, clim = world
    r = fc.climatology_rmse(obs, clim, "tmean").first()
    assert r.n == 365 and 1 < r.rmse < 6
    assert hz.current_state(obs, clim).count() == 1


def test_unified_backtest_scores_both_variables(spark):
    from terraloom.plans import learned_queries as lq

    got = lq.unified_backtest(spark, "/root/testdata/sf0.01").groupBy("var").agg(F.countDistinct("method").alias("n"), F.count("rmse").alias("scored")).collect()
    assert {r["var"]: r["n"] for r in got} == {"tmean": 7, "precip": 7} and all(r["scored"] for r in got)


def test_direct_leads_from_one_gram_matrix(spark):
    """All leads at once equal a ridge fit of every lead on its own."""
    import numpy as np

    from terraloom.operators import learned as le

    rnd = np.random.default_rng(3)
    days, noise = 2200, rnd.normal(size=2200)
    z = np.zeros(days)
    for k in range(1, days):
        z[k] = 0.8 * z[k - 1] + 0.6 * noise[k]
    start = dt.date(2010, 1, 1)
    obs = spark.createDataFrame([("a", start + dt.timedelta(k), float(10 + z[k])) for k in range(days)], "station string, obs_date date, tmean double")
    clim = spark.createDataFrame([("a", d, 10.0) for d in range(1, 366)], "station string, doy int, tmean_mean double")
    model = le.DirectLeads("tmean", clim).fit(obs)
    sd = z.std() + 1e-6
    doy = [min((start + dt.timedelta(k)).timetuple().tm_yday, 365) for k in range(days)]
    last = (start + dt.timedelta(days - 1)).year - 3
    use = [k for k in range(29, days - 14) if (start + dt.timedelta(k)).year <= last]
    x = np.array([[*(z[k - 29 : k + 1] / sd), np.sin(doy[k] * 2 * np.pi / 365.25), np.cos(doy[k] * 2 * np.pi / 365.25)] for k in use])
    centre, spread = x.mean(0), x.var(0)
    for h in (1, 7, 14):
        y = np.array([z[k + h] / sd for k in use])
        beta = np.linalg.solve((x - centre).T @ (x - centre) + np.diag(0.01 * len(x) * spread), (x - centre).T @ (y - y.mean()))
        assert np.allclose(model.coefficients[:-1, h - 1], beta, atol=1e-8)
        assert np.isclose(model.coefficients[-1, h - 1], y.mean() - centre @ beta, atol=1e-8)
    issue = spark.createDataFrame([("a", start + dt.timedelta(1500))], "station string, issue_date date")
    got = {r.lead: r.z for r in model.forecast(issue, 5).collect()}
    own = np.array([*(z[1471:1501] / sd), np.sin(doy[1500] * 2 * np.pi / 365.25), np.cos(doy[1500] * 2 * np.pi / 365.25), 1.0])
    assert sorted(got) == [1, 2, 3, 4, 5] and all(np.isclose(got[h], own @ model.coefficients[:, h - 1]) for h in got)
