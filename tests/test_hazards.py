import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.operators import hazards as hz
from terraloom.operators import windows as wn

SCHEMA = "station string, obs_date date, tmean double, tmin double, tmax double, precip double"


def series(start, n, seed=0, station="s"):
    rng = np.random.default_rng(seed)
    t0 = dt.date.fromisoformat(start)
    rows = []
    for k in range(n):
        d = t0 + dt.timedelta(days=k)
        base = 15 + 12 * np.sin(2 * np.pi * (d.timetuple().tm_yday - 100) / 365.25)
        m = base + rng.normal(0, 3)
        rows.append((station, d, float(m), float(m - 6), float(m + 6 + rng.exponential(1)), float(max(0, rng.gamma(0.5, 6) - 1))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_spi_against_numpy(spark):
    rows = series("2010-01-01", 365 * 9)
    got = hz.spi(cl.monthly_totals(frame(spark, rows))).orderBy("year", "month").collect()
    tot = {}
    for r in rows:
        tot[(r[1].year, r[1].month)] = tot.get((r[1].year, r[1].month), 0) + r[5]
    ks = sorted(tot)
    m = np.array([tot[k] for k in ks])
    roll = np.concatenate([[np.nan, np.nan], np.convolve(m, np.ones(3), "valid")])
    spi = np.full(len(roll), np.nan)
    mon = np.array([k[1] for k in ks])
    for mo in range(1, 13):
        v = roll[mon == mo]
        f = v[np.isfinite(v)]
        if f.size > 5:
            spi[mon == mo] = (v - f.mean()) / (f.std() + 1e-6)
    spi = np.clip(spi, -3, 3)
    assert len(got) == len(ks)
    for r, s in zip(got, spi):
        assert (r.spi is None) == bool(np.isnan(s))
        if r.spi is not None:
            assert r.spi == pytest.approx(s, abs=1e-9)


def test_spi_needs_more_than_five_values(spark):
    got = hz.spi(cl.monthly_totals(frame(spark, series("2010-01-01", 365 * 5))))
    assert got.filter("spi is not null").count() == 0


def test_spells_mark_whole_runs(spark):
    flags = [1, 0, 1, 1, 0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([("s", k, bool(f)) for k, f in enumerate(flags)], "station string, obs_date int, hot boolean")
    out = [r.in_spell for r in wn.spells(df, "hot", ["station"]).orderBy("obs_date").collect()]
    assert out == [False, False, True, True, False, True, True, True, False, False]
    three = [r.in_spell for r in wn.spells(df, "hot", ["station"], min_run=3).orderBy("obs_date").collect()]
    assert sum(three) == 3


def test_monsoon_without_current_season(spark):
    rows = series("2015-01-01", 365 * 3 + 100)  # the newest year ends before June
    m = hz.monsoon_summary(frame(spark, rows)).first()
    assert m.last_year == 2018 and m.onset_date is None and m.received == 0.0 and m.seasonal_normal > 0


def test_onset_needs_a_full_week(spark):
    rows = [("s", dt.date(2020, 6, 1) + dt.timedelta(days=k), 1.0, 1.0, 1.0, 100.0) for k in range(6)]
    rows += [("s", dt.date(2019, 6, 1) + dt.timedelta(days=k), 1.0, 1.0, 1.0, 1.0) for k in range(122)]
    m = hz.monsoon_summary(frame(spark, rows)).first()
    assert m.onset_date is None and m.last_year == 2020


def test_records_take_the_first_day_on_ties(spark):
    d = [dt.date(2020, 1, k) for k in range(1, 6)]
    vals = [(5.0, -1.0, 2.0), (9.0, -3.0, 7.0), (9.0, -3.0, 7.0), (1.0, 0.0, 0.0), (None, None, 1.0)]
    rows = [("s", a, 0.0, v[1], v[0], v[2]) for a, v in zip(d, vals)]
    r = hz.records(frame(spark, rows)).first()
    assert (r.hottest, r.hottest_date, r.coldest, r.coldest_date, r.wettest, r.wettest_date) == (9.0, d[1], -3.0, d[1], 7.0, d[1])
    assert r.record_days == 5


def test_extremes_against_numpy(spark):
    rows = series("2010-01-01", 365 * 4 + 100, seed=5)
    df = frame(spark, rows)
    p = np.array([r[5] for r in rows])
    yr = np.array([r[1].year for r in rows])
    thr = np.percentile(p[p >= 1], 95)
    assert hz.wet_threshold(df).first().threshold == pytest.approx(thr)
    per = {r.year: r.days for r in hz.days_per_year(hz.heavy_days(df), "heavy").collect()}
    want = {int(y): int((p[yr == y] >= thr).sum()) for y in set(yr)}
    assert per == want
    full = [y for y in sorted(set(yr)) if (yr == y).sum() >= 330]
    s = hz.year_summary(hz.days_per_year(hz.heavy_days(df), "heavy", years=None)).first()
    assert s.latest_year == full[-1] and s.latest_days == want[full[-1]]
    assert s.baseline_days == pytest.approx(np.mean([want[y] for y in full[:-1]]))


def test_no_wet_day_gives_zero_threshold(spark):
    rows = [("s", dt.date(2020, 1, k), 1.0, 1.0, 1.0, 0.2) for k in range(1, 20)]
    assert hz.wet_threshold(frame(spark, rows)).first().threshold == 0.0


def test_current_state_against_numpy(spark):
    rows = series("2012-03-01", 365 * 4, seed=9)
    df = frame(spark, rows)
    s = hz.current_state(df, cl.doy_climatology(df, ["tmean", "precip"])).first()
    doy = np.array([min(r[1].timetuple().tm_yday, 365) for r in rows])
    t, p = np.array([r[2] for r in rows]), np.array([r[5] for r in rows])

    def clim(x):
        return np.array([x[np.abs(((doy - k + 182) % 365) - 182) <= 3].mean() for k in doy[-90:]])

    ct, cp = clim(t), clim(p)
    assert s.temp_anomaly == pytest.approx(t[-30:].mean() - ct[-30:].mean())
    assert s.rain_anomaly_pct == pytest.approx(np.clip((p[-90:].sum() / (cp.sum() + 1e-6) - 1) * 100, -70, 100))
    api = (p[-45:] * 0.94 ** np.arange(45)[::-1]).sum()
    assert s.soil_moisture == pytest.approx(np.clip(0.15 + api / 60, 0.05, 0.95))
    z = (p[-90:].sum() - cp.sum()) / (cp.std() * np.sqrt(90) + 1e-6)
    assert s.drought_class == ("Severe" if z < -1.3 else "Moderate" if z < -0.8 else "Mild" if z < -0.5 else "Normal")
    api_row = wn.antecedent_index(df).orderBy(F.desc("obs_date")).first().api
    assert api_row == pytest.approx(api)


def test_splice_needs_overlap_and_transfers_anomalies(spark):
    hist = series("2018-01-01", 800, seed=1)
    feed = [(r[0], r[1], r[2] + 5, r[3] + 5, r[4] + 5, r[5] * 2) for r in series("2018-01-01", 830, seed=1)]
    out = hz.splice_tail(frame(spark, hist), frame(spark, feed))
    tail = out.filter("is_tail").orderBy("obs_date").collect()
    want = series("2018-01-01", 830, seed=1)[800:]
    assert [r.obs_date for r in tail] == [r[1] for r in want]
    for r, w in zip(tail, want):
        assert r.tmean == pytest.approx(w[2]) and r.tmax == pytest.approx(w[4])
        assert r.precip == pytest.approx(w[5]) or r.precip >= 0
    short = [r for r in feed if r[1] > dt.date(2019, 6, 1)]
    assert hz.splice_tail(frame(spark, hist), frame(spark, short)).filter("is_tail").count() == 0


def test_warming_trend_skips_partial_years(spark):
    rows = series("2010-01-01", 365 * 6 + 40, seed=2)
    w = hz.warming_trend(frame(spark, rows)).orderBy("year").collect()
    yr = np.array([r[1].year for r in rows])
    t = np.array([r[2] for r in rows])
    full = [y for y in sorted(set(yr)) if (yr == y).sum() >= 330]
    slope, icept = np.polyfit(full, [t[yr == y].mean() for y in full], 1)
    assert w[0].slope_per_decade == pytest.approx(slope * 10, rel=1e-6)
    assert w[-1].trend == pytest.approx(slope * w[-1].year + icept, rel=1e-6)
    assert w[0].total_change == pytest.approx(slope * (full[-1] - full[0]), rel=1e-6)
    assert len(w) == len(set(yr))


def test_season_anchor_and_latest(spark):
    df = cl.with_calendar(frame(spark, series("2019-01-01", 500)))
    a = wn.season_anchor(df, F.lit("2021-02-10").cast("date"), ["station"]).first()
    assert a.anchor_date == dt.date(2020, 2, 9)
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, seq int, v string")
    got = {r.id: r.v for r in wn.latest_by_key(log, ["id"], [F.col("seq")]).collect()}
    assert got == {"a": "z", "b": "q"}


def test_splits(spark):
    df = spark.createDataFrame([("k", i, i * i) for i in range(11)], "k string, o int, v int")
    assert wn.ordered_share(df, ["k"], "o").filter("in_first").count() == 8
    halves = {r["half"]: r["n"] for r in wn.half_split(df, ["k"], "o", "v").groupBy("half").agg(F.count("*").alias("n")).collect()}
    assert halves == {"older": 5, "newer": 6}
    assert [r.o for r in wn.every_nth(df, ["k"], "o").orderBy("o").collect()] == [0, 2, 4, 6, 8, 10]
    y = spark.createDataFrame([("k", yy) for yy in range(2010, 2020)], "k string, year int")
    assert wn.time_split(y, ["k"]).filter("is_train").count() == 7
