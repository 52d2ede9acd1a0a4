import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import calendar as ca
from terraloom.functions.numeric import bands, clip, sentinel_to_null
from terraloom.operators import climatology as cl


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_dates(spark):
    d = F.lit("2024-12-31").cast("date")
    r = one(
        spark, doy=ca.capped_doy(d), label=ca.day_label(d), week=ca.week_label(F.lit("2024-12-29").cast("date")),
        back=ca.from_yyyymmdd(F.lit("20240229")), bad=ca.from_yyyymmdd(F.lit("20230229")), out=ca.to_yyyymmdd(d),
        z=ca.parse_utc(F.lit("2024-05-01T10:00:00Z")), naive=ca.parse_utc(F.lit("2024-05-01T10:00:00")),
        stored=ca.parse_utc(F.lit("2024-05-01 10:00:00 UTC")), ident=ca.dataset_id(*[F.lit(x) for x in "abcde"]),
    )
    assert (r.doy, r.label, r.week, r.out, r.bad, r.ident) == (365, "31 Dec", "W52", "20241231", None, "a_b_c_d_e")
    assert r.back == dt.date(2024, 2, 29)
    assert r.z == r.naive == r.stored is not None
    start, end = ca.refresh_window(F.lit("2024-03-10").cast("date"))
    assert one(spark, s=start, e=end) == (dt.date(2024, 2, 6), dt.date(2024, 3, 7))


def test_clip_and_bands_keep_null(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), -1, 1)).collect()] == [None, -1.0, 0.5, 1.0]
    lab = bands(F.col("x"), [("<", 0.0, "low"), ("<=", 0.5, "mid")], "high")
    assert [r[0] for r in df.select(lab).collect()] == [None, "low", "mid", "high"]
    s = spark.createDataFrame([(-999.0,), (float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in s.select(sentinel_to_null(F.col("x"))).collect()] == [None, None, 1.0, None]


@pytest.mark.parametrize("lead", [1, 2, 3, 5, 7, 10, 14, 20])
def test_decay_interpolation(spark, lead):
    leads, phi = [1, 3, 7, 14], [0.8, 0.5, 0.2, 0.0]
    arr = F.array(*[F.struct(F.lit(a).alias("lead"), F.lit(b).alias("phi")) for a, b in zip(leads, phi)])
    want = np.exp(np.interp(lead, leads, np.log(np.clip(phi, 1e-4, 1))))
    assert one(spark, v=ca.interp_log_decay(F.lit(lead), arr)).v == pytest.approx(want)


def test_daily_normals_match_numpy(spark):
    vals = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8)]
    df = spark.createDataFrame([("a", m + 1, v) for m, v in enumerate(vals)] + [("a", 13, 99.0)], "k string, month int, value double")
    got = {r.doy: r.normal for r in ca.daily_normals(df, ["k"]).collect()}
    mids = np.array([ca.MONTH_MIDPOINTS[-1] - 365, *ca.MONTH_MIDPOINTS, ca.MONTH_MIDPOINTS[0] + 365])
    v = np.array([vals[-1], *vals, vals[0]])
    assert len(got) == 366
    for d in range(1, 367):
        assert got[d] == pytest.approx(np.interp(d, mids, v))


def test_climatology_against_brute_force(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=k) for k in range(900) if k % 5]
    x = rng.normal(10, 4, len(days))
    df = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days, x)], "station string, obs_date date, tmean double")
    got = {r.doy: r for r in cl.doy_climatology(df, ["tmean"]).collect()}
    doys = np.array([min(d.timetuple().tm_yday, 365) for d in days])
    for k in range(1, 366):
        m = np.abs(((doys - k + 182) % 365) - 182) <= 3
        assert got[k].tmean_mean == pytest.approx(x[m].mean())
        assert got[k].tmean_std == pytest.approx(x[m].std(), abs=1e-9)
