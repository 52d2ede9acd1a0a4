"""Queries over daily station records: climatology, anomalies, hazards, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.operators import hazards as hz
from terraloom.operators import windows as wn
from terraloom.plans.registry import ORACLES, query
from terraloom.plans.shape import i, r, s, shared
from terraloom.sources import tables as tb

DOY = "least(dayofyear(obs_date), 365)"
CAL = f"""cal AS (SELECT *, {DOY} AS doy, year(obs_date) AS yr, month(obs_date) AS mo,
  row_number() OVER (PARTITION BY station ORDER BY obs_date) AS rn,
  row_number() OVER (PARTITION BY station ORDER BY obs_date DESC) - 1 AS age FROM daily)"""
CLIM = """clim AS (SELECT c.station, k.doy, avg(c.tmean) AS tmean_mean, stddev_pop(c.tmean) AS tmean_std,
    avg(c.precip) AS precip_mean, stddev_pop(c.precip) AS precip_std,
    avg(c.tmax) AS tmax_mean, avg(c.tmin) AS tmin_mean
  FROM cal c JOIN (SELECT CAST(range AS BIGINT) AS doy FROM range(1, 366)) k
    ON abs((((c.doy - k.doy + 182) % 365 + 365) % 365) - 182) <= 3
  GROUP BY c.station, k.doy)"""
BASE = f"WITH {tb.DAILY}, {CAL}, {CLIM}"
SIMPLE = f"WITH {tb.DAILY}, {CAL}"

SPI_SQL = """monthly AS (SELECT station, yr, mo, sum(precip) AS total FROM cal GROUP BY ALL),
rolled AS (SELECT *, CASE WHEN count(*) OVER f = 3 THEN sum(total) OVER f END AS sum3 FROM monthly
  WINDOW f AS (PARTITION BY station ORDER BY yr, mo ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
spi AS (SELECT *, CASE WHEN sum3 IS NOT NULL AND count(sum3) OVER m > 5 THEN
    greatest(-3.0, least(3.0, (sum3 - avg(sum3) OVER m) / (stddev_pop(sum3) OVER m + 1e-6))) END AS spi
  FROM rolled WINDOW m AS (PARTITION BY station, mo)),
graded AS (SELECT *, CASE WHEN spi IS NULL THEN NULL WHEN spi <= -2 THEN 'Extreme drought' WHEN spi <= -1.5 THEN 'Severe drought'
  WHEN spi <= -1 THEN 'Moderate drought' WHEN spi < 1 THEN 'Near normal' WHEN spi < 1.5 THEN 'Moderately wet'
  ELSE 'Very wet' END AS class FROM spi)"""


def clim_of(spark, sf, values):
    obs = shared(tb.daily(spark, sf))
    return obs, cl.doy_climatology(obs, values)


@query("monthly_totals", f"{SIMPLE} SELECT station, yr AS year, mo AS month, round(sum(precip), 4) AS total FROM cal GROUP BY ALL")
def monthly_totals(spark, sf):
    return cl.monthly_totals(tb.daily(spark, sf)).select("station", i("year"), i("month"), r("total"))


@query(
    "spi3_drought",
    f"{SIMPLE}, {SPI_SQL} SELECT station, yr AS year, mo AS month, round(sum3, 4) AS sum3, round(spi, 4) AS spi, class FROM graded",
)
def spi3_drought(spark, sf):
    out = hz.spi(cl.monthly_totals(tb.daily(spark, sf)))
    return out.select("station", i("year"), i("month"), r("sum3"), r("spi"), "class")


@query(
    "spi3_latest",
    f"""{SIMPLE}, {SPI_SQL} SELECT station, age, round(spi, 4) AS spi, class FROM (
      SELECT *, row_number() OVER (PARTITION BY station ORDER BY yr DESC, mo DESC) - 1 AS age FROM graded)
    WHERE age < 60 AND spi IS NOT NULL""",
)
def spi3_latest(spark, sf):
    out = hz.spi_latest(hz.spi(cl.monthly_totals(tb.daily(spark, sf))))
    return out.select("station", i("age"), r("spi"), "class")


@query(
    "doy_climatology",
    f"""{BASE} SELECT station, doy, round(tmean_mean, 4) AS tmean_mean, round(tmean_std, 4) AS tmean_std,
      round(precip_mean, 4) AS precip_mean, round(precip_std, 4) AS precip_std FROM clim""",
)
def doy_climatology(spark, sf):
    _, c = clim_of(spark, sf, ["tmean", "precip"])
    return c.select("station", i("doy"), r("tmean_mean"), r("tmean_std"), r("precip_mean"), r("precip_std"))


@query(
    "daily_anomaly",
    f"""{BASE} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(tmean - tmean_mean, 4) AS tmean_anom,
      round(precip - precip_mean, 4) AS precip_anom FROM cal JOIN clim USING (station, doy)""",
)
def daily_anomaly(spark, sf):
    obs, c = clim_of(spark, sf, ["tmean", "precip"])
    return cl.daily_anomaly(obs, c, ["tmean", "precip"]).select("station", s("obs_date"), r("tmean_anom"), r("precip_anom"))


@query(
    "standardised_anomaly",
    f"""{BASE} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(a / (stddev_pop(a) OVER (PARTITION BY station) + 1e-6), 4) AS z
      FROM (SELECT station, obs_date, tmean - tmean_mean AS a FROM cal JOIN clim USING (station, doy))""",
)
def standardised_anomaly(spark, sf):
    obs, c = clim_of(spark, sf, ["tmean"])
    return cl.standardised_anomaly(obs, c, "tmean").select("station", s("obs_date"), r("z"))


HEAT_SQL = """hot AS (SELECT cal.*, tmax - tmax_mean AS tmax_anom, tmax - tmax_mean >= 4.5 AND tmax >= 30 AS hot
  FROM cal JOIN clim USING (station, doy)),
isl AS (SELECT *, rn - row_number() OVER (PARTITION BY station, hot ORDER BY obs_date) AS grp FROM hot),
spell AS (SELECT *, hot AND count(*) OVER (PARTITION BY station, hot, grp) >= 2 AS in_spell,
  CASE WHEN hot THEN count(*) OVER (PARTITION BY station, hot, grp) ELSE 0 END AS run_length FROM isl)"""


@query(
    "heat_spells",
    f"""{BASE}, {HEAT_SQL} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(tmax_anom, 4) AS tmax_anom,
      run_length FROM spell WHERE in_spell""",
)
def heat_spells(spark, sf):
    obs, c = clim_of(spark, sf, ["tmax"])
    d = hz.heat_days(obs, c).filter("in_spell")
    return d.select("station", s("obs_date"), r("tmax_anom"), i("run_length"))


@query(
    "spell_days_per_year",
    f"""{BASE}, {HEAT_SQL} SELECT station, yr AS year, count(*) FILTER (WHERE in_spell) AS days FROM spell GROUP BY station, yr
      QUALIFY row_number() OVER (PARTITION BY station ORDER BY yr DESC) <= 12""",
)
def spell_days_per_year(spark, sf):
    obs, c = clim_of(spark, sf, ["tmax"])
    return hz.days_per_year(hz.heat_days(obs, c), "in_spell").select("station", i("year"), i("days"))


@query(
    "heat_status",
    f"""{BASE}, {HEAT_SQL} SELECT station, CAST(max(obs_date) AS VARCHAR) AS as_of,
      round(arg_max(tmax_anom, obs_date), 4) AS recent_tmax_anomaly, CAST(bool_or(in_spell) AS INT) AS active,
      CASE WHEN bool_or(in_spell) THEN 'Heatwave conditions' ELSE 'No active heatwave' END AS status
      FROM spell WHERE age < 3 GROUP BY station""",
)
def heat_status(spark, sf):
    obs, c = clim_of(spark, sf, ["tmax"])
    h = hz.heat_status(hz.heat_days(obs, c))
    return h.select("station", s("as_of"), r("recent_tmax_anomaly"), F.col("active").cast("int").alias("active"), "status")


SEASON_SQL = """season AS (SELECT station, yr, obs_date, row_number() OVER w AS dos, sum(precip) OVER w AS cum,
    count(*) OVER (PARTITION BY station, yr) AS n,
    CASE WHEN count(*) OVER f = 7 THEN sum(precip) OVER f END AS run7
  FROM cal WHERE mo BETWEEN 6 AND 9
  WINDOW w AS (PARTITION BY station, yr ORDER BY obs_date), f AS (PARTITION BY station, yr ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
lens AS (SELECT station, min(n) AS len FROM season WHERE n >= 100 GROUP BY station),
last AS (SELECT station, max(yr) AS last_year FROM cal GROUP BY station),
curve AS (SELECT station, last_year, dos, avg(cum) FILTER (WHERE n >= 100) AS normal, max(cum) FILTER (WHERE yr = last_year) AS current
  FROM season JOIN lens USING (station) JOIN last USING (station) WHERE dos <= len GROUP BY ALL)"""


@query(
    "season_curve",
    f"""{SIMPLE}, {SEASON_SQL} SELECT station, last_year AS year, dos, round(normal, 4) AS normal, round(current, 4) AS current
      FROM curve WHERE (dos - 1) % 3 = 0""",
)
def season_curve(spark, sf):
    c = hz.monsoon_curve(shared(tb.daily(spark, sf))).filter((F.col("dos") - 1) % 3 == 0)
    return c.select("station", i("last_year", "year"), i("dos"), r("normal"), r("current"))


@query(
    "season_onset",
    f"""{SIMPLE}, {SEASON_SQL},
    tot AS (SELECT station, last_year, arg_max(normal, dos) AS seasonal_normal, coalesce(arg_max(current, dos) FILTER (WHERE current IS NOT NULL), 0) AS received
      FROM curve GROUP BY ALL)
    SELECT station, last_year AS year, round(seasonal_normal, 4) AS seasonal_normal, round(received, 4) AS received,
      round(received / (seasonal_normal + 1e-6) * 100, 4) AS progress_pct,
      (SELECT CAST(min(obs_date) AS VARCHAR) FROM season s WHERE s.station = tot.station AND s.yr = tot.last_year AND run7 >= 10) AS onset_date
    FROM tot""",
)
def season_onset(spark, sf):
    m = hz.monsoon_summary(shared(tb.daily(spark, sf)))
    return m.select("station", i("last_year", "year"), r("seasonal_normal"), r("received"), r("progress_pct"), s("onset_date"))


TREND_SQL = """annual AS (SELECT station, yr, avg(tmean) AS annual_mean, count(*) AS n_days FROM cal GROUP BY ALL),
fit AS (SELECT station, regr_slope(annual_mean, yr) AS slope, regr_intercept(annual_mean, yr) AS intercept, min(yr) AS y0, max(yr) AS y1
  FROM annual WHERE n_days >= 330 GROUP BY station)"""


@query(
    "warming_trend",
    f"""{SIMPLE}, {TREND_SQL} SELECT station, yr AS year, round(annual_mean, 4) AS annual_mean, round(slope * yr + intercept, 4) AS trend,
      round(slope * 10, 4) AS slope_per_decade, round(slope * (y1 - y0), 4) AS total_change FROM annual JOIN fit USING (station)""",
)
def warming_trend(spark, sf):
    w = hz.warming_trend(shared(tb.daily(spark, sf)))
    return w.select("station", i("year"), r("annual_mean"), r("trend"), r("slope_per_decade"), r("total_change"))


@query(
    "leak_free_trend",
    f"""{SIMPLE}, sp AS (SELECT station, max(yr) - 3 AS split FROM cal GROUP BY station),
    past AS (SELECT cal.* FROM cal JOIN sp USING (station) WHERE yr <= split),
    ann AS (SELECT station, yr, avg(tmean) AS m, count(*) AS n FROM past GROUP BY ALL),
    mid AS (SELECT station, avg(yr) AS mid_year FROM past GROUP BY station)
    SELECT station, round(regr_slope(m, yr) FILTER (WHERE n >= 330), 5) AS slope, round(any_value(mid_year), 4) AS mid_year
    FROM ann JOIN mid USING (station) GROUP BY station""",
)
def leak_free_trend(spark, sf):
    obs = shared(tb.daily(spark, sf))
    split = obs.groupBy("station").agg((F.max(F.year("obs_date")) - 3).alias("split_year"))
    return cl.leak_free_trend(obs, split).select("station", r("slope", 5), r("mid_year"))


EXTREME_SQL = """thr AS (SELECT station, coalesce(quantile_cont(precip, 0.95) FILTER (WHERE precip >= 1), 0) AS threshold FROM cal GROUP BY station),
heavy AS (SELECT station, yr, threshold, count(*) FILTER (WHERE precip >= threshold) AS days, count(*) AS n FROM cal JOIN thr USING (station) GROUP BY ALL),
latest AS (SELECT station, coalesce(max(yr) FILTER (WHERE n >= 330), max(yr)) AS ly FROM heavy GROUP BY station)"""


@query(
    "extreme_days",
    f"""{SIMPLE}, {EXTREME_SQL} SELECT station, yr AS year, days, round(threshold, 4) AS threshold FROM heavy
      QUALIFY row_number() OVER (PARTITION BY station ORDER BY yr DESC) <= 12""",
)
def extreme_days(spark, sf):
    h = hz.heavy_days(shared(tb.daily(spark, sf)))
    thr = h.groupBy("station").agg(F.max("threshold").alias("threshold"))
    return hz.days_per_year(h, "heavy").join(thr, "station").select("station", i("year"), i("days"), r("threshold"))


@query(
    "extreme_summary",
    f"""{SIMPLE}, {EXTREME_SQL} SELECT station, ly AS latest_year, max(days) FILTER (WHERE yr = ly) AS latest_days,
      round(coalesce(avg(days) FILTER (WHERE n >= 330 AND yr <> ly), max(days) FILTER (WHERE yr = ly)), 4) AS baseline_days
      FROM heavy JOIN latest USING (station) GROUP BY station, ly""",
)
def extreme_summary(spark, sf):
    per_year = hz.days_per_year(hz.heavy_days(shared(tb.daily(spark, sf))), "heavy", years=None)
    return hz.year_summary(per_year).select("station", i("latest_year"), i("latest_days"), r("baseline_days"))


@query(
    "frost_days",
    f"""{SIMPLE} SELECT station, yr AS year, count(*) FILTER (WHERE tmin <= 0) AS days FROM cal GROUP BY station, yr
      QUALIFY row_number() OVER (PARTITION BY station ORDER BY yr DESC) <= 12""",
)
def frost_days(spark, sf):
    return hz.days_per_year(hz.frost_days(tb.daily(spark, sf)), "frost").select("station", i("year"), i("days"))


@query(
    "cold_status",
    f"""{BASE} SELECT station, round(avg(tmin - tmin_mean), 4) AS recent_tmin_anomaly, CAST(avg(tmin - tmin_mean) <= -4.5 AS INT) AS active
      FROM cal JOIN clim USING (station, doy) WHERE age < 3 GROUP BY station""",
)
def cold_status(spark, sf):
    obs, c = clim_of(spark, sf, ["tmin"])
    return hz.cold_status(obs, c).select("station", r("recent_tmin_anomaly"), F.col("active").cast("int").alias("active"))


@query(
    "records",
    f"""{SIMPLE}, h AS (SELECT DISTINCT ON (station) station, tmax AS hottest, obs_date AS hottest_date FROM cal ORDER BY station, tmax DESC, obs_date),
    c AS (SELECT DISTINCT ON (station) station, tmin AS coldest, obs_date AS coldest_date FROM cal ORDER BY station, tmin, obs_date),
    w AS (SELECT DISTINCT ON (station) station, precip AS wettest, obs_date AS wettest_date FROM cal ORDER BY station, precip DESC, obs_date),
    n AS (SELECT station, min(obs_date) AS first_date, max(obs_date) AS last_date, count(*) AS record_days FROM cal GROUP BY station)
    SELECT station, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, record_days,
      round(hottest, 4) AS hottest, CAST(hottest_date AS VARCHAR) AS hottest_date, round(coldest, 4) AS coldest,
      CAST(coldest_date AS VARCHAR) AS coldest_date, round(wettest, 4) AS wettest, CAST(wettest_date AS VARCHAR) AS wettest_date
    FROM n JOIN h USING (station) JOIN c USING (station) JOIN w USING (station)""",
)
def records(spark, sf):
    d = hz.records(tb.daily(spark, sf))
    dates = ["first_date", "last_date", "hottest_date", "coldest_date", "wettest_date"]
    return d.select("station", "record_days", r("hottest"), r("coldest"), r("wettest"), *[s(c) for c in dates])


@query(
    "antecedent_index",
    f"""{SIMPLE} SELECT station, CAST(obs_date AS VARCHAR) AS obs_date, round(api, 4) AS api FROM (
      SELECT a.station, a.obs_date, sum(b.precip * pow(0.94, a.rn - b.rn)) AS api FROM cal a JOIN cal b
        ON a.station = b.station AND b.rn BETWEEN a.rn - 44 AND a.rn GROUP BY ALL)""",
)
def antecedent_index(spark, sf):
    return wn.antecedent_index(tb.daily(spark, sf)).select("station", s("obs_date"), r("api"))


STATE_SQL = """j AS (SELECT cal.*, tmean_mean, precip_mean FROM cal JOIN clim USING (station, doy) WHERE age < 90),
yrs AS (SELECT station, yr, avg(tmean) AS m FROM cal GROUP BY ALL),
sl AS (SELECT station, regr_slope(m, yr) AS slope FROM yrs GROUP BY station),
st AS (SELECT station, max(obs_date) AS as_of, avg(tmean) FILTER (WHERE age < 30) AS mean_temp, avg(tmean_mean) FILTER (WHERE age < 30) AS ct,
  sum(precip) FILTER (WHERE age < 30) AS p30, sum(precip) AS p90, sum(precip_mean) AS c90, stddev_pop(precip_mean) AS sd90,
  sum(precip * pow(0.94, age)) FILTER (WHERE age < 45) AS api FROM j GROUP BY station),
state AS (SELECT station, as_of, greatest(-70, least(100, (p90 / (c90 + 1e-6) - 1) * 100)) AS rain_anomaly_pct, mean_temp - ct AS temp_anomaly,
  greatest(0.05, least(0.95, 0.15 + api / 60)) AS soil_moisture, (p90 - c90) / (sd90 * sqrt(90) + 1e-6) AS z, slope * 10 AS trend_per_decade,
  mean_temp, p30 AS precip_30d FROM st JOIN sl USING (station)),
current_state AS (SELECT *, CASE WHEN z < -1.3 THEN 'Severe' WHEN z < -0.8 THEN 'Moderate' WHEN z < -0.5 THEN 'Mild' ELSE 'Normal' END AS drought_class FROM state)"""


def state_of(spark, sf):
    obs, c = clim_of(spark, sf, ["tmean", "precip"])
    return obs, c, hz.current_state(obs, c)


@query(
    "current_state",
    f"""{BASE}, {STATE_SQL} SELECT station, CAST(as_of AS VARCHAR) AS as_of, round(rain_anomaly_pct, 4) AS rain_anomaly_pct,
      round(temp_anomaly, 4) AS temp_anomaly, round(soil_moisture, 4) AS soil_moisture, drought_class, round(trend_per_decade, 4) AS trend_per_decade,
      round(mean_temp, 4) AS mean_temp, round(precip_30d, 4) AS precip_30d FROM current_state""",
)
def current_state(spark, sf):
    _, _, st = state_of(spark, sf)
    nums = ["rain_anomaly_pct", "temp_anomaly", "soil_moisture", "trend_per_decade", "mean_temp", "precip_30d"]
    return st.select("station", s("as_of"), "drought_class", *[r(c) for c in nums])


@query(
    "lag_features",
    f"""{SIMPLE} SELECT station, rn AS row_no, round(sin(2 * pi() * doy / 365.25), 6) AS sin1, round(cos(4 * pi() * doy / 365.25), 6) AS cos2,
      round(lag(tmean, 1) OVER w, 4) AS tmean_lag1, round(lag(precip, 30) OVER w, 4) AS precip_lag30,
      round(avg(tmean) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS tmean_mean7,
      round(sum(precip) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 4) AS precip_sum30
      FROM cal WINDOW w AS (PARTITION BY station ORDER BY obs_date)""",
)
def lag_features(spark, sf):
    f = wn.lag_features(cl.with_calendar(tb.daily(spark, sf)))
    return f.select(
        "station", i("row_no"), r("sin1", 6), r("cos2", 6), r("tmean_lag1"), r("precip_lag30"), r("tmean_mean7"), r("precip_sum30")
    )


@query(
    "sequence_windows",
    f"""{SIMPLE} SELECT station, CAST(a.obs_date AS VARCHAR) AS obs_date,
      round((SELECT sum(b.tmean * (b.rn - a.rn)) FROM cal b WHERE b.station = a.station AND b.rn BETWEEN a.rn - 30 AND a.rn - 1), 4) AS w_in,
      round((SELECT sum(b.tmean * (b.rn - a.rn + 1)) FROM cal b WHERE b.station = a.station AND b.rn BETWEEN a.rn AND a.rn + 13), 4) AS w_out
      FROM cal a WHERE rn > 30 AND age >= 13""",
)
def sequence_windows(spark, sf):
    w = wn.sequence_windows(tb.daily(spark, sf), "tmean")

    def folded(col: str, start: int):
        weighted = F.transform(F.col(col), lambda x, k: x * (k + F.lit(start)))
        return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)

    return w.select("station", s("obs_date"), r(folded("window_in", -30), 4, "w_in"), r(folded("window_out", 1), 4, "w_out"))


@query(
    "season_normals",
    f"""{BASE}, st AS (SELECT station, max(obs_date) AS start_date FROM cal GROUP BY station),
      span AS (SELECT station, start_date, least(dayofyear(CAST(start_date + CAST(k.range AS INT) AS DATE)), 365) AS doy FROM st, range(0, 30) k)
      SELECT station, CAST(start_date AS VARCHAR) AS start_date, round(avg(tmean_mean), 4) AS tmean_normal, round(avg(precip_mean), 4) AS precip_normal
      FROM span JOIN clim USING (station, doy) GROUP BY station, start_date""",
)
def season_normals(spark, sf):
    obs, c = clim_of(spark, sf, ["tmean", "precip"])
    starts = obs.groupBy("station").agg(F.max("obs_date").alias("start_date"))
    n = cl.season_window_normals(c, starts, ["tmean", "precip"])
    return n.select("station", s("start_date"), r("tmean_normal"), r("precip_normal"))


def _splice_clim(name, src):
    return f"""{name} AS (SELECT k.doy, avg(c.tmean) AS tmean, avg(c.precip) AS precip
  FROM (SELECT *, {DOY} AS doy FROM {src}) c JOIN (SELECT CAST(range AS BIGINT) AS doy FROM range(1, 366)) k
    ON abs((((c.doy - k.doy + 182) % 365 + 365) % 365) - 182) <= 3 GROUP BY k.doy)"""


@query(
    "live_tail_splice",
    f"""WITH {tb.ORDER_DAILY}, {tb.SHIP_DAILY}, e AS (SELECT max(obs_date) AS hist_end FROM order_daily),
    over_ AS (SELECT * FROM ship_daily, e WHERE obs_date <= hist_end),
    {_splice_clim('fc', 'over_')}, {_splice_clim('hc', 'order_daily')},
    tail AS (SELECT s.obs_date, hc.tmean + s.tmean - fc.tmean AS tmean,
       s.precip * CASE WHEN fc.precip > 0.15 THEN greatest(0.2, least(6.0, hc.precip / fc.precip)) ELSE 1.0 END AS precip, 1 AS is_tail
       FROM (SELECT *, {DOY} AS doy FROM ship_daily, e WHERE obs_date > hist_end) s JOIN fc USING (doy) JOIN hc USING (doy)
       WHERE (SELECT count(*) FROM over_) >= 365)
    SELECT CAST(obs_date AS VARCHAR) AS obs_date, round(tmean, 4) AS tmean, round(precip, 4) AS precip, is_tail FROM (
      SELECT obs_date, tmean, precip, 0 AS is_tail FROM order_daily UNION ALL SELECT * FROM tail)""",
)
def live_tail_splice(spark, sf):
    out = hz.splice_tail(shared(tb.order_daily(spark, sf)), shared(tb.ship_daily(spark, sf)))
    return out.select(s("obs_date"), r("tmean"), r("precip"), F.col("is_tail").cast("int").alias("is_tail"))


@query(
    "season_anchor",
    f"""{SIMPLE} SELECT station, CAST(coalesce(max(obs_date) FILTER (WHERE doy <= 247), max(obs_date)) AS VARCHAR) AS anchor_date FROM cal GROUP BY station""",
)
def season_anchor(spark, sf):
    """Same-season anchor for a forecast issued on 5 September 2001."""
    obs = cl.with_calendar(tb.daily(spark, sf))
    return wn.season_anchor(obs, F.lit("2001-09-05").cast("date"), ["station"]).select("station", s("anchor_date"))


@query(
    "hazard_summary",
    f"""SELECT station, as_of, active AS heat_active, recent_tmax_anomaly, spi, class AS spi_class, onset_date, progress_pct
      FROM ({ORACLES['heat_status']}) h LEFT JOIN (SELECT * FROM ({ORACLES['spi3_latest']}) WHERE age = 0) d USING (station) LEFT JOIN ({ORACLES['season_onset']}) m USING (station)""",
)
def hazard_summary(spark, sf):
    obs, c = clim_of(spark, sf, ["tmax"])
    d = hz.summary(obs, c)
    return d.select(
        "station", s("as_of"), F.col("heat_active").cast("int").alias("heat_active"), r("recent_tmax_anomaly"), r("spi"), "spi_class",
        s("onset_date"), r("progress_pct"),
    )


@query(
    "analytics_bundle",
    f"""SELECT station, record_days, hottest, coldest, wettest, slope_per_decade, latest_year, latest_days AS heavy_days, baseline_days, recent_tmin_anomaly
      FROM ({ORACLES['records']}) r LEFT JOIN (SELECT DISTINCT station, slope_per_decade FROM ({ORACLES['warming_trend']})) w USING (station)
      LEFT JOIN ({ORACLES['extreme_summary']}) e USING (station) LEFT JOIN ({ORACLES['cold_status']}) c USING (station)""",
)
def analytics_bundle(spark, sf):
    obs, c = clim_of(spark, sf, ["tmin"])
    d = hz.analytics(obs, c)
    nums = ["hottest", "coldest", "wettest", "slope_per_decade", "baseline_days", "recent_tmin_anomaly"]
    return d.select("station", "record_days", i("latest_year"), i("heavy_days"), *[r(x) for x in nums])


@query(
    "record_span",
    f"{SIMPLE} SELECT station, CAST(min(obs_date) AS VARCHAR) AS start, CAST(max(obs_date) AS VARCHAR) AS \"end\", count(*) AS days FROM cal GROUP BY station",
)
def record_span(spark, sf):
    return hz.record_span(tb.daily(spark, sf)).select("station", s("start"), s("end"), "days")
