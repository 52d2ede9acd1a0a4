"""Queries for station forecasts, backtests, blends, scenarios and advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import climatology as cl
from terraloom.operators import forecast as fc
from terraloom.operators import hazards as hz
from terraloom.operators import impact as im
from terraloom.operators import skill as sk
from terraloom.operators import windows as wn
from terraloom.plans.registry import ORACLES, query
from terraloom.plans.shape import i, r, s, shared
from terraloom.plans.station_queries import BASE, STATE_SQL, clim_of, state_of

TREND = """sp AS (SELECT station, max(yr) - 3 AS split FROM cal GROUP BY station),
past AS (SELECT cal.* FROM cal JOIN sp USING (station) WHERE yr <= split),
ann AS (SELECT station, yr, avg(tmean) AS m, count(*) AS n FROM past GROUP BY ALL),
tr AS (SELECT station, regr_slope(m, yr) FILTER (WHERE n >= 330) AS slope, (SELECT avg(p.yr) FROM past p WHERE p.station = ann.station) AS mid FROM ann GROUP BY station)"""


def frame_sql(v: str) -> str:
    off = "slope * (yr - mid)" if v == "tmean" else "0.0"
    lo = "-1e300" if v == "tmean" else "0.0"
    return f"""{TREND}, j AS (SELECT cal.*, {v}_mean AS nrm, {off} AS off FROM cal JOIN clim USING (station, doy) JOIN tr USING (station)),
og AS (SELECT *, avg({v}) OVER w - avg(nrm) OVER w - off AS anom5, {v} - nrm - off AS anom1, avg({v}) OVER w2 - avg(nrm) OVER w2 - off AS anom14 FROM j
  WINDOW w AS (PARTITION BY station ORDER BY obs_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY station ORDER BY obs_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
fr AS (SELECT o.station, o.obs_date AS issue_date, o.yr, l.range AS lead, t.{v} AS obs, t.nrm AS clim, t.nrm + o.off AS ct, o.anom5, o.anom14,
   greatest({lo}, t.nrm + o.off + o.anom5 * pow(0.7, l.range)) AS persist, greatest({lo}, t.nrm + o.off + o.anom1 * pow(0.6, l.range)) AS naive
  FROM og o CROSS JOIN range(1, 15) l JOIN og t ON t.station = o.station AND t.rn = o.rn + l.range WHERE o.rn > 60 AND o.age >= 14),
ph AS (SELECT station, lead, greatest(0, least(1, sum(anom14 * (obs - ct)) / (sum(anom14 * anom14) + 1e-9))) AS phi FROM fr JOIN sp USING (station) WHERE yr <= split GROUP BY ALL),
fr2 AS (SELECT fr.*, greatest({lo}, ct + phi * anom14) AS damped FROM fr JOIN ph USING (station, lead)),
gm AS (SELECT station, lead, count(*) AS n, sum((persist - ct) * (persist - ct)) AS g00, sum((persist - ct) * (naive - ct)) AS g01, sum((persist - ct) * (damped - ct)) AS g02,
   sum((naive - ct) * (naive - ct)) AS g11, sum((naive - ct) * (damped - ct)) AS g12, sum((damped - ct) * (damped - ct)) AS g22,
   sum((persist - ct) * (obs - ct)) AS b0, sum((naive - ct) * (obs - ct)) AS b1, sum((damped - ct) * (obs - ct)) AS b2
  FROM fr2 JOIN sp USING (station) WHERE yr = split + 1 GROUP BY ALL),
dt AS (SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM gm),
cd AS (SELECT station, lead, 0.0 AS w0, 0.0 AS w1, 0.0 AS w2, b0, b1, b2, 1.0 AS d FROM dt
  UNION ALL SELECT station, lead, b0 / g00, 0, 0, b0, b1, b2, g00 FROM dt UNION ALL SELECT station, lead, 0, b1 / g11, 0, b0, b1, b2, g11 FROM dt UNION ALL SELECT station, lead, 0, 0, b2 / g22, b0, b1, b2, g22 FROM dt
  UNION ALL SELECT station, lead, (b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01), (b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01), 0, b0, b1, b2, g00 * g11 - g01 * g01 FROM dt
  UNION ALL SELECT station, lead, (b0 * g22 - b2 * g02) / (g00 * g22 - g02 * g02), 0, (b2 * g00 - b0 * g02) / (g00 * g22 - g02 * g02), b0, b1, b2, g00 * g22 - g02 * g02 FROM dt
  UNION ALL SELECT station, lead, 0, (b1 * g22 - b2 * g12) / (g11 * g22 - g12 * g12), (b2 * g11 - b1 * g12) / (g11 * g22 - g12 * g12), b0, b1, b2, g11 * g22 - g12 * g12 FROM dt
  UNION ALL SELECT station, lead, (b0 * (g11 * g22 - g12 * g12) - g01 * (b1 * g22 - g12 * b2) + g02 * (b1 * g12 - g11 * b2)) / det, (g00 * (b1 * g22 - g12 * b2) - b0 * (g01 * g22 - g12 * g02) + g02 * (g01 * b2 - b1 * g02)) / det,
    (g00 * (g11 * b2 - b1 * g12) - g01 * (g01 * b2 - b1 * g02) + b0 * (g01 * g12 - g11 * g02)) / det, b0, b1, b2, det FROM dt),
wt AS (SELECT DISTINCT ON (station, lead) station, lead, w0, w1, w2 FROM cd WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0 AND abs(d) > 1e-12 ORDER BY station, lead, w0 * b0 + w1 * b1 + w2 * b2 DESC),
bl AS (SELECT fr2.*, greatest({lo}, ct + w0 * (persist - ct) + w1 * (naive - ct) + w2 * (damped - ct)) AS blend FROM fr2 JOIN wt USING (station, lead)),
ts AS (SELECT bl.* FROM bl JOIN sp USING (station) WHERE yr > split + 1),
lg AS (UNPIVOT (SELECT station, lead, obs, clim, ct AS clim_trend, persist, naive, damped, blend FROM ts) ON clim, clim_trend, persist, naive, damped, blend INTO NAME method VALUE pred),
sc AS (SELECT station, method, lead, sqrt(avg(pow(pred - obs, 2))) AS rmse, avg(abs(pred - obs)) AS mae FROM lg GROUP BY GROUPING SETS ((station, method), (station, method, lead)))"""


MEMBERS = ["persist", "naive", "damped"]
METHODS = ["clim", "clim_trend", *MEMBERS, "blend"]


def parts(spark, sf, value):
    """Frame, weights and blended frame of one variable."""
    obs, clim = clim_of(spark, sf, ["tmean", "precip"])
    obs, clim = obs, shared(clim)
    split = fc.split_years(obs)
    trend = shared(cl.leak_free_trend(obs, split))
    frame = shared(fc.backtest_frame(obs, clim, value, trend))
    frame = fc.with_fitted(frame, fc.fitted_decay(frame, split), value)
    val = frame.join(split, "station").filter(F.col("year") == F.col("split_year") + 1)
    weights = shared(fc.nnls3(fc.gram(val, MEMBERS, ["station", "lead"])))
    return obs, clim, split, trend, frame, weights


def scored(spark, sf, value):
    obs, clim, split, trend, frame, weights = parts(spark, sf, value)
    test = fc.blend(frame, weights, MEMBERS, value).join(split, "station").filter(F.col("year") > F.col("split_year") + 1)
    return obs, clim, trend, weights, sk.scores_by_lead(test, METHODS, ["station"])


@query(
    "persistence_backtest",
    f"""{BASE}, {frame_sql('tmean')} SELECT station, lead, count(*) AS n, round(avg(obs - clim), 4) AS mean_anom, round(sqrt(avg(pow(persist - obs, 2))), 4) AS persist_rmse,
      round(sqrt(avg(pow(ct - obs, 2))), 4) AS trend_rmse, round((1 - sqrt(avg(pow(persist - obs, 2))) / sqrt(avg(pow(ct - obs, 2)))) * 100, 4) AS skill_pct FROM fr GROUP BY ALL""",
)
def persistence_backtest(spark, sf):
    obs, clim = clim_of(spark, sf, ["tmean"])
    trend = cl.leak_free_trend(obs, fc.split_years(obs))
    f = fc.backtest_frame(obs, clim, "tmean", trend)
    m = shared(f).groupBy("station", "lead").agg(F.avg(F.col("obs") - F.col("clim")).alias("mean_anom"))
    sc = sk.scores(shared(f), ["station", "lead"], "persist", "obs", "clim_trend").join(m, ["station", "lead"])
    return sc.select("station", i("lead"), "n", r("mean_anom"), r("rmse", 4, "persist_rmse"), r("base_rmse", 4, "trend_rmse"), r("skill_pct"))


@query("nnls_blend", f"{BASE}, {frame_sql('tmean')} SELECT station, lead, round(w0, 4) AS w0, round(w1, 4) AS w1, round(w2, 4) AS w2 FROM wt")
def nnls_blend(spark, sf):
    return parts(spark, sf, "tmean")[5].select("station", i("lead"), r("w0"), r("w1"), r("w2"))


@query("nnls_blend_rain", f"{BASE}, {frame_sql('precip')} SELECT station, lead, round(w0, 4) AS w0, round(w1, 4) AS w1, round(w2, 4) AS w2 FROM wt")
def nnls_blend_rain(spark, sf):
    return parts(spark, sf, "precip")[5].select("station", i("lead"), r("w0"), r("w1"), r("w2"))


@query(
    "rmse_by_lead",
    f"""{BASE}, {frame_sql('tmean')} SELECT s.station, s.method, s.lead, round(s.rmse, 4) AS rmse, round(s.mae, 4) AS mae, round((1 - s.rmse / b.rmse) * 100, 4) AS skill_pct
      FROM sc s JOIN sc b ON b.station = s.station AND b.method = 'clim' AND b.lead IS NOT DISTINCT FROM s.lead""",
)
def rmse_by_lead(spark, sf):
    sc = scored(spark, sf, "tmean")[4]
    return sc.select("station", "method", i("lead"), r("rmse"), r("mae"), r("skill_pct"))


@query(
    "best_method",
    f"""{BASE}, {frame_sql('tmean')} SELECT DISTINCT ON (station) station, method AS best, round(rmse, 4) AS rmse FROM sc WHERE lead IS NULL ORDER BY station, round(rmse, 9), list_position(['clim', 'clim_trend', 'persist', 'naive', 'damped', 'blend'], method)""",
)
def best_method(spark, sf):
    return sk.best_method(scored(spark, sf, "tmean")[4], ["station"], METHODS).select("station", "best", r("rmse"))


@query(
    "model_cards",
    f"""{BASE}, {frame_sql('tmean')} SELECT b.station, round(b.rmse, 4) AS rmse, round((1 - b.rmse / c.rmse) * 100, 4) AS skill_pct, round(c.rmse, 4) AS baseline_rmse, round((1 - p.rmse / c.rmse) * 100, 4) AS persist_skill
      FROM sc b JOIN sc c USING (station) JOIN sc p USING (station) WHERE b.method = 'blend' AND c.method = 'clim' AND p.method = 'persist' AND b.lead IS NULL AND c.lead IS NULL AND p.lead IS NULL""",
)
def model_cards(spark, sf):
    m = sk.model_cards(scored(spark, sf, "tmean")[4], ["station"])
    return m.select("station", r("rmse"), r("skill_pct"), r("baseline_rmse"), r(F.element_at("members", "persist"), 4, "persist_skill"))


def live_sql(v: str, tag: str) -> str:
    """The newest issue date with the blend; CTE names end with ``tag``."""
    lo = "-1e300" if v == "tmean" else "0.0"
    off = "o.off"
    return f"""lv{tag} AS (SELECT o.station, l.range AS lead, CAST(o.obs_date + CAST(l.range AS INT) AS DATE) AS td, o.anom5, o.anom14, o.anom1, {off} AS off FROM og o CROSS JOIN range(1, 15) l WHERE o.age = 0),
lm{tag} AS (SELECT lv{tag}.*, c.{v}_mean AS clim, c.{v}_mean + off AS ct, greatest({lo}, c.{v}_mean + off + anom5 * pow(0.7, lead)) AS persist, greatest({lo}, c.{v}_mean + off + anom1 * pow(0.6, lead)) AS naive,
   greatest({lo}, c.{v}_mean + off + phi * anom14) AS damped FROM lv{tag} JOIN (SELECT station AS pst, lead AS pld, phi FROM ph) ON pst = lv{tag}.station AND pld = lv{tag}.lead JOIN clim c ON c.station = lv{tag}.station AND c.doy = least(dayofyear(td), 365)),
fv{tag} AS (SELECT lm{tag}.station, lead, td, clim, greatest({lo}, ct + w0 * (persist - ct) + w1 * (naive - ct) + w2 * (damped - ct)) AS value, rmse
  FROM lm{tag} JOIN wt USING (station, lead) JOIN (SELECT station, lead, rmse FROM sc WHERE method = 'blend' AND lead IS NOT NULL) USING (station, lead))"""


def live_forecast(spark, sf, value):
    obs, clim, split, trend, frame, weights = parts(spark, sf, value)
    test = fc.blend(frame, weights, MEMBERS, value).join(split, "station").filter(F.col("year") > F.col("split_year") + 1)
    by_lead = sk.scores_by_lead(test, ["clim", "blend"], ["station"]).filter((F.col("method") == "blend") & F.col("lead").isNotNull())
    live = fc.with_fitted(fc.live_rows(obs, clim, value, trend), fc.fitted_decay(frame, split), value)
    return obs, clim, fc.blended_forecast(live, weights, by_lead, MEMBERS, value)


@query(
    "blended_forecast",
    f"""{BASE}, {frame_sql('tmean')}, {live_sql('tmean', '')} SELECT station, lead, CAST(td AS VARCHAR) AS target_date, round(value, 4) AS value, round(value + rmse, 4) AS upper, round(value - rmse, 4) AS lower,
      'W' || CAST(weekofyear(td) AS VARCHAR) AS week FROM fv""",
)
def blended_forecast(spark, sf):
    from terraloom.functions.calendar import week_label

    f = live_forecast(spark, sf, "tmean")[2]
    return f.select("station", i("lead"), s("target_date"), r("value"), r("upper"), r("lower"), week_label(F.col("target_date")).alias("week"))


@query(
    "blended_forecast_rain",
    f"""{BASE}, {frame_sql('precip')}, {live_sql('precip', '')} SELECT station, lead, round(value, 4) AS value, round(value + rmse, 4) AS upper, round(greatest(0, value - rmse), 4) AS lower FROM fv""",
)
def blended_forecast_rain(spark, sf):
    f = live_forecast(spark, sf, "precip")[2]
    return f.select("station", i("lead"), r("value"), r("upper"), r("lower"))


def outlook_parts(spark, sf):
    obs, clim, rain = live_forecast(spark, sf, "precip")
    _, _, temp = live_forecast(spark, sf, "tmean")
    return obs, clim, shared(rain), shared(temp)


@query(
    "climatology_rmse",
    f"{BASE} SELECT station, count(*) AS n, round(sqrt(avg(pow(tmean - tmean_mean, 2))), 4) AS rmse FROM cal JOIN clim USING (station, doy) WHERE age < 365 GROUP BY station",
)
def climatology_rmse(spark, sf):
    obs, clim = clim_of(spark, sf, ["tmean"])
    return fc.climatology_rmse(obs, clim, "tmean").select("station", "n", r("rmse"))


from terraloom.schemas import DISTRICTS  # noqa: E402

DIM = ", ".join(f"({k}, '{n}', {e}, {m}, {((k * 37) % 11 - 5) / 10.0})" for k, (n, e, m) in enumerate(DISTRICTS))
LAYER = f"""dim(ord, name, elev, rmul, jit) AS (VALUES {DIM}),
layer AS (SELECT station, name, ord, greatest(-72, least(100, rain_anomaly_pct * rmul + jit * 6)) AS rain, temp_anomaly + (2.0 - elev) * 0.35 + jit * 0.1 AS temp,
  greatest(0.05, least(0.95, soil_moisture + (elev - 1.2) * 0.05 + jit * 0.02)) AS soil FROM current_state CROSS JOIN dim)"""


@query("district_layer", f"{BASE}, {STATE_SQL}, {LAYER} SELECT station, name, round(rain, 4) AS rain, round(temp, 4) AS temp, round(soil, 4) AS soil FROM layer")
def district_layer(spark, sf):
    return im.districts(state_of(spark, sf)[2]).select("station", "name", r("rain"), r("temp"), r("soil"))


DISTRICT_RANKING = f"""{BASE}, {STATE_SQL}, {LAYER} SELECT station, coalesce(string_agg(name, ',' ORDER BY rain, ord) FILTER (WHERE rain < -20), '') AS dry,
      coalesce(string_agg(name, ',' ORDER BY rain DESC, ord) FILTER (WHERE rain > 25), '') AS wet FROM layer GROUP BY station"""


@query("district_ranking", DISTRICT_RANKING)
def district_ranking(spark, sf):
    d = im.ranked_districts(im.districts(state_of(spark, sf)[2]))
    return d.select("station", F.array_join("dry", ",").alias("dry"), F.array_join("wet", ",").alias("wet"))


SCENARIOS = [(0, 0), (-40, 2), (-20, 1), (30, -1), (60, 0), (-80, 4), (15, 3)]
SWEEP = f"""st0 AS (SELECT station, max(obs_date) AS start_date FROM cal GROUP BY station),
span AS (SELECT station, least(dayofyear(CAST(start_date + CAST(k.range AS INT) AS DATE)), 365) AS doy FROM st0, range(0, 30) k),
nr AS (SELECT station, avg(tmean_mean) AS tm, avg(precip_mean) AS rain FROM span JOIN clim USING (station, doy) GROUP BY station),
bs AS (SELECT nr.station, rain, greatest(0.8, 1.6 + 0.16 * tm) AS et0, soil_moisture AS sm0 FROM nr JOIN current_state USING (station)),
scn(rp, tc) AS (VALUES {', '.join(f'({a}.0, {b}.0)' for a, b in SCENARIOS)}),
rs AS (SELECT *, rain * (1 + rp / 100) AS ar, et0 * 0.85 * (1 + 0.065 * tc) AS ae, rain - et0 * 0.85 AS bn FROM bs CROSS JOIN scn),
r2 AS (SELECT *, greatest(0.05, least(0.95, sm0 + ((ar - ae) - bn) * 30 / 150)) AS sm FROM rs),
r3 AS (SELECT *, greatest(0, least(100, round_even((CASE WHEN sm < 0.35 THEN (0.35 - sm) / 0.35 * 55 WHEN sm < 0.45 THEN (0.45 - sm) / 0.45 * 20 ELSE 0 END) + greatest(0, -rp) * 0.55 + greatest(0, tc) * 6.5, 0))) AS drought,
  greatest(0, least(100, round_even(greatest(0, least(1, (0.5 - sm) / 0.5)) * 70 + greatest(0, least(1, ae / (et0 * 0.85) - 1)) * 60 + greatest(0, least(1, -rp / 100)) * 20, 0))) AS crop,
  greatest(-85, least(120, round_even(rp * 1.6 - tc * 3.5, 0))) AS inflow FROM r2),
r4 AS (SELECT *, greatest(0, least(100, round_even(greatest(0, -inflow) * 1.05 + greatest(0, tc) * 3, 0))) AS hydro,
  greatest(0, least(100, round_even((CASE WHEN sm < 0.45 THEN (0.45 - sm) / 0.45 * 70 ELSE 0 END) + greatest(0, -inflow) * 0.35, 0))) AS supply FROM r3)"""


def sweep(spark, sf):
    obs, clim, state = state_of(spark, sf)
    starts = obs.groupBy("station").agg(F.max("obs_date").alias("start_date"))
    base = im.season_baseline(cl.season_window_normals(clim, starts, ["tmean", "precip"]), state)
    return im.scenario_sweep(base, SCENARIOS)


@query(
    "scenario_sweep",
    f"""{BASE}, {STATE_SQL}, {SWEEP} SELECT station, CAST(rp AS DOUBLE) AS rain_pct, CAST(tc AS DOUBLE) AS temp_c, round(sm, 4) AS soil_moisture, CAST(drought AS BIGINT) AS drought_score, CAST(crop AS BIGINT) AS crop_score, CAST(inflow AS BIGINT) AS inflow_change_pct,
      round(ar - ae, 4) AS net, CASE WHEN crop < 25 THEN 'Low' WHEN crop < 50 THEN 'Moderate' WHEN crop < 75 THEN 'High' ELSE 'Severe' END AS crop_label FROM r4""",
)
def scenario_sweep(spark, sf):
    d = sweep(spark, sf)
    return d.select("station", "rain_pct", "temp_c", r("soil_moisture"), i("drought_score"), i("crop_score"), i("inflow_change_pct"), r("net"), "crop_label")


@query(
    "sector_risks",
    f"""{BASE}, {STATE_SQL}, {SWEEP}, l AS (SELECT station, rp, tc, 'Agriculture' AS sector, crop AS v FROM r4 UNION ALL SELECT station, rp, tc, 'Hydropower', hydro FROM r4 UNION ALL SELECT station, rp, tc, 'Water supply', supply FROM r4)
    SELECT station, CAST(rp AS DOUBLE) AS rain_pct, CAST(tc AS DOUBLE) AS temp_c, sector, CAST(v AS BIGINT) AS risk_score, CASE WHEN v < 25 THEN 'Low' WHEN v < 50 THEN 'Moderate' WHEN v < 75 THEN 'High' ELSE 'Severe' END AS risk_label FROM l""",
)
def sector_risks(spark, sf):
    return im.sector_risks(im.narrative(sweep(spark, sf))).withColumn("risk_score", i("risk_score"))


def _live(value: str) -> str:
    """The live forecast of a variable as a nested query."""
    return f"({BASE}, {frame_sql(value)}, {live_sql(value, '')} SELECT station, lead, td, clim, value, rmse FROM fv)"


OUTLOOK = f"""rf AS {_live('precip')}, tf AS {_live('tmean')}"""


@query(
    "soil_outlook",
    f"""{BASE}, {STATE_SQL}, {OUTLOOK},
    sq AS (SELECT station, obs_date AS day, -age AS step, precip AS rain, tmean AS temp, 0.0 AS spread FROM cal WHERE age < 7
      UNION ALL SELECT r.station, r.td, r.lead, r.value, t.value, r.rmse FROM rf r JOIN tf t ON t.station = r.station AND t.lead = r.lead),
    dl AS (SELECT sq.*, CASE WHEN step = -6 THEN 0.0 ELSE 0.012 * (rain - precip_mean) - 0.007 * (temp - tmean_mean) END AS d FROM sq JOIN clim c ON c.station = sq.station AND c.doy = least(dayofyear(day), 365)),
    rw AS (SELECT *, sum(d) OVER (PARTITION BY station ORDER BY step) AS raw FROM dl),
    so AS (SELECT rw.station, day, step, greatest(0.08, least(0.95, raw + soil_moisture - (SELECT z.raw FROM rw z WHERE z.station = rw.station AND z.step = 0))) AS soil, CASE WHEN step > 0 THEN 0.012 * spread * sqrt(step) ELSE 0 END AS b FROM rw JOIN current_state st ON st.station = rw.station),
    dr AS (SELECT *, greatest(0, least(100, (0.55 - soil) * 185)) AS risk FROM so)
    SELECT station, CAST(day AS VARCHAR) AS day, step, round(soil, 4) AS soil, round(least(0.95, soil + b), 4) AS soil_upper, round(greatest(0, soil - b), 4) AS soil_lower,
      round(risk, 4) AS drought_risk, round(least(100, risk + b * 185), 4) AS risk_upper, round(greatest(0, risk - b * 185), 4) AS risk_lower FROM dr""",
)
def soil_outlook(spark, sf):
    obs, clim, rain, temp = outlook_parts(spark, sf)
    state = hz.current_state(obs, clim)
    o = fc.soil_outlook(wn.last_rows(obs, 7, ["station"]), rain, temp, clim, state)
    cols = ["soil", "soil_upper", "soil_lower", "drought_risk", "risk_upper", "risk_lower"]
    return o.select("station", s("day"), i("step"), *[r(c) for c in cols])


@query(
    "outlook_totals",
    f"""WITH {OUTLOOK} SELECT station, round(sum(r.value), 4) AS rain_total, round(sum(r.clim), 4) AS rain_normal, round(avg(t.value), 4) AS temp_mean, round(avg(t.clim), 4) AS temp_normal
      FROM rf r JOIN tf t USING (station, lead) GROUP BY station""",
)
def outlook_totals(spark, sf):
    _, _, rain, temp = outlook_parts(spark, sf)
    o = fc.outlook_totals(rain, temp)
    return o.select("station", *[r(c) for c in ("rain_total", "rain_normal", "temp_mean", "temp_normal")])


def _names(col: str, n: int) -> str:
    return f"CASE WHEN {col} = '' THEN 'Statewide' ELSE array_to_string(string_split({col}, ',')[1:{n}], ', ') END"


@query(
    "advisories",
    f"""{BASE}, {STATE_SQL}, hw AS ({ORACLES['heat_status']}), cw AS ({ORACLES['cold_status']}), dk AS ({DISTRICT_RANKING}),
    adv AS (SELECT c.*, dry, wet, hw.active AS hot, cw.active AS cold FROM current_state c JOIN dk USING (station) JOIN hw USING (station) JOIN cw USING (station))
    SELECT station, 0 AS ord, 'warning' AS level, drought_class || ' drought watch' AS title, {_names('dry', 4)} AS districts FROM adv WHERE drought_class IN ('Moderate', 'Severe')
    UNION ALL SELECT station, 1, 'warning', 'Above-normal rainfall: flash-flood and landslide watch', {_names('wet', 4)} FROM adv WHERE rain_anomaly_pct > 25
    UNION ALL SELECT station, 2, 'warning', 'Elevated surface temperature', 'Jammu, Kathua, Udhampur' FROM adv WHERE temp_anomaly > 1
    UNION ALL SELECT station, 3, 'warning', 'Below-normal temperature: cold advisory', 'Srinagar, Anantnag, Baramulla' FROM adv WHERE temp_anomaly < -1
    UNION ALL SELECT station, 4, 'alert', 'Root-zone soil-moisture stress', {_names('dry', 3)} FROM adv WHERE soil_moisture < 0.35
    UNION ALL SELECT station, 5, 'info', 'High soil saturation', {_names('wet', 3)} FROM adv WHERE soil_moisture > 0.6
    UNION ALL SELECT station, 6, 'info', '14-day outlook', 'Statewide' FROM adv
    UNION ALL SELECT station, 7, 'alert', 'Heatwave conditions', 'Jammu, Kathua, Samba' FROM adv WHERE hot = 1
    UNION ALL SELECT station, 8, 'alert', 'Cold-snap conditions', 'Srinagar, Anantnag, Kishtwar' FROM adv WHERE cold = 1""",
)
def advisories(spark, sf):
    """Advisory rows; the outlook's title is cut at its colon (its numbers are checked by
    ``outlook_totals``)."""
    obs, clim, rain, temp = outlook_parts(spark, sf)
    clim4 = cl.doy_climatology(obs, ["tmax", "tmin"])
    state = shared(hz.current_state(obs, clim))
    ranked = im.ranked_districts(im.districts(state))
    heat, cold = hz.heat_status(hz.heat_days(obs, clim4)), hz.cold_status(obs, clim4)
    a = im.advisories(state, ranked, heat, cold, fc.outlook_totals(rain, temp))
    title = F.when(F.col("ord") == 6, F.substring_index("title", ":", 1)).otherwise(F.col("title")).alias("title")
    return a.select("station", "ord", "level", title, "districts")
