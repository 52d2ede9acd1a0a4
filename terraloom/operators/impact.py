"""District layer, water-balance scenarios and advisories derived from station states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.numeric import bands, clip
from terraloom.schemas import DISTRICTS

# Crop coefficient, root-zone water capacity (mm), length of the season (days).
CROP_COEFFICIENT, ROOT_ZONE_MM, SEASON_DAYS = 0.85, 150.0, 30


def districts(state: DataFrame) -> DataFrame:
    """State anomaly disaggregated to the districts: rain by multiplier, temperature and soil
    by elevation, plus a fixed small offset per district. The nine districts are an array
    literal exploded on each state row, so there is no join."""
    dim = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(e).alias("elev"), F.lit(m).alias("rmul"), F.lit(((k * 37) % 11 - 5) / 10.0).alias("jit"), F.lit(k).alias("ord"))
            for k, (n, e, m) in enumerate(DISTRICTS)
        ]
    )
    d = state.withColumn("_d", F.explode(dim)).select(*state.columns, "_d.*")
    return d.select(
        "station", "name", "ord",
        clip(F.col("rain_anomaly_pct") * F.col("rmul") + F.col("jit") * 6, -72, 100).alias("rain"),
        (F.col("temp_anomaly") + (2.0 - F.col("elev")) * 0.35 + F.col("jit") * 0.1).alias("temp"),
        clip(F.col("soil_moisture") + (F.col("elev") - 1.2) * 0.05 + F.col("jit") * 0.02, 0.05, 0.95).alias("soil"),
    )


def risk_level(score: Column) -> Column:
    return bands(score, [("<", 25.0, "Low"), ("<", 50.0, "Moderate"), ("<", 75.0, "High")], "Severe")


def season_baseline(normals: DataFrame, state: DataFrame) -> DataFrame:
    """Baseline of the scenarios: normal rain and temperature of the coming season, the
    reference evapotranspiration and today's soil moisture."""
    j = normals.join(state.select("station", "soil_moisture"), "station")
    return j.select(
        "station", F.col("precip_normal").alias("rain"), F.col("tmean_normal").alias("tmean"),
        F.greatest(F.lit(0.8), 1.6 + 0.16 * F.col("tmean_normal")).alias("et0"), F.col("soil_moisture").alias("sm"),
    )


def _score(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return clip(F.bround(x, 0), lo, hi).cast("int")


def respond(rows: DataFrame) -> DataFrame:
    """Water-balance response of rows (rain, et0, sm, rain_pct, temp_c): soil moisture,
    drought and crop scores, reservoir inflow, sector risks."""
    c = F.col
    base_et = c("et0") * CROP_COEFFICIENT
    d = rows.withColumns(
        {
            "actual_rain": c("rain") * (1 + c("rain_pct") / 100),
            "actual_et": base_et * (1 + 0.065 * c("temp_c")),
            "base_net": c("rain") - base_et,
        }
    )
    d = d.withColumn("net", c("actual_rain") - c("actual_et"))
    d = d.withColumn("soil_moisture", clip(c("sm") + (c("net") - c("base_net")) * SEASON_DAYS / ROOT_ZONE_MM, 0.05, 0.95))
    sm, zero = c("soil_moisture"), F.lit(0.0)
    dry = F.greatest(zero, -c("rain_pct").cast("double"))
    warm = F.greatest(zero, c("temp_c").cast("double"))
    sm_risk = F.when(sm < 0.35, (0.35 - sm) / 0.35 * 55).when(sm < 0.45, (0.45 - sm) / 0.45 * 20).otherwise(zero)
    crop = (
        clip((0.5 - sm) / 0.5, 0, 1) * 70 + clip(c("actual_et") / base_et - 1, 0, 1) * 60 + clip(-c("rain_pct") / 100.0, 0, 1) * 20
    )
    d = d.withColumns(
        {
            "drought_score": _score(sm_risk + dry * 0.55 + warm * 6.5),
            "crop_score": _score(crop),
            "inflow_change_pct": _score(c("rain_pct") * 1.6 - c("temp_c") * 3.5, -85, 120),
        }
    )
    loss = F.greatest(F.lit(0), -c("inflow_change_pct")).cast("double")
    return d.withColumns(
        {
            "crop_label": risk_level(c("crop_score")),
            "hydro_score": _score(loss * 1.05 + warm * 3),
            "supply_score": _score(F.when(sm < 0.45, (0.45 - sm) / 0.45 * 70).otherwise(zero) + loss * 0.35),
        }
    ).withColumns({"hydro_label": risk_level(c("hydro_score")), "supply_label": risk_level(c("supply_score"))})


def scenario_sweep(baseline: DataFrame, scenarios: list[tuple[float, float]]) -> DataFrame:
    """Every baseline under every scenario (rain change in %, temperature change in degC).
    The scenarios are a user's short list, exploded on each baseline row."""
    arr = F.array(*[F.struct(F.lit(float(r)).alias("rain_pct"), F.lit(float(t)).alias("temp_c")) for r, t in scenarios])
    return respond(baseline.withColumn("_s", F.explode(arr)).select(*baseline.columns, "_s.*"))


def sector_risks(response: DataFrame) -> DataFrame:
    """Agriculture, hydropower and water supply as rows."""
    arr = F.array(
        *[
            F.struct(F.lit(n).alias("sector"), F.col(f"{k}_score").alias("risk_score"), F.col(f"{k}_label").alias("risk_label"))
            for n, k in (("Agriculture", "crop"), ("Hydropower", "hydro"), ("Water supply", "supply"))
        ]
    )
    return response.withColumn("_s", F.explode(arr)).select("station", "rain_pct", "temp_c", "_s.*")


def narrative(response: DataFrame) -> DataFrame:
    c = F.col
    rain = F.when(c("rain_pct") < 0, "deficit").when(c("rain_pct") > 0, "surplus").otherwise("normal rainfall")
    temp = F.when(c("temp_c") > 0, "warming").when(c("temp_c") < 0, "cooling").otherwise("no temperature change")
    return response.withColumn(
        "narrative",
        F.format_string(
            "rain %.0f%% (%s), temperature %+.1f degC (%s): net %+.1f mm/day (normal %+.1f), soil moisture %.2f, drought risk %d/100, crop stress %s, inflow %+d%%",
            c("rain_pct"), rain, c("temp_c"), temp, c("net"), c("base_net"), c("soil_moisture"), c("drought_score"), F.lower("crop_label"), c("inflow_change_pct"),
        ),
    )


def ranked_districts(layer: DataFrame, dry_below: float = -20.0, wet_above: float = 25.0) -> DataFrame:
    """Per station the districts drier than one limit (driest first) and wetter than the
    other (wettest first); a station has nine districts."""
    r = F.col("rain")
    dry = F.sort_array(F.collect_list(F.when(r < dry_below, F.struct(r.alias("v"), F.col("ord").alias("o"), F.col("name").alias("n")))))
    wet = F.sort_array(F.collect_list(F.when(r > wet_above, F.struct((-r).alias("v"), F.col("ord").alias("o"), F.col("name").alias("n")))))
    return layer.groupBy("station").agg(dry.alias("_d"), wet.alias("_w")).select("station", F.col("_d.n").alias("dry"), F.col("_w.n").alias("wet"))


def _first(names: str, n: int) -> Column:
    return F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, n), ", ")).otherwise("Statewide")


def advisories(state: DataFrame, ranked: DataFrame, heat: DataFrame, cold: DataFrame, outlook: DataFrame) -> DataFrame:
    """Zero or more advisory rows per station from state, outlook and hazard flags."""
    j = state.join(ranked, "station").join(heat.select("station", F.col("active").alias("_hot")), "station", "left")
    j = j.join(cold.select("station", F.col("active").alias("_cold")), "station", "left").join(outlook, "station", "left")
    c = F.col
    ra, ta, sm = c("rain_anomaly_pct"), c("temp_anomaly"), c("soil_moisture")

    def row(when: Column, level: str, title: Column | str, where: Column | str, order: int) -> Column:
        t = title if isinstance(title, Column) else F.lit(title)
        w = where if isinstance(where, Column) else F.lit(where)
        return F.when(when, F.struct(F.lit(order).alias("ord"), F.lit(level).alias("level"), t.alias("title"), w.alias("districts")))

    rows = [
        row(c("drought_class").isin("Moderate", "Severe"), "warning", F.concat("drought_class", F.lit(" drought watch")), _first("dry", 4), 0),
        row(ra > 25, "warning", "Above-normal rainfall: flash-flood and landslide watch", _first("wet", 4), 1),
        row(ta > 1.0, "warning", "Elevated surface temperature", "Jammu, Kathua, Udhampur", 2),
        row(ta < -1.0, "warning", "Below-normal temperature: cold advisory", "Srinagar, Anantnag, Baramulla", 3),
        row(sm < 0.35, "alert", "Root-zone soil-moisture stress", _first("dry", 3), 4),
        row(sm > 0.6, "info", "High soil saturation", _first("wet", 3), 5),
        row(
            c("rain_total").isNotNull(), "info",
            F.format_string("14-day outlook: %.0f mm of rain (normal %.0f), %.1f degC (normal %.1f)", "rain_total", "rain_normal", "temp_mean", "temp_normal"),
            "Statewide", 6,
        ),
        row(c("_hot"), "alert", "Heatwave conditions", "Jammu, Kathua, Samba", 7),
        row(c("_cold"), "alert", "Cold-snap conditions", "Srinagar, Anantnag, Kishtwar", 8),
    ]
    return j.select("station", F.explode(F.array_compact(F.array(*rows))).alias("_a")).select("station", "_a.*")
