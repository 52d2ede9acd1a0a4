"""Disaster triage of scenes: feature rows, rule detections, family dedupe, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.numeric import bands, clip, flag_pct
from terraloom.operators import scene as sc
from terraloom.operators import spectral as sp
from terraloom.operators.spectral import CODE

KEYS = ["scene_id"]
SEVERITY_ORDER = ["None", "Low", "Moderate", "High", "Severe"]  # fixed value


def severity(pct: Column) -> Column:
    return bands(pct, [(">=", 35.0, "Severe"), (">=", 15.0, "High"), (">=", 5.0, "Moderate")], "Low")


def family(kind: Column) -> Column:
    t = F.lower(kind)
    return (
        F.when(t.contains("fire") & ~t.contains("burn"), "fire")
        .when(t.contains("burn"), "burn")
        .when(t.contains("flood") | t.contains("water"), "flood")
        .when(t.contains("landslide") | t.contains("land loss"), "landslide")
        .when(t.contains("snow") | t.contains("avalanche"), "snow")
        .when(t.contains("drought") | t.contains("stress"), "drought")
        .otherwise(t)
    )


def scene_features(px: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per scene from pixels with the colour masks and ``cls``: a single aggregate
    gives class and mask shares; water is the larger of the two water estimates."""
    keys = keys or KEYS
    cls = {n: flag_pct(F.col("cls") == k, 2) for n, k in CODE.items()}
    agg = px.groupBy(*keys).agg(
        *[flag_pct(F.col(m), 1).alias(f"{m}_pct") for m in ("snow", "burn", "bare", "fire", "smoke", "water")],
        *[c.alias(n.lower()) for n, c in cls.items()],
    )
    return agg.select(
        *keys, "snow_pct", "burn_pct", "bare_pct", "fire_pct", "smoke_pct",
        F.col("water_pct").alias("water_rgb"),
        F.round(F.greatest("water", "water_pct"), 1).alias("water"),
        (F.col("forest") + F.col("agriculture")).alias("veg"),
        F.col("urban"), F.col("others"),
    )


def _row(kind: str, when: Column, conf: Column, area: Column, evidence: Column, order: int) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("type"), F.round(conf, 2).alias("confidence"), F.round(area, 1).alias("affected_area_pct"),
            evidence.alias("evidence"), F.lit(order).alias("ord"),
        ),
    )


def _say(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def single_rules(prefix: str = "") -> dict[str, Column]:
    """Conditions of the single-scene rules on a feature row."""
    f = lambda n: F.col(prefix + n)
    bare_like = F.greatest(f("bare_pct"), F.when(f("snow_pct") < 10, f("others")).otherwise(F.lit(0.0)))
    return {
        "fire": f("fire_pct") > 0.10,
        "flood": f("water") > 18,
        "snow": f("snow_pct") > 22,
        "drought": (f("veg") < 16) & (f("water") < 6) & (bare_like > 28),
        "burn": f("burn_pct") > 10,
    }


def with_baseline(after: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
    """Feature rows with the optional pre-event features (``pre_*``) and the differences."""
    names = ["water", "veg", "bare_pct", "burn_pct"]
    if before is None:
        out = after.withColumns({f"pre_{n}": F.lit(None).cast("double") for n in names})
    else:
        out = after.join(before.select(*keys, *[F.col(n).alias(f"pre_{n}") for n in names]), keys, "left")
    out = out.withColumns({f"d_{n}": F.col(n) - F.col(f"pre_{n}") for n in names})
    return out.withColumn("mode", F.when(F.col("pre_water").isNotNull(), "change").otherwise("single"))


def rule_flags(rows: DataFrame) -> DataFrame:
    """Boolean columns ``on_*`` of every rule, with the permanent-water suppression."""
    s = single_rules()
    permanent = F.coalesce(F.col("pre_water") > 12, F.lit(False))
    no = F.lit(False)
    return rows.withColumns(
        {
            "on_fire": s["fire"],
            "on_smoke": s["fire"] & (F.col("smoke_pct") > 3),
            "on_flood": s["flood"] & ~permanent,
            "on_snow": s["snow"],
            "on_drought": s["drought"],
            "on_burn": s["burn"],
            "on_rise": F.coalesce(F.col("d_water") > 6, no),
            "on_landslide": F.coalesce((F.col("d_veg") < -8) & (F.col("d_bare_pct") > 4), no),
            "on_postburn": F.coalesce((F.col("d_burn_pct") > 4) & (F.col("d_veg") < -4), no),
        }
    )


def detections(flagged: DataFrame, keys: list[str] | None = None, spectral: DataFrame | None = None) -> DataFrame:
    """Zero or more detection rows per scene from the flag table and, when given, the
    multispectral summary (confirmation rows)."""
    keys = keys or KEYS
    c = F.col
    bare_like = F.greatest(c("bare_pct"), F.when(c("snow_pct") < 10, c("others")).otherwise(F.lit(0.0)))
    arid = F.coalesce((c("pre_veg") < 16) & (c("pre_water") < 6), F.lit(False))
    plume = F.when(c("on_smoke"), _say(", smoke plume over %.1f%%", c("smoke_pct"))).otherwise("")
    rows = [
        _row("Active fire / wildfire", c("on_fire"), clip(0.60 + c("fire_pct") / 5, 0, 0.97), c("fire_pct"),
             F.concat(_say("flame colours on %.1f%% of the scene", c("fire_pct")), plume), 0),
        _row("Flood / standing water", c("on_flood"), clip(0.35 + c("water") / 90, 0, 0.9), c("water"),
             _say("open water on %.1f%% of the scene", c("water")), 1),
        _row("Snow / avalanche terrain", c("on_snow"), clip(0.4 + c("snow_pct") / 100, 0, 0.92), c("snow_pct"),
             _say("snow or ice on %.1f%% of the scene", c("snow_pct")), 2),
        _row("Drought / vegetation stress", c("on_drought"), clip(0.35 + (bare_like - 28) / 90, 0, 0.88), bare_like,
             F.concat(_say("vegetation %.1f%%, bare ground %.1f%%", c("veg"), bare_like), F.when(arid, "; baseline equally arid").otherwise("")), 3),
        _row("Wildfire / burn scar", c("on_burn"), clip(0.3 + c("burn_pct") / 60, 0, 0.85), c("burn_pct"),
             _say("char colours on %.1f%% of the scene", c("burn_pct")), 4),
        _row("Flood (post-event rise)", c("on_rise"), clip(0.5 + c("d_water") / 60, 0, 0.97), c("d_water"),
             _say("open water %+.1f%% against the baseline", c("d_water")), 5),
        _row("Landslide / land loss", c("on_landslide"), clip(0.4 + F.abs("d_veg") / 50, 0, 0.95), F.abs("d_veg"),
             _say("vegetation %+.1f%%, bare ground %+.1f%% against the baseline", c("d_veg"), c("d_bare_pct")), 6),
        _row("Wildfire burn scar (post-event)", c("on_postburn"), clip(0.42 + c("d_burn_pct") / 30, 0, 0.9), c("d_burn_pct"),
             _say("char colours %+.1f%% against the baseline", c("d_burn_pct")), 7),
    ]
    base = flagged
    if spectral is not None:
        names = ["active_fire_pct", "water_pct", "burn_pct"]
        base = base.join(spectral.select(*keys, *[F.round(n, 1).alias(f"ms_{n}") for n in names]), keys, "left")
        rows += [
            _row("Active fire (SWIR-confirmed)", c("ms_active_fire_pct") > 1, F.least(F.lit(0.98), 0.65 + c("ms_active_fire_pct") / 30), c("ms_active_fire_pct"),
                 _say("short-wave fire anomaly on %.1f%%", c("ms_active_fire_pct")), 8),
            _row("Flood (NDWI-confirmed)", c("ms_water_pct") > 15, F.least(F.lit(0.98), 0.6 + c("ms_water_pct") / 80), c("ms_water_pct"),
                 _say("water index on %.1f%%", c("ms_water_pct")), 9),
            _row("Wildfire (NBR-confirmed)", c("ms_burn_pct") > 8, F.least(F.lit(0.95), 0.5 + c("ms_burn_pct") / 50), c("ms_burn_pct"),
                 _say("burn index on %.1f%%", c("ms_burn_pct")), 10),
        ]
    found = base.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_d")).select(*keys, "_d.*")
    return found.withColumn("family", family(F.col("type")))


def strongest(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One detection per scene and family: the most confident, the earliest on a tie."""
    keys = keys or KEYS
    rest = [c for c in found.columns if c not in (*keys, "family")]
    pick = F.max(F.struct("confidence", (-F.col("ord")).alias("o"), F.struct(*rest).alias("r"))).alias("_p")
    return found.groupBy(*keys, "family").agg(pick).select(*keys, "family", "_p.r.*")


def impact_share(px: DataFrame, flagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of the impact mask (OR of the masks of the rules that fired) and of built-up
    pixels inside it, from pixels with masks and ``cls``."""
    keys = keys or KEYS
    flags = [c for c in flagged.columns if c.startswith("on_")]
    j = px.join(flagged.select(*keys, *flags), keys)
    water_cls, other_cls = F.col("cls") == CODE["Water"], F.col("cls") == CODE["Others"]
    impact = (
        (F.col("on_fire") & F.col("fire"))
        | (F.col("on_smoke") & F.col("smoke"))
        | (F.col("on_flood") & (water_cls | F.col("water")))
        | (F.col("on_snow") & F.col("snow"))
        | (F.col("on_drought") & (F.col("bare") | (other_cls & ~F.col("snow"))))
        | (F.col("on_burn") & F.col("burn"))
        | (F.col("on_rise") & water_cls)
        | (F.col("on_landslide") & F.col("bare"))
        | (F.col("on_postburn") & F.col("burn"))
    )
    urban = F.col("cls") == CODE["Urban"]
    return j.groupBy(*keys).agg(
        flag_pct(impact, 1).alias("impact_pct"), flag_pct(urban, 1).alias("builtup_pct"), flag_pct(urban & impact, 1).alias("builtup_in_impact_pct")
    )


def roll_up(best: DataFrame, scenes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Primary type, affected area, severity (an active fire never below High) and the
    alert text; scenes without detection get the all-clear row."""
    keys = keys or KEYS
    top = best.groupBy(*keys).agg(
        F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "type")).alias("_t"),
        F.round(F.max("affected_area_pct"), 1).alias("affected_area_pct"),
        F.bool_or(F.lower("type").contains("fire")).alias("_fire"),
        F.count(F.lit(1)).alias("n_detections"),
    )
    j = scenes.join(top, keys, "left")
    sev = severity(F.col("affected_area_pct"))
    sev = F.when(F.col("_fire") & sev.isin("Low", "Moderate"), "High").otherwise(sev)
    j = j.withColumns(
        {
            "primary": F.coalesce(F.col("_t.type"), F.lit("No disaster signature")),
            "confidence": F.col("_t.confidence"),
            "severity": F.coalesce(sev, F.lit("None")),
            "affected_area_pct": F.coalesce(F.col("affected_area_pct"), F.lit(0.0)),
            "n_detections": F.coalesce(F.col("n_detections"), F.lit(0)),
        }
    ).drop("_t", "_fire")
    text = F.when(
        F.col("n_detections") > 0,
        F.format_string(
            "DISASTER ALERT: %s (confidence %d%%), severity %s, about %.1f%% of the scene",
            "primary", F.floor(F.col("confidence") * 100), "severity", "affected_area_pct",
        ),
    ).otherwise("NO DISASTER SIGNATURE")
    return j.withColumn("alert", text)


def triage(
    px: DataFrame, before_px: DataFrame | None = None, keys: list[str] | None = None, spectral: DataFrame | None = None
) -> DataFrame:
    """From pixels (r, g, b, cls) to one triage row per scene."""
    keys = keys or KEYS
    masked = sp.with_disaster_masks(px)
    now = scene_features(masked, keys)
    pre = scene_features(sp.with_disaster_masks(before_px), keys) if before_px is not None else None
    flagged = rule_flags(with_baseline(now, pre, keys))
    best = strongest(detections(flagged, keys, spectral), keys)
    return roll_up(best, flagged.select(*keys, "mode"), keys).join(impact_share(masked, flagged, keys), keys)


def land_cover_of(px: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sc.class_percentages(px, keys or KEYS)
