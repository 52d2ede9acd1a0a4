import pytest
from pyspark.sql import functions as F

from terraloom.operators import triage as tr

FEATS = "scene_id int, snow_pct double, burn_pct double, bare_pct double, fire_pct double, smoke_pct double, water double, veg double, urban double, others double"


def feats(spark, *rows):
    names = [f.split()[0] for f in FEATS.split(", ")]
    full = [tuple({**dict.fromkeys(names, 0.0), "scene_id": k, **r}[n] for n in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, FEATS)


def run(spark, now, pre=None):
    flagged = tr.rule_flags(tr.with_baseline(now, pre, ["scene_id"]))
    best = tr.strongest(tr.detections(flagged))
    return best, {r.scene_id: r for r in tr.roll_up(best, flagged.select("scene_id", "mode")).collect()}


def test_single_scene_rules(spark):
    _, out = run(spark, feats(spark, {"fire_pct": 0.2, "veg": 50.0}, {"water": 60.0}, {"snow_pct": 30.0}, {"bare_pct": 40.0, "veg": 5.0}, {"veg": 80.0}))
    assert out[0].primary == "Active fire / wildfire" and out[0].severity == "High"  # floor for fire
    assert out[0].confidence == 0.64
    assert out[1].primary == "Flood / standing water" and out[1].severity == "Severe" and out[1].confidence == 0.9
    assert out[2].primary.startswith("Snow") and out[2].severity == "High"
    assert out[3].primary.startswith("Drought") and out[3].affected_area_pct == 40.0
    assert out[4].primary == "No disaster signature" and out[4].severity == "None" and out[4].alert == "NO DISASTER SIGNATURE"


def test_permanent_water_and_rise(spark):
    now = feats(spark, {"water": 40.0, "veg": 30.0}, {"water": 40.0, "veg": 30.0})
    pre = feats(spark, {"water": 38.0, "veg": 30.0}, {"water": 5.0, "veg": 30.0})
    best, out = run(spark, now, pre)
    assert out[0].primary == "No disaster signature" and out[0]["mode"] == "change"
    rows = best.filter("scene_id = 1").collect()
    assert len(rows) == 1 and rows[0].type == "Flood (post-event rise)"  # the stronger of the flood family


def test_landslide_and_burn(spark):
    now = feats(spark, {"veg": 20.0, "bare_pct": 25.0, "burn_pct": 9.0})
    pre = feats(spark, {"veg": 50.0, "bare_pct": 5.0, "burn_pct": 1.0})
    best, out = run(spark, now, pre)
    got = {r.family: r for r in best.collect()}
    assert got["landslide"].affected_area_pct == 30.0 and got["landslide"].confidence == 0.95
    assert got["burn"].type == "Wildfire burn scar (post-event)"
    assert out[0].primary == "Landslide / land loss"


def test_family_tie_keeps_the_first(spark):
    df = spark.createDataFrame([(0, "flood", "b", 0.5, 2), (0, "flood", "a", 0.5, 1), (0, "fire", "c", 0.4, 3)], "scene_id int, family string, type string, confidence double, ord int")
    got = {r.family: r.type for r in tr.strongest(df).collect()}
    assert got == {"flood": "a", "fire": "c"}


@pytest.mark.parametrize("name,want", [
    ("Active fire / wildfire", "fire"), ("Wildfire / burn scar", "burn"), ("Flood (NDWI-confirmed)", "flood"), ("Wildfire (NBR-confirmed)", "fire"),
    ("Landslide / land loss", "landslide"), ("Snow / avalanche terrain", "snow"), ("Drought / vegetation stress", "drought"), ("Odd", "odd"),
])
def test_families(spark, name, want):
    assert spark.range(1).select(tr.family(F.lit(name))).first()[0] == want


def test_triage_end_to_end_sums(spark):
    rows = [(0, y, x, 0.1, 0.2, 0.6, 1) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "scene_id int, y int, x int, r double, g double, b double, cls int")
    r = tr.triage(px).first()
    assert r.primary == "Flood / standing water" and r.severity == "Severe" and r.impact_pct == 100.0 and r.builtup_in_impact_pct == 0.0
