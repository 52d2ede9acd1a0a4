"""Registered queries: contract, parity with the SQL twins, and the shape of plans."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows

SF = "/root/testdata/sf0.001"
QUICK = [
    "spi3_drought", "doy_climatology", "heat_spells", "season_curve", "extreme_summary", "records", "current_state",
    "grid_mean_field", "field_stats", "bilinear_regrid", "catalog_pick", "interval_overlap", "spectral_indices", "rgb_masks",
    "change_transitions", "median5", "prob_projection", "doc_dashboard", "doc_land_cover_delta", "news_dedupe", "point_feed",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q) and len(o) > 90
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in q)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_parity(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    spark.catalog.clearCache()


NO_PAIRS = [
    "spi3_drought", "daily_anomaly", "current_state", "live_tail_splice", "grid_anomaly", "marker_sample", "bilinear_regrid", "grid_persistence",
    "grid_persistence_skill", "phi_decay", "blue_fusion", "cressman_field", "persistence_backtest", "scenario_sweep", "district_layer",
    "triage", "change_transitions", "interval_overlap", "doc_land_cover_delta", "news_dedupe", "probe_accuracy",
]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cross_joins(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    spark.catalog.clearCache()


def test_scans_are_pruned(spark):
    plan = entry.queries()["monthly_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_linestatus", "l_quantity", "l_returnflag", "l_shipdate"]
    stored = entry.queries()["stored_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in stored
