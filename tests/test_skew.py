"""One key with a third of the rows: results stay whole and no task gathers the group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import documents as dc
from terraloom.operators import fusion as fu
from terraloom.operators.ranking import exact_quantiles, group_rank, sliced


@pytest.fixture(scope="module")
def hot(spark):
    d = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("owner"),
        F.col("id"), F.floor(F.col("id") / 10000).alias("created_at"),  # long runs of equal times
        (F.hash("id") % 1000 / 7.0).alias("v"),
    )
    return d.persist()


def test_slices_of_a_hot_group_are_balanced(spark, hot):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in sliced(hot, ["owner", "created_at", "id"]).groupBy("_slice").count().collect()]
    assert len(sizes) == n and max(sizes) < 2 * 30000 / n


def test_rank_and_halves_of_a_hot_group(spark, hot):
    r = group_rank(hot, ["owner"], "created_at", "id").filter("owner = 'hot'").orderBy("id").collect()
    assert [x["rank"] for x in r] == list(range(1, 10001)) and r[0].total == 10000
    docs = hot.withColumn("land_cover", F.create_map(F.lit("Forest"), F.when(F.col("id") < 15000, 1.0).otherwise(3.0)))
    d = {x.owner: x.Forest for x in dc.land_cover_delta(docs, ["owner"], "created_at", "id").collect()}
    assert d["hot"] == 2.0 and len(d) == 98


def test_quantiles_of_a_hot_group(spark, hot):
    got = {x.owner: x.q for x in exact_quantiles(hot, ["owner"], "v", {"q": 0.98}).collect()}
    pdf = hot.select("owner", "v").toPandas()
    for k in ("hot", "k1", "k50"):
        assert got[k] == pytest.approx(np.percentile(pdf.v[pdf.owner == k], 98))


def test_dense_observations_in_one_spot(spark):
    cells = [("g", float(i), float(j), 20.0) for i in range(5) for j in range(5)]
    field = spark.createDataFrame(cells, "source string, lat double, lon double, value double")
    obs = spark.range(5000).select(
        F.lit("g").alias("source"), F.when(F.col("id") % 3 == 0, 2.1).otherwise(F.col("id") % 40 / 10.0).alias("lat"),
        F.lit(2.0).alias("lon"), (20 + F.col("id") % 5).cast("double").alias("obs"),
    )
    got = {(r.lat, r.lon): r.fused for r in fu.cressman(field, obs, ["source"], 1.0, 0.6).collect()}
    o = obs.toPandas()
    for i in range(5):
        d2 = (i - o.lat) ** 2
        w = np.where(d2 < 1, (1 - d2) / (1 + d2), 0.0)
        assert got[(i, 2.0)] == pytest.approx(20 + 0.6 * (w * (o.obs - 20)).sum() / max(1, w.sum()))


def test_many_entries_of_one_range(spark):
    mk = lambda tag, n: spark.range(n).select(
        F.concat(F.lit(tag), F.col("id")).alias("id"), F.lit("20240101").alias("start_ymd"), F.lit("20240130").alias("end_ymd"),
        F.lit(30).cast("bigint").alias("days"), F.when(F.col("id") >= 0, "r").alias("region"),
    )
    o = fu.overlapping_pairs(mk("l", 3000), mk("r", 3000), ["region"])
    assert o.count() == 3000 and o.select("right_id").distinct().first()[0] == "r0"
