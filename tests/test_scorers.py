"""The store of scorers: only a better version, judged on held-out rows, goes into service."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terraloom.operators import scorers as so

FEATURES = ["f0", "f1", "f2"]
GOOD = [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]
FAIR = [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, -9.0]]  # never says 2
POOR = [[0.0, 9.0, 0.0], [0.0, 0.0, 9.0], [9.0, 0.0, 0.0]]


@pytest.fixture
def rows(spark):
    """Thirty rows whose class is the place of the one feature that is set."""
    cls = F.pmod("id", F.lit(3)).cast("int")
    return spark.range(30).select(cls.alias("label"), *[(cls == k).cast("double").alias(f) for k, f in enumerate(FEATURES)])


def put(spark, path, version, weights, rows):
    so.save(spark, path, "t", version, FEATURES, weights, [0.0, 0.0, 0.0])
    return {r.role: r for r in so.challenge(spark, path, "t", version, rows, "label").collect()}


def current(spark, path):
    r = so.in_service(spark, path).collect()
    assert len(r) <= 1
    return r[0] if r else None


def test_worse_equal_and_better_challengers(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    assert current(spark, path) is None
    first = put(spark, path, "v1", FAIR, rows)
    assert set(first) == {"challenger"} and first["challenger"].promote and first["challenger"].n == 30
    assert first["challenger"].accuracy == pytest.approx(2 / 3)
    worse = put(spark, path, "v2", POOR, rows)
    assert not worse["challenger"].promote and worse["challenger"].accuracy == 0.0
    assert worse["champion"].version == "v1" and worse["champion"].accuracy == pytest.approx(2 / 3)
    assert current(spark, path).version == "v1"
    equal = put(spark, path, "v3", FAIR, rows)
    assert not equal["challenger"].promote and current(spark, path).version == "v1"
    better = put(spark, path, "v4", GOOD, rows)
    assert better["challenger"].promote and better["challenger"].accuracy == 1.0
    now = current(spark, path)
    assert (now.version, now.no, now.replaced, now.accuracy) == ("v4", 2, "v1", 1.0)


def test_run_again_changes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, "v1", GOOD, rows)
    again = put(spark, path, "v1", POOR, rows)  # a stored version is never changed
    assert again["challenger"].accuracy == 1.0 and not again["challenger"].promote
    assert current(spark, path).no == 1


def test_nothing_held_out(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    so.save(spark, path, "t", "v1", FEATURES, GOOD, [0.0, 0.0, 0.0])
    assert so.challenge(spark, path, "t", "v1", rows.filter("false"), "label").count() == 0
    assert current(spark, path) is None


def test_unknown_version_fails_and_leaves_the_former(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, "v1", FAIR, rows)
    with pytest.raises(ValueError):
        so.challenge(spark, path, "t", "v9", rows, "label")
    assert current(spark, path).version == "v1"
