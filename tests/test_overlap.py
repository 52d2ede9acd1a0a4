"""Best overlapping ranges against brute force, and how the work grows with the ranges that overlap."""

from __future__ import annotations

import datetime as dt
import random

from terraloom.operators import fusion as fu

SCHEMA = "region string, id bigint, start_ymd string, end_ymd string, days int"
DAY = dt.date(2023, 12, 1)


def ymd(n):
    return (DAY + dt.timedelta(days=n)).strftime("%Y%m%d")


def entries(rng, n, span, regions=("a", "b")):
    out = []
    for k in range(n):
        s = rng.randrange(span)
        e = s + rng.choice([0, 1, 2, 5, 30, span])
        out.append((rng.choice(regions), k, ymd(s), ymd(e), rng.randrange(1, 6)))
    return out


def brute(left, right):
    """Per left entry the most shared days, fewest days, newest end, greatest id; one id for each range and its fewest days."""
    least = {}
    for reg, no, s, e, d in right:
        if s <= e:
            least[reg, s, e] = min(least.get((reg, s, e), (d, no)), (d, no))
    days = lambda x, y: (dt.datetime.strptime(y, "%Y%m%d") - dt.datetime.strptime(x, "%Y%m%d")).days
    out = set()
    for reg, no, s, e, _ in left:
        some = [
            (days(max(s, rs), min(e, re)), -d, re, rid)
            for (rreg, rs, re), (d, rid) in least.items() if rreg == reg and rs <= e and re >= s and s <= e
        ]
        if some:
            best = max(some)
            out.add((reg, no, best[3], best[0]))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    for n, span in ((60, 40), (80, 400), (30, 3)):
        left, right = entries(rng, n, span), entries(rng, n, span)
        left += [left[0], ("a", 900, ymd(9), ymd(3), 1), ("c", 901, ymd(1), ymd(2), 1), ("a", 902, None, ymd(3), 1)]
        right += [("a", 903, ymd(20), ymd(2), 1), ("a", 904, ymd(1), None, 1), right[0]]
        got = fu.overlapping_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["region"])
        whole = [r for r in left if r[2]], [r for r in right if r[3]]
        assert {tuple(r) for r in got.collect()} == brute(*whole)


def test_years_far_apart(spark):
    left = [("a", 1, "00010101", "99991231", 1), ("a", 2, "19691231", "19700101", 1)]
    right = [("a", 7, "00010101", "00010102", 1), ("a", 8, "19700101", "99991231", 1)]
    got = fu.overlapping_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["region"])
    assert {tuple(r) for r in got.collect()} == brute(left, right)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, "20240101", "20240102", 1)], SCHEMA)
    assert fu.overlapping_pairs(none, one, ["region"]).count() == 0
    assert fu.overlapping_pairs(one, none, ["region"]).count() == 0


def test_rows_grow_with_the_ranges_and_not_with_their_pairs(spark):
    """Ranges that all overlap: the blocks, and so the rows that are sorted, are some twenty for each range."""
    from pyspark.sql import functions as F

    n = 400
    rows = spark.range(n).select(F.size(fu._upto(F.col("id"))).alias("u"), F.size(fu._holding(F.col("id"))).alias("h"))
    most = rows.agg(F.max("u"), F.max("h")).first()
    assert max(most) <= fu.DAY_BITS
    every = [("a", k, ymd(k), ymd(2 * n + k), 1) for k in range(n)]
    got = fu.overlapping_pairs(spark.createDataFrame(every, SCHEMA), spark.createDataFrame(every, SCHEMA), ["region"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in got.collect()} == {("a", k, k, 2 * n) for k in range(n)}
