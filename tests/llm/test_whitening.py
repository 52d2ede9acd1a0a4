"""Whitening: exact covariance against fractions, whitened values against numpy, odd rows."""

import random
from fractions import Fraction

import numpy as np
import pytest

from terraloom.llm import whitening as wh
from terraloom.llm.queries import QUERIES


def ints(v):
    return [int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v]


def brute(table):
    """Everything in exact fractions, but for eigh."""
    fit = sorted(set(map(tuple, table)))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(c) for c in r] for r in cov])


@pytest.mark.parametrize("scale", [1, 10**4, 10**9])
def test_covariance_is_exact(spark, scale):
    rnd = random.Random(scale)
    table = [[rnd.randrange(-50, 50) * scale + rnd.randrange(7) for _ in range(5)] for _ in range(60)]
    n, s, want = brute(table)
    fit = spark.createDataFrame([(x,) for x in table], "x array<bigint>").distinct().repartition(3)
    assert wh.sums(fit) == (n, s)
    assert (wh.covariance(fit, n, s) == want).all()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, ints(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, s, v = brute([x for _, x in rows])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_embedding_whitening"](spark, sf).collect()}
    assert len(got) == 16 * len(rows)
    sign = None
    for i, x in rows:
        w = (np.array(x) - np.array(s) / n) @ q / np.sqrt(e)
        mine = np.array([got[i, k].whitened for k in range(1, 17)])
        sign = np.sign(w * mine) if sign is None else sign
        assert np.allclose(mine * sign, w, rtol=1e-7, atol=1e-9)
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert all(got[i, k].deviation == dev and got[i, k].n == n for k in range(1, 17))
        assert np.allclose([got[i, k].explained for k in range(1, 17)], e / np.trace(v), rtol=1e-9)
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def run(spark, rows, kind="array<double>"):
    return wh.whitened(spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n string, x int")).collect()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, 2.0]), (2, [0.25, -1.0, 2.5]), (3, [0.75, 3.0, 0.0]), (3, [0.75, 3.0, 0.0]), (None, [9.0, 3.0, 1.0])] + [(k, [1.0, 1.0, 1.0]) for k in range(10, 50)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 2.0]), (93, [inf, 1.0, 2.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 1.0, 1.0])]
    got = run(spark, [(i, v, "a", 1) for i, v in good + bad])
    n, s, v = brute([ints(x) for _, x in good])
    assert n == 5 and {r.n for r in got} == {5} and len(got) == 3 * len(good)
    assert sorted({r.vec_id or -1 for r in got}) == sorted({i or -1 for i, _ in good})
    assert all(r.identity_error < 1e-9 for r in got)
    assert {r.deviation for r in got if r.vec_id == 1} == {sum((n * a - b) ** 2 for a, b in zip(ints([0.5, 1.0, 2.0]), s))}


def test_nothing_to_whiten(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, "a", 1)]) == []
    assert run(spark, [(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1)]) == []
    flat = run(spark, [(k, [float(k), 5.0], "a", 1) for k in range(9)], "array<float>")  # one direction has no variance
    assert len(flat) == 9 and {r.component for r in flat} == {1} and abs(sum(r.whitened for r in flat)) < 1e-9


def test_deviation_beyond_a_long():
    u = np.array([[3, 4], [2**40, 1], [-(2**31), 5]])
    got = wh.deviations(u, 2, np.array([1, 0]))
    assert got == [25 + 64, None, (2 * 2**31 + 1) ** 2 + 100 if (2 * 2**31 + 1) ** 2 + 100 < 2**63 else None]
