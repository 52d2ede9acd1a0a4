"""Mixing: water-filling and the seeded choice."""

import random
from collections import defaultdict

import pytest

from terraloom.llm import mixing


def filled(sizes, weights, epochs=3):
    """Clamp and share out again, in plain Python. sizes in source order."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        left -= sum(epochs * sizes[i] for i in over)
        free -= over
    return target


def run(spark, rows, **k):
    return mixing.mix(spark.createDataFrame([(i, t, s, 1.0) for i, t, s in rows], "doc_id long, text string, source string, target double"), **k).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_choice(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "tiny", "zz"]
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40, 300]), s) for i in range(1500) for s in [rnd.choices(names, [400, 60, 20, 30, 10, 1, 100])[0]]] + [(9000, None, "a"), (None, "x y", "b")]
    got = run(spark, rows, seed=seed)
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == o) for o in order]
    want = dict(zip(order, filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[order.index(r.source)]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in order)
    partly = [r for r in got if r.size and r.taken % r.size]
    assert len(partly) <= len(order)
    key = lambda rs: sorted((r.doc_id or -1, r.taken) for r in rs)
    assert key(run(spark, list(reversed(rows)), seed=seed)) == key(got)
    assert key(run(spark, rows, seed=seed + 5)) != key(got)


def test_odd_tables(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    got = run(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d", "s")])  # repeated rows, one source: everything once
    assert sorted((r.doc_id, r.taken) for r in got) == [(1, 3), (1, 3), (2, 1)]
