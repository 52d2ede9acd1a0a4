"""The quality classifier: its solver, its features, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from terraloom.llm import quality


def test_dual_descent_reaches_the_optimum():
    rnd = np.random.default_rng(5)
    rows = [np.sort(rnd.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.where(rnd.random(80) < 0.5, 1.0, -1.0)
    scale, cost = rnd.random(30) + 0.2, np.full(80, 0.7)
    w, b = quality.dual_descent(rows, y, scale, cost, rounds=3000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = scale[r], 1.0
    full = np.append(w, b)
    loss = lambda v: 0.5 * v @ v + float((cost * np.maximum(0, 1 - y * (x @ v))).sum())
    best = loss(full)
    assert all(best <= loss(full + d) + 1e-3 for d in rnd.normal(0, 0.05, (300, 31)))


def test_ngrams_are_indicators():
    once, twice = quality.ngrams(b"abc  12"), quality.ngrams(b"abc  12 abc\t77")
    assert set(once[once < quality.DIM]) <= set(twice[twice < quality.DIM])
    assert len(quality.ngrams(b"")) == 4  # the shape alone
    long_text = b"some words and more " * 120_000
    assert set(quality.ngrams(long_text)[:-4]) == set(quality.ngrams(b"some words and more " * 10)[:-4])


def test_held_out_accuracy_and_coverage(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(zlib.crc32(str(g.doc_id).encode()) % 5 == 0 for g, _ in held) and len(held) > 500
    assert np.mean([g.predicted == q for g, q in held]) > 0.96
    bad, good = [g.score for g, q in held if not q], [g.score for g, q in held if q]
    assert np.mean([b < g for b in bad for g in good]) > 0.99


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None), (1, 1, 0)]])
def test_odd_rows(spark, labels):
    rows = [(1, None, 0.5), (None, "a b", 0.5), (3, "", 0.5), (4, "x " * 200_000, 0.5), (1, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scores(docs, lab).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.scores(docs.limit(0), lab).collect() == []


def test_a_repeated_id_sends_one_row_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of a table") for i in range(40)] + [(k, f"copy {j} of an id") for j in range(50) for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, y, prior: seen.append((len(rows), len(y))))
    quality.fit(docs, labels)
    assert 0 < seen[0][0] == seen[0][1] <= 40


def test_very_long_texts_stay_out_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of a table") for i in range(40)] + [(100 + k, f"w{k} " * 200_000) for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(r, r % 2) for r in [*range(40), *range(100, 104)]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, y, prior: seen.append(len(rows)))
    quality.fit(docs, labels)
    most = seen[0]
    assert 0 < most <= 40
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100)
    quality.fit(docs, labels)
    assert 0 < seen[1] < most


def test_fitting_does_not_keep_the_values_of_all_rows():
    """The rows' places are a view of one buffer; values beside them would take twice as much again at the driver."""
    import tracemalloc

    rnd = np.random.default_rng(3)
    places = rnd.integers(0, quality.WIDTH, (400, 20_000)).astype(np.int32)
    scale = rnd.normal(size=quality.WIDTH) / 100
    tracemalloc.start()
    quality.dual_descent(list(places), rnd.choice([-1.0, 1.0], 400), scale, np.ones(400), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("PEAK", peak >> 20)
    assert peak < places.nbytes / 2
