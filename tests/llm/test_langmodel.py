"""The language model: probabilities add up to one, base scores and scores against brute force, held-out gain, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from terraloom.llm import langmodel as lm
from terraloom.llm.queries import QUERIES


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def counted(rows):
    c, ends = Counter(), 0
    for i, t in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            ends += 1
    return c, ends


def plain(rows, v, flat):
    """Every column from its definition, one token after another."""
    c, ends = counted(rows)
    n, size = sum(c.values()) + ends, len(c) + (ends > 0)
    m = lm.Model(flat, v.units)
    rank = {w: i for i, w in enumerate(v.common)}
    unit = lambda w: v.unit(rank.get(w, v.units), w)
    z = Counter()
    for w, k in c.items():
        if unit(w) >= v.own:
            z[unit(w)] += k + 1
    result = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        units = [unit(w) for w in words] + [lm.END]
        base = sum(math.log10((c[w] + 1) / (n + size + 1)) for w in words) + math.log10((ends + 1) / (n + size + 1))
        score = 0.0
        for k, u in enumerate(units):
            h = sum(m.r[units[k - d] if k >= d else v.units] * m.c[d - 1] for d in range(1, lm.CONTEXT + 1))
            s = m.q @ h + m.b
            score += (s[u] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if u >= v.own:
                score += math.log10((c[words[k]] + 1) / (z[u] + 1))
        result.append((i, out(i), len(units), sum(c[w] > 0 for w in words) + (ends > 0), n, base, score))
    return sorted(result, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


def compare(spark, monkeypatch, rows, **sizes):
    seen = {}
    train, voc = lm.train, lm.vocabulary
    monkeypatch.setattr(lm, "train", lambda d, v: seen.setdefault("flat", train(d, v)))
    monkeypatch.setattr(lm, "vocabulary", lambda t, e: seen.setdefault("v", voc(t, e, **sizes)))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, word string")
    got = sorted(map(tuple, lm.scores(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    want = plain(rows, seen["v"], seen["flat"])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4)
    return got


def test_whole_table_against_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compare(spark, monkeypatch, rows, common=300, units=lm.CLASSES + 40)  # most words are looked up by the join


def test_probabilities_of_all_words_add_up_to_one(spark):
    docs = [(i, f"a b c{i % 9} d{i} é. é, x") for i in range(60)]
    table = lm.counts(spark.createDataFrame(docs, "doc_id long, text string"))
    v = lm.vocabulary(table, 60, common=20, units=lm.CLASSES + 6)
    c, rank = {bytes(r.word): r.c for r in table.collect()}, {w: i for i, w in enumerate(v.common)}
    units = [lm.END, *(v.unit(rank.get(w, v.units), w) for w in c), *range(v.own, v.units)]  # and one unseen word for each class
    within = np.array([v.ends, *c.values(), *[0] * lm.CLASSES]) + 1.0
    flat = lm.Model.first(v, seed=5)
    m = lm.Model(flat, v.units)
    for before in ([v.units] * 4, [1, 2, v.units, v.units], [5, 5, 3, 8]):
        lp = m.log10(np.array([before] * len(units), np.int32), np.array(units))
        share = np.where(np.array(units) >= v.own, within, 1.0)
        assert abs((10**lp * share / 10 ** v.log_z[units]).sum() - 1) < 1e-5


def test_training_finds_the_order_of_words():
    rnd = np.random.default_rng(2)
    v = lm.Vocabulary([], np.zeros(0, np.int64), 10, 1000, 100, lm.CLASSES + 10, np.full(lm.CLASSES + 10, 100), np.zeros(lm.CLASSES + 10))
    texts = [(np.arange(50) * 3 + rnd.integers(v.units)) % v.units for _ in range(2000)]
    t = lm.Trainer(lm.Model.first(v), v, seed=1)
    for _ in range(3):
        t.learn(texts)
    u = np.concatenate(texts[:20])
    before = lm.contexts(u, np.arange(20) * 50, v.units)
    assert t.m.log10(before, u)[4:].mean() > 0.4 * math.log10(1 / v.units) > lm.Model(lm.Model.first(v), v.units).log10(before, u).mean()


def test_contexts_stay_in_their_text():
    got = lm.contexts(np.array([1, 2, 3, 7, 8]), np.array([0, 3]), 99)
    assert got[:, :2].tolist() == [[99, 99], [1, 99], [2, 1], [99, 99], [7, 99]] and got[2].tolist() == [2, 1, 99, 99]


def test_held_out_texts_score_better_than_the_base(spark):
    got = QUERIES["op11_lm_scores"](spark, "/root/testdata/sf0.1").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 10_000 and len(held) > 1000 and all(out(r.doc_id) for r in held)
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


@pytest.mark.parametrize("rows", [
    [(1, None), (None, "a b a"), (3, ""), (1, "A b\x0bB"), (1, "A b\x0bB"), (4, "x " * 150_000), (8, "y" * 300_000), (8, " ".join(f"w{k}" for k in range(3000)))],
    [(6, "only held out"), (6, None)],
])
def test_odd_rows(spark, monkeypatch, rows):
    if rows[0][0] == 6:
        held = next(i for i in range(100) if out(i))
        rows = [(held, t) for _, t in rows]
    got = compare(spark, monkeypatch, rows, common=50, units=lm.CLASSES + 5)
    assert len(got) == len(rows)
    assert all(r[5] == 0 for r in got) if rows[0][0] != 1 else True


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
