"""Toxicity: the automaton against plain edit distance, contexts, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from terraloom.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def codes(words, automaton):
    out = np.full((len(words), automaton.longest + 1), -1, np.int32)
    for i, w in enumerate(words):
        for j, b in enumerate(w[: out.shape[1]]):
            out[i, j] = automaton.symbol[b]
    return out


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    words, stems = [b"idiot", b"disgusting", b"dumb", b"disgust"], [b"lowei", b"lostraga"]
    a = tx.Automaton(words, stems)
    tried = []
    for _ in range(4000):
        w = bytearray(rnd.choice(words + stems))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = bytes(rnd.choices(b"idotlxs", k=rnd.randrange(3)))
        tried.append(bytes(w + bytes(rnd.choices(b"xyz", k=rnd.choice([0, 0, 3]))))[: a.longest + 1])
    tried = [t for t in tried if t]
    for w, v in zip(tried, a.match(codes(tried, a))):
        d = {x: distance(w, x) for x in words}
        near = [e for x, e in d.items() if e <= tx.allowed(x)]
        stem = [min(distance(w[:n], s) for n in range(len(w) + 1)) for s in stems]
        stem_ok = [e for e, s in zip(stem, stems) if e <= (1 if len(s) >= 7 else 0)]
        want = 1 + (min(near) > 0) if near else 3 + (min(stem_ok) > 0) if stem_ok else 0
        assert v == want, (w, v, want)


def test_states_start_over(monkeypatch):
    monkeypatch.setattr(tx, "STATES_MAX", 3)
    a = tx.Automaton([b"worthless"], [])
    for w, v in [(b"worthless", 1), (b"wortless", 2), (b"worthy", 0), (b"vvorthless", 2)]:
        assert a.match(codes([w], a))[0] == v


def test_context_separates_quotation_from_abuse():
    m = tx.Model([b"idiot"], [], np.append(np.zeros(tx.FEATURES), -1.0))
    flags = lambda t: [q for *_, q in m.hits(t.encode())]
    assert flags("you are an idiot") == [False]
    assert flags("he said idiot once") == [True]
    assert flags("the word “idiot” is old") == [True]
    assert flags('an "odd" start and then many plain words before idiot') == [False]
    text = "Ünd you IDI0T, idiot's end"
    assert [text.encode()[a:b] for a, b, *_ in m.hits(text.encode())] == [b"IDI0T", b"idiot"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in tx.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(zlib.crc32(str(g.doc_id).encode()) % 3 == 1 for g, _ in held) and len(held) > 1000
    assert np.mean([g.predicted == t for g, t in held]) > 0.97
    assert np.mean([g.predicted for g, t in held if not t]) < 0.01


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)]])
def test_odd_rows(spark, labels):
    rows = [(1, None, 0.5), (None, "a b", 0.5), (3, "", 0.5), (4, "x " * 200_000, 0.5), (1, None, 0.5), (6, "y" * 300_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tx.scores(docs, lab).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert tx.scores(docs.limit(0), lab).collect() == []


def test_a_repeated_id_sends_one_row_to_the_driver(spark, monkeypatch):
    rows = [(i, f"plain words {i} of many others {i * 7}") for i in range(40)] + [(k, f"copy {j} of an id {j * 3} {k}") for j in range(60) for k in range(4)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tx, "logistic", lambda x, y, w, ridge=0.05: (seen.append(len(y)), np.zeros(tx.FEATURES + 1))[1])
    tx.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen and 0 < seen[0] <= 40
