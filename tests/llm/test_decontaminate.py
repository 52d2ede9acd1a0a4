"""Benchmark decontamination: one automaton, automata over parts of large benchmarks, and spans."""

import random

import pytest

from terraloom.llm import decontaminate as dc


def plain(text, items):
    """Brute force over word positions."""
    words = dc.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        if item is None:
            continue
        w = dc.words_of((t or "").encode())
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), len(found), dc.digest(found), bool(hit)


def made():
    rnd = random.Random(11)
    pool = ["a", "b", "C", "é", "x1", "Straße", "the", "of"]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(50, "only"), (51, None), (None, "a b c"), (0, "a b c d e f g h i j k"), (0, "a b c d e f g h i j k")]
    docs = [(k, "; ".join(rnd.choices(pool, k=rnd.randrange(60))) + rnd.choice(["", " ONLY!", " A b\nC d-e f g h i j k l"]) + (" " + rnd.choice(items)[1] if k % 3 == 0 and rnd.choice(items)[1] else "") ) if k % 7 else (k, None) for k in range(80)]
    return items, docs + [docs[3], (None, "a b c d e f g h i j"), (900, "")]


def check(spark, monkeypatch, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    want = sorted(((i or -1, *plain(t, items)) for i, t in docs))
    for most in (dc.MAX_WINDOWS, -1):
        monkeypatch.setattr(dc, "MAX_WINDOWS", most)
        got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.contamination(df, bench).collect())
        assert got == want


def test_both_ways_against_brute_force(spark, monkeypatch):
    items, docs = made()
    docs = [(i, t if t is None else str(t)) for i, t in docs]
    check(spark, monkeypatch, items, docs)


@pytest.mark.parametrize("most", [dc.MAX_WINDOWS, -1])
def test_clean_goes_row_by_row(spark, monkeypatch, most):
    """Repeated and missing ids: a hit row takes no other row with it, at either size of the benchmark."""
    monkeypatch.setattr(dc, "MAX_WINDOWS", most)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "lone words")], "item_id long, text string")
    rows = [(7, "a b", 1), (7, "x lone words y", 2), (None, "c", 3), (None, "LONE words", 4), (None, None, 5), (8, "", 6)]
    got = dc.clean(spark.createDataFrame(rows, "doc_id long, text string, row_number int"), bench)
    assert got.columns == ["doc_id", "text", "row_number"] and sorted(r.row_number for r in got.collect()) == [1, 3, 5, 6]


def test_empty_tables(spark, monkeypatch):
    check(spark, monkeypatch, [], [(1, "a b")])
    check(spark, monkeypatch, [(1, "a b")], [])


def test_spans_point_into_the_original():
    m = dc.Matcher([(1, b"one two three four five six seven eight nine ten eleven"), (2, "größe x".encode())])
    text = "Zero -- ONE, two... three four five six seven eight nine\tTEN eleven end; Größe (X)!"
    assert [text[a:b] for a, b in dc.hit_spans(text, m)] == ["ONE, two... three four five six seven eight nine\tTEN eleven", "Größe (X"]
    assert dc.hit_spans("größe x größe X", m) == [(0, 15)]
    assert dc.hit_spans("nothing", m) == []


def test_long_text():
    m = dc.Matcher([(1, b"needle in a haystack")])
    at, items = m.hits(dc.words_of(b"hay " * 500_000 + b"Needle in a haystack"))
    assert at == [500_000 + i for i in range(4)] and items == {1}
