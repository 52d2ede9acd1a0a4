"""Near-duplicate passages: windows and verification against brute force, whole table, odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from terraloom.llm import passages as ps


@pytest.mark.parametrize("distinct", [1, 4, 1000])
def test_each_run_lies_in_one_window(distinct):
    rnd = np.random.default_rng(distinct)
    h = ps.rehash(rnd.integers(0, distinct, 90).astype(np.uint64), 2)
    windows = list(zip(*ps.compact_windows(h, 10)))
    for i in range(90):
        for j in range(i + 9, 90):
            own = [key for key, l, lo, hi, r in windows if l <= i <= lo and hi <= j <= r]
            assert own and set(own) == {h[i : j + 1].min()}
            if len(set(h.tolist())) == 90:
                assert len(own) == 1
    assert len(ps.compact_windows(np.full(200_000, 7, np.uint64))[0]) == 1  # one shingle over and over


def test_regions_hold_the_min_hashes_of_every_passage():
    rnd = np.random.default_rng(5)
    texts = [rnd.integers(1, 2**63, n).astype(np.uint64) for n in (46, 70, 120, 46)]
    texts[2][30:80] = texts[1][10:60]
    for level in (0, 1, 2):
        key, text, first, last = ps.regions(texts, level)
        assert (first >= 0).all() and (last < np.array([len(t) for t in texts])[text]).all()
        rows = set(zip(key.tolist(), text.tolist()))
        for t, h in enumerate(texts):
            for i in range(len(h) - ps.LEAST + 1):
                for band in range(ps.BANDS):
                    low = [ps.rehash(h[i : i + ps.LEAST], f) | np.uint64(1) for f in ps.functions(band, level)]
                    k = (low[0].min(keepdims=True) + np.uint64(band))[0]
                    for x in low[1:]:
                        k = (ps.rehash(np.array([k]), 0) + x.min())[0]
                    assert (int(k), t) in rows
        assert {k for k, t in rows if t == 1} & {k for k, t in rows if t == 2}  # the passage both have
        if level:  # below all keys of the level before lie all keys; below those of one text only its own
            above = ps.regions(texts, level - 1)
            again = ps.regions(texts, level, [above[0][above[1] == t].view(np.int64) for t in range(4)])
            assert set(zip(again[0].tolist(), again[1].tolist())) == rows
            one = ps.regions(texts, level, [above[0][above[1] == t].view(np.int64)[: 100 * (t == 2)] for t in range(4)])
            assert set(one[1].tolist()) == {2}


def test_common_passages_are_similar():
    rnd = random.Random(3)
    for _ in range(60):
        a = [rnd.randrange(10**6) for _ in range(200)]
        k = rnd.randrange(0, 140)
        part = [x if rnd.random() > rnd.choice([0, 0.03, 0.2]) else rnd.randrange(10**6) for x in a[k : k + 60]]
        b = [rnd.randrange(10**6) for _ in range(rnd.randrange(90))] + part + [rnd.randrange(10**6) for _ in range(50)]
        got = ps.common_passages(np.array(a), np.array(b))
        for p, q, s, e, alike in got:
            x, y = set(a[p:q]), set(b[s:e])
            assert alike == len(x & y) / len(x | y) >= 0.8
        x, y = set(a[k : k + 60]), set(part)
        if part == a[k : k + 60]:
            assert len(got) == 1 and got[0][:2] == (k, k + 60)


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table_connects_what_shares_fifty_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    owners = defaultdict(set)
    for i, t in text.items():
        w = t.encode().lower().split()
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    exact = components(text, [(min(s), x) for s in owners.values() for x in s])
    got = ps.near_duplicate_passages(docs).collect()
    mine = components(text, [(r.doc_id, r.other_doc_id) for r in got])
    together = defaultdict(set)
    for i in text:
        together[exact[i]].add(mine[i])
    assert all(len(v) == 1 for v in together.values()) and len(set(exact.values())) < len(text)
    for r in got:
        a, b = (ps.shingles(" ".join(text[d].split()[s:e]).encode()) for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_doc_id, r.other_start, r.other_end)))
        x, y = set(a.tolist()), set(b.tolist())
        assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8 and r.doc_id != r.other_doc_id


def test_odd_rows_and_a_hot_passage(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    hot = [word() for _ in range(55)]
    rows = [(i, " ".join([word() for _ in range(rnd.randrange(40))] + hot + [word() for _ in range(rnd.randrange(40))]), 1) for i in range(400)]
    rows += [(i, " ".join(word() for _ in range(80)), 1) for i in range(400, 500)]
    rows += [(900, None, 1), (901, "", 1), (902, "a b", 1), (None, rows[0][1], 1), (903, "x " * 100_000, 1), (0, rows[0][1], 1)]
    got = ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    mine = components(range(1000), [(r.doc_id, r.other_doc_id) for r in got])
    assert all(mine[i] == 0 for i in range(400)) and all(mine[i] == i for i in range(400, 1000))
    assert len(got) < 2000
    assert ps.near_duplicate_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edited(words, at, kind, word):
    return {"change": [*words[:at], word, *words[at + 1 :]], "insert": [*words[:at], word, *words[at:]], "delete": words[:at] + words[at + 1 :]}[kind]


@pytest.mark.parametrize("around", [0, 30])
def test_edits_at_any_place_are_found(spark, around):
    """One edit of every kind at every place, and two edits, in passages alone and inside unrelated text."""
    rnd = random.Random(12 + around)
    word = lambda: f"w{rnd.randrange(10**6)}"
    some = lambda k: [word() for _ in range(k)]
    rows, want = [], set()
    for n in (50, 52, 55, 60, 80):
        for kind in ("change", "insert", "delete"):
            for at in range(n):
                for second in (None, rnd.randrange(n - 1)):
                    own = some(n)
                    other = edited(own, at, kind, word())
                    if second is not None:
                        other = edited(other, second, kind, word())
                    a, b = (set(ps.shingles(" ".join(t).encode()).tolist()) for t in (own, other))
                    i = len(rows)
                    rows += [(i + k, " ".join([*some(around), *t, *some(around)])) for k, t in enumerate((own, other))]
                    if len(a & b) / len(a | b) >= 0.8 and len(b) >= ps.LEAST:
                        want.add((i, i + 1))
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in got)
    assert len(want & got) >= 0.95 * len(want) and len(want) > 800


def test_pairs_behind_a_common_line_are_found(spark):
    rnd = random.Random(14)
    word = lambda: f"w{rnd.randrange(10**6)}"
    some = lambda k: [word() for _ in range(k)]
    line = some(38)  # too short for a passage, the words on either side make it one
    rows = [(i, " ".join([*some(30), *line, *some(30)])) for i in range(300)]
    for i in range(300, 380, 2):
        passage = [*some(8), *line, *some(8)]
        rows += [(k, " ".join([*some(30), *passage, *some(30)])) for k in (i, i + 1)]
    got = ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_doc_id))) for r in got} == {(i, i + 1) for i in range(300, 380, 2)}


def test_equal_texts_are_linked_to_the_smallest_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(9, text), (4, text), (7, text), (7, "x y"), (8, "x y"), (None, text)]
    got = ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(7, 0, 60, 4, 0, 60, 1.0), (9, 0, 60, 4, 0, 60, 1.0)]


def test_words_are_hashed_alike_exactly_if_they_are_equal():
    """Against splitting: every word of texts with all kinds of white space, capitals and other alphabets, of one piece or many."""
    rng = random.Random(11)
    letters = "abcABC\u00e9\u00c9\u4e2d\u00a0\u2003\x00\x1c\x7f"
    made = ["", " ", "a", " a", "a ", "x" * 700_000, "A b " * 200_000, "ab ba aab aba baa a b aa bb"]
    for n in (5, 300, 150_000):
        words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(n)]
        made.append("".join(w + rng.choice([" ", "\t", "\n", "\x0b\x0c", "\r\n  "]) for w in words))
    seen = {}
    for text in made:
        raw = text.encode()
        words, hashes = raw.lower().split(), ps.word_hashes(raw).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_link_beside_a_better_one_is_found(spark):
    """Of three passages the first and the second, and the second and the third are near-duplicates, the first and the third not."""
    rnd = random.Random(22)
    word = lambda: f"w{rnd.randrange(10**6)}"
    some = lambda k: [word() for _ in range(k)]
    rows, want = [], set()
    for i in range(0, 900, 3):
        middle = some(60)
        three = [edited(middle, rnd.randrange(12, 25), "change", word()), middle, edited(middle, rnd.randrange(35, 48), "change", word())]
        sets = [set(ps.shingles(" ".join(t).encode()).tolist()) for t in three]
        alike = lambda x, y: len(x & y) / len(x | y)
        assert alike(*sets[:2]) >= 0.8 and alike(*sets[1:]) >= 0.8 and alike(sets[0], sets[2]) < 0.8
        # the middle one has the largest id: what the first is compared with comes first
        rows += [(i + k, " ".join([*some(20), *three[j], *some(20)])) for k, j in enumerate((0, 2, 1))]
        want |= {(i, i + 2), (i + 1, i + 2)}
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.97 * len(want)


def exchanged(df):
    """Rows of a query and the bytes that its exchanges wrote."""
    rows, size, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            size += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows, size


@pytest.mark.parametrize("bounds", [{"PAIRS": 0}, {"PAIRS": 0, "ROOM": 3000}, {"PAIRS": 0, "HUB": 20}, {}])
def test_a_text_is_exchanged_once_for_many_pairs(spark, monkeypatch, bounds):
    """All pairs of 30 texts, one of them beside 40 others, a repeated id and a long text, in one block, in many, or each by itself."""
    for name, value in bounds.items():
        monkeypatch.setattr(ps, name, value, raising=False)
    rnd = np.random.default_rng(30)
    some = lambda n: rnd.integers(1, 2**62, n)
    own = some(150)
    seqs = []
    for i in range(70):
        passage = own.copy()
        passage[rnd.integers(145) :][:5] = some(5)
        seqs.append((i, np.concatenate((some(rnd.integers(200)), passage, some(6000 if i == 7 else 200)))))
    seqs.append((3, np.concatenate((own, some(100)))))
    ends = {i: (len(s) if i != 7 else 350) for i, s in seqs[:70]}
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)] + [(5, j) for j in range(30, 70)]
    want = set()
    cut = lambda s, r: s[: r + ps.REACH + 2 * (r - 10)]
    for i, j in pairs:
        for x in (s for k, s in seqs if k == i):
            for y in (s for k, s in seqs if k == j):
                for p, q, s, e, alike in ps.common_passages(cut(x, ends[i]), cut(y, ends[j])):
                    want.add((j, s, e + ps.SHINGLE - 1, i, p, q + ps.SHINGLE - 1, alike))
    found = spark.createDataFrame([(i, j, 10, ends[i], 10, ends[j]) for i, j in pairs], "a long, b long, al int, ar int, bl int, br int")
    table = spark.createDataFrame([(i, s.tolist()) for i, s in seqs], "doc long, seq array<long>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, size = exchanged(ps._compared(found, table))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 475
    if bounds == {"PAIRS": 0}:
        assert size < 4 * sum(8 * len(s) for _, s in seqs)


def test_a_common_line_takes_few_levels(spark, monkeypatch):
    """The open classes are compared pair by pair as soon as these are not too many pairs."""
    made, written = [], ps._written
    monkeypatch.setattr(ps, "_written", lambda df, label: made.append(label) or written(df, label))
    rnd = random.Random(31)
    some = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    line = some(38)
    rows = [(i, " ".join([*some(30), *line, *some(30)])) for i in range(160)]
    for i in range(160, 200, 2):
        passage = [*some(8), *line, *some(8)]
        rows += [(k, " ".join([*some(30), *passage, *some(30)])) for k in (i, i + 1)]
    got = ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_doc_id))) for r in got} == {(i, i + 1) for i in range(160, 200, 2)}
    assert made.count("members") <= 3 and len(made) <= 24


def test_a_link_to_a_covered_passage_is_found_in_a_key_of_many(spark, monkeypatch):
    """Of four passages each and the next are near-duplicates, no others. All keys of more than two classes go by heads: the first
    one's link to the second covers that, which is still to be linked to the third, and the third to the fourth."""
    monkeypatch.setattr(ps, "FEW", 2)
    monkeypatch.setattr(ps, "MOST", 2)
    rnd = random.Random(41)
    word = lambda: f"w{rnd.randrange(10**6)}"
    some = lambda k: [word() for _ in range(k)]
    rows, want = [], set()
    for i in range(0, 600, 4):
        four = [some(64)]
        for at in (12, 26, 40):
            four.append(edited(four[-1], at + rnd.randrange(6), "change", word()))
        sets = [set(ps.shingles(" ".join(t).encode()).tolist()) for t in four]
        near = {(j, k) for j in range(4) for k in range(j) if len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.8}
        assert near == {(1, 0), (2, 1), (3, 2)}
        ids = [0, 2, 3, 1]  # the head is the first; then come what it is not linked to, and the others
        rows += [(i + k, " ".join([*some(20), *t, *some(20)])) for k, t in zip(ids, four)]
        want |= {(i, i + 2), (i + 2, i + 3), (i + 1, i + 3)}
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in ps.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.97 * len(want)


def test_verified_passages_connect_the_classes_they_cover(spark):
    """A document with two places under a key connects those linked to the one with each other, but not with those of the other."""
    many = [(7, 1, 10, 20), (7, 1, 200, 210), (7, 2, 10, 20), (7, 3, 30, 40), (7, 4, 50, 60), (7, 5, 5, 15), (8, 2, 10, 20), (8, 3, 70, 80), (9, 4, 50, 60)]
    good = [(2, 0, 60, 1, 0, 60, 1.0), (3, 0, 60, 1, 190, 250, 0.9), (4, 40, 99, 3, 20, 79, 0.8), (5, 6, 66, 1, 6, 66, 1.0), (4, 40, 99, 2, 300, 359, 0.8)]
    table = spark.createDataFrame(many, "key long, doc long, l int, r int").selectExpr("*", f"{ps.OWN} AS part")
    links = spark.createDataFrame(good, ps.PASSAGES)
    parts = lambda df: sorted(sorted((r.doc, r.l) for r in g) for g in grouped(df.collect()))

    def grouped(rows):
        out = defaultdict(list)
        for r in rows:
            out[r.part].append(r)
        return out.values()

    first = ps._joined(table, links, 0)
    alone = [[(2, 10)], [(3, 70)], [(4, 50)], [(5, 5)]]
    assert parts(first) == sorted([[(1, 10), (2, 10)], [(1, 200), (3, 30), (4, 50)], *alone])
    # of a later level: what was connected before stays so, and one more link connects both
    more = spark.createDataFrame([(4, 40, 99, 2, 0, 60, 0.8)], ps.PASSAGES)
    assert parts(ps._joined(first, more, 1)) == sorted([[(1, 10), (1, 200), (2, 10), (3, 30), (4, 50)], *alone])


def test_roots_of_long_chains_over_many_batches():
    import pyarrow as pa

    rnd = np.random.default_rng(43)
    key, a, b, want = [], [], [], {}
    for k in range(40):
        n = int(rnd.integers(2, 300))
        nodes = rnd.permutation(1000)[:n] + 1000 * k
        cuts = set(rnd.integers(1, n, 3).tolist())
        runs = np.split(nodes, sorted(cuts))
        for run in runs:
            if len(run) > 1:
                want.update(dict.fromkeys(run.tolist(), int(run.min())))
                key += [k - 20] * (len(run) - 1)
                a += run[:-1].tolist()
                b += run[1:].tolist()
    cols = [np.array(c, np.int64) for c in (key, a, b)]
    for size in (1, 7, 1000, len(key)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=["key", "a", "b"]) for i in range(0, len(key), size)]
        got = [(x, y) for r in ps._roots(iter(batches)) for x, y in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
        assert dict(got) == want and len(got) == len(want)
