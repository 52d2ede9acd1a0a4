"""SimHash near-duplicates against brute force, and its edge cases."""

import itertools
import random
import re

import pytest
import xxhash

from terraloom.llm import simhash
from terraloom.llm.components import components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    t = (text or "").encode().decode("latin-1")
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode("latin-1"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_components(fps):
    """id -> smallest id reachable, over all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


def run(spark, rows, schema="doc_id long, text string"):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema))
    return out.select("doc_id", simhash.as_hex("fp").alias("f"), "component_id").collect()


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: plain_fingerprint(t) for i, t in docs}
    want = plain_components(fps)
    got = run(spark, docs)
    assert len(got) == len(docs)
    assert {r.doc_id: (r.f, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_links_reach_every_distance_of_three(spark):
    rnd = random.Random(7)
    fps = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(6):  # a walk of small steps, so that components are longer than one link
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])):
                base ^= 1 << b
            fps.add(base)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    comp = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = plain_components({signed(f): f for f in fps})
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({signed(f): comp.get(signed(f), signed(f)) for f in fps}) == groups(want)


def test_odd_rows(spark):
    long_text = "alpha beta gamma delta " * 40_000
    rows = [(7, None), (3, ""), (5, " \t\n "), (None, "one"), (9, "ONE"), (9, "ONE"), (11, long_text), (12, long_text), (13, "É x y"), (14, "é x y")]
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.doc_id, []).append((r.f, r.component_id))
    assert got[7] == got[3] == got[5] == [("0" * 16, 3)]
    assert got[None] == [(f"{xxhash.xxh64_intdigest(b'one', 42):016x}", 9)] and len(got[9]) == 2 and got[9][0] == got[None][0]
    assert got[11][0][1] == got[12][0][1] == 11
    assert got[11][0][0] == f"{plain_fingerprint(long_text):016x}"
    assert got[13][0][0] != got[14][0][0]  # only A-Z are lower-cased


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c", 5, "x", 3.0), (2, "a b c", 6, "y", 4.0)]
    got = run(spark, rows, "doc_id long, text string, fp long, component_id string, variant double")
    assert [r.component_id for r in got] == [1, 1]


def test_hot_group_of_copies(spark):
    got = run(spark, [(i, "the same words in every row") for i in range(3000)] + [(i, f"other {i} words {i * 7} here") for i in range(3000, 4000)])
    assert sum(r.component_id == 0 for r in got) == 3000


@pytest.mark.parametrize("edges, want", [
    ([], {}),
    ([(1, 1)], {}),
    ([(2, 1), (1, 2), (2, 3), (3, None)], {1: 1, 2: 1, 3: 1}),
    ([(i, i + 1) for i in range(300)] + [(1000, 1001)], {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.root for r in components(df).collect()} == want


def test_one_of_each_keeps_a_row_of_each_component_of_a_repeated_id(spark):
    rnd = random.Random(6)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, a), (1, b), (4, c)])
