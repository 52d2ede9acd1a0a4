"""The prefix trie: list ranking, prefix sums, whole tables against brute force, odd rows."""

import hashlib
import random
import zlib

import pytest

from terraloom.llm import prefixtrie as pt
from terraloom.llm.queries import QUERIES


def brute(rows):
    """Every node from the rebuilt conversations themselves."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((role or "", text or "", turn))
    dig = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c in turns:
        turns[c] = [x[:2] for x in sorted(turns[c], key=lambda x: (x[2] is not None, x[2] or 0, dig(x[0], x[1])))]
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    children = {}
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    out = []
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode().split()) if k else 0)
    for k, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], sha))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, depth string")
    return sorted(map(tuple, pt.prefix_trie(df).collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str)
    assert got == brute(rows) and len(got) > 100


def test_random_tries(spark, monkeypatch):
    monkeypatch.setattr(pt, "SLICE_BITS", 2)  # many slices of a conversation and of the tour
    monkeypatch.setattr(pt, "PIECE", 3)
    rnd = random.Random(4)
    rows = []
    for c in [*range(90), *range(-25, 0, 3), 10**15]:
        for turn in range(rnd.choice([1, 1, 2, 3, 6, 25])):
            rows.append((c, rnd.choice([turn, turn, None, 3]), rnd.choice(["user", None, "u"]), rnd.choice(["a b", "c", None, "", "d  e\tf"])))
    rows += rows[:20] + [(None, 1, "user", "a b")]
    assert run(spark, rows) == brute(rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(1, k, "u", f"turn {k}") for k in range(9000)]
    rows += [(c, k, "u", f"copy {k}") for c in range(100, 500) for k in range(4)]
    rows += [(c, k, "u", f"own {c if k == 3 else ''}") for c in range(1000, 1400) for k in range(4)]  # a node with many children
    got = run(spark, rows)
    want = {r[0]: r for r in got if r[1] == 0}
    assert len(want) == 1 and want[1][3] == 801
    deep = [r for r in got if r[0] == 1 and r[1] > 4]
    assert all(r[3] == 1 and r[5] == 1 and r[6] == 0 for r in deep)
    few = [r for r in rows if r[0] != 1]
    assert run(spark, few) == brute(few)


@pytest.mark.parametrize("spacing", [1, 3, 1000])
def test_list_ranking(spark, spacing):
    rnd = random.Random(spacing)
    ids = rnd.sample(range(10**6), 300)
    weight = {i: rnd.randrange(1, 9) for i in ids}
    arcs = spark.createDataFrame([(a, b, weight[a]) for a, b in zip(ids, [*ids[1:], None])], "id long, next long, dist long")
    got = {r.id: r.dist for r in pt.ranks(arcs, spacing).collect()}
    assert got == {i: sum(weight[x] for x in ids[k:]) for k, i in enumerate(ids)}


def test_prefix_sums(spark):
    rnd = random.Random(1)
    v = [(p, rnd.randrange(-5, 6), "k") for p in range(200)]
    rnd.shuffle(v)
    got = pt.prefix_sums(spark.createDataFrame(v, "pos long, v long, other string"), ["v"], bits=2)
    assert got.columns == ["pos", "v", "other"]
    assert {r.pos: r.v for r in got.collect()} == {p: sum(x for q, x, _ in v if q <= p) for p, _, _ in v}


def test_odd_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "a")]) == []
    only = run(spark, [(7, None, None, None)])
    assert only == brute([(7, None, None, None)])
    long = [(3, 0, "u", "w " * 200_000), (3, 1, "u", ""), (4, 0, "u", "w " * 200_000)]
    assert run(spark, long) == brute(long)
