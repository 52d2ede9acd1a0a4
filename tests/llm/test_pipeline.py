"""The pipeline: each stage against brute force on its own input, and the run as a whole."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_extendible import plain as plain_shards
from tests.llm.test_mixing import filled
from tests.llm.test_simhash import plain_components, plain_fingerprint
from terraloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    stage = dict(cp.STAGES)

    one = stage["quality"](spark, docs, SF)
    good = {r.doc_id for r in quality.scores(docs, labels).filter("predicted = 1").collect()}
    assert one.columns == docs.columns and sorted(rows(one)) == sorted(r for r in rows(docs) if r[0] in good)

    two = stage["near_duplicates"](spark, one, SF)
    root = plain_components({i: plain_fingerprint(t) for i, t, *_ in rows(one)})
    assert sorted(rows(two)) == sorted(r for r in rows(one) if root[r[0]] == r[0])

    three = stage["decontamination"](spark, two, SF)
    assert sorted(rows(three)) == sorted(r for r in rows(two) if not plain_contamination(r[1], bench)[-1])

    four = stage["mixing"](spark, three, SF)
    before, after = {r[0]: r for r in rows(three)}, rows(four)
    order = sorted({r[3] for r in before.values()})
    sizes = {s: sum(len(r[1].split()) for r in before.values() if r[3] == s) for s in order}
    want = dict(zip(order, filled([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    words, copies = defaultdict(int), Counter()
    for r in after:
        words[r[3]] += len(r[1].split())
        copies[r[0]] += 1
        assert r == before[r[0]]  # whole documents, as they are
    largest = {s: max(len(r[1].split()) for r in before.values() if r[3] == s) for s in order}
    assert all(abs(words[s] - want[s]) <= largest[s] / 2 + 1 for s in order) and max(copies.values()) <= 3

    five = stage["sharding"](spark, four, SF).collect()
    named = {i: (d, p) for d, p, rs in plain_shards([(r[0], len(r[1].encode())) for r in after], cp.SHARD_BYTES) for i, _ in rs}
    assert len(five) == len(after)
    for r in five:
        d, p = named[r.doc_id]
        assert r.shard == ("all" if d == 0 else f"{p:b}".zfill(d))


def test_run_equals_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
    key = lambda df: Counter((r.doc_id, r.n_chars, r.shard) for r in df.collect())
    assert key(got) == key(docs)


def test_one_of_each_with_odd_ids(spark):
    from terraloom.llm.simhash import one_of_each

    rows = [(3, "a b c"), (3, "a b c"), (1, "a b c"), (None, "a b c"), (None, "lone words here"), (None, "lone words here"), (None, None), (8, "q r s")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, ""), (-1, "lone words here"), (1, "a b c"), (8, "q r s")]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in cp.STAGES:
        out = f(spark, docs, SF)
        assert out.collect() == [] and (name == "sharding" or out.columns == docs.columns)


def test_stages_with_clashing_columns_and_odd_rows(spark):
    names = ["shard", "_part", "_size", "_no", "row", "row_number", "_h", "_depth"]
    rows = [(i, t, "en", s, 1, *[f"{n}{i}" for n in names]) for i, t, s in [
        (1, "a few plain words of a text", "a"), (1, "a few plain words of a text", "a"), (2, None, None), (None, "other words that are here", "b"), (None, "", None), (4, "w " * 60_000, "a"),
    ]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for name, f in cp.STAGES:
        out = f(spark, docs, SF)
        kept = [tuple(r) for r in out.collect()]
        assert out.columns == (docs.columns if name != "sharding" else [c for c in docs.columns if c != "shard"] + ["shard"])
        assert name == "sharding" or {r for r in kept} <= set(rows)
        assert name != "sharding" or len(kept) == len(rows)
    from terraloom.llm.simhash import one_of_each

    assert sorted(r[5] for r in one_of_each(docs).collect()) == ["shard1", "shard2", "shard4", "shardNone"]
