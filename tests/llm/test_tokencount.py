"""Token counts against the library itself."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from terraloom.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_proven_strings_are_whole_tokens():
    whole = tokencount.proven(PATH)
    assert 30_000 < len(whole) < 50_257 and " the" in whole and "<|endoftext|>" not in whole


def test_odd_texts_equal_the_library():
    rnd = random.Random(3)
    letters = list("aAbzé ß\t\n\r'.,!?-_0129½² \u0085​᠎ 　漢字😀\x1c\x1f\x00\x7f") + ["'s", "'re", "  ", " \n", "<|endoftext|>", "<|endof"]
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(40))) for _ in range(4000)]
    counts = tokencount.Counts(PATH, tokencount.proven(PATH))
    assert [counts.of(t) for t in texts] == library(texts)
    for t in ["ab" * 30_000, "word " * 300_000]:
        assert counts.of(t) == library([t])[0]


def test_known_counts_start_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "KNOWN_MAX", 51_000)
    counts = tokencount.Counts(PATH, tokencount.proven(PATH))
    texts = [f"zq{i}xk{i * i} qqz{i}j" for i in range(4000)]
    assert [counts.of(t) for t in texts] == library(texts) and len(counts) <= 51_001


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]))}
    got = tokencount.token_counts(docs, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len(r.text.encode()) for r in rows}
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, 9), (None, "a b", 9), (2, "", 9), (3, "x", 9), (3, "x", 9)]
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got)) == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
