"""Exact dedup against brute force, forced hash collisions, hot chains."""

import hashlib
import re

from pyspark.sql import functions as F

from terraloom.llm import exactdedup


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, h int, norm string")
    return sorted((tuple(r) for r in exactdedup.exact_duplicates(df, **k).collect()), key=str)


ROWS = [(5, "a b"), (3, "a \t\n b"), (9, "a b "), (10, "a b "), (4, None), (2, ""), (8, " "), (None, "q"), (None, "q"), (6, "é"), (7, "É"), (3, "a b"), (11, "x" * 300_000), (12, "x" * 300_000)]


def test_odd_rows(spark):
    assert run(spark, ROWS) == plain(ROWS)
    assert run(spark, ROWS, bucket_bytes=4) == plain(ROWS)
    assert run(spark, []) == []


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "_hash", lambda norm: F.octet_length(norm).cast("bigint"))
    monkeypatch.setattr(exactdedup, "_sha", lambda norm: F.lit("same"))
    got = [r[:4] for r in run(spark, ROWS)]
    assert sorted(got, key=str) == sorted([r[:4] for r in plain(ROWS)], key=str)


def test_hot_chain_in_pages(spark):
    rows = [(i, "the same text " * 20) for i in range(2000)] + [(i, f"text {i // 3}") for i in range(2000, 2600)]
    assert run(spark, rows, bucket_bytes=10_000) == plain(rows)
