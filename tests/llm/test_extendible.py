"""Sharding by extendible hashing against its definition, and its odd cases."""

import hashlib
import os
from collections import defaultdict

import pytest

from terraloom.llm import extendible


def h60(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def plain(rows, limit):
    """Recursive splitting, the textbook way. Yields (depth, prefix, rows)."""
    def split(rows, depth, prefix):
        if sum(s for _, s in rows) <= limit or len(rows) == 1 or depth == 60:
            yield depth, prefix, rows
            return
        for bit in (0, 1):
            part = [r for r in rows if h60(r[0]) >> (59 - depth) & 1 == bit]
            if part:
                yield from split(part, depth + 1, prefix * 2 + bit)
    return list(split(rows, 0, 0)) if rows else []


@pytest.mark.parametrize("limit", [300, 5_000, 10**9])
def test_against_recursive_splitting(spark, limit):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(500)] + [(1000, "y" * 4000), (1001, None), (1002, "")]
    got = extendible.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    want = {r[0]: (d, p) for d, p, rs in plain([(i, len(t or "")) for i, t in rows], limit) for r in rs}
    assert {r.doc_id: (r._depth, r._prefix) for r in got} == want and len(got) == len(rows)
    assert all(r._page is None for r in got)


def test_repeated_rows_fill_overflow_pages(spark):
    rows = [(7, "z" * 90)] * 2000 + [(7, "w" * 500)] * 3 + [(None, "n" * 60)] * 4 + [(i, "a" * 50) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = extendible.shards(df, 400).withColumn("shard", extendible.bucket_name()).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r._size)
    assert all(sum(v) <= 400 or len(v) == 1 for v in held.values())
    assert sum(k.endswith(f"-90-{n}") for k in held for n in [k.rsplit("-", 1)[-1]]) == 500


def test_empty_and_extra_columns(spark):
    assert extendible.shards(spark.createDataFrame([], "doc_id long, text string"), 10).collect() == []
    got = extendible.shards(spark.createDataFrame([(1, "ab", "q", 4)], "doc_id long, text string, cell string, depth int"), 10).first()
    assert (got.cell, got.depth, got._depth, got._size) == ("q", 4, 0, 2)


def test_hot_key_of_a_third(spark):
    rows = [(1, "h" * 10)] * 3000 + [(i, "h" * 10) for i in range(10, 6010)]
    got = extendible.shards(spark.createDataFrame(rows, "doc_id long, text string"), 1000).groupBy(extendible.bucket_name().alias("s")).sum("_size").collect()
    assert max(r[1] for r in got) <= 1000 and sum(r[1] for r in got) == 90_000


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "text " * 20) for i in range(100)], "doc_id long, text string")
    extendible.write_shards(extendible.shards(df, 2000), str(tmp_path / "out"))
    folders = [f for f in os.listdir(tmp_path / "out") if f.startswith("shard=")]
    assert len(folders) >= 5 and spark.read.parquet(str(tmp_path / "out")).count() == 100
