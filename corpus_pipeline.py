"""Corpus pipeline: five stages, one after another, over the documents of a folder.

A stage gets all rows that its predecessor kept, written as Parquet and read again, and its decisions
take effect: rejected, duplicate and contaminated documents go, the mix repeats or leaves out
documents, and the last stage names each document's shard. Filtering stages keep every column.

Defined results: a null text counts as empty; rows that repeat an id are judged row by row, but for the near-duplicate
stage, which keeps one row of each component, and the mix, which takes or leaves them together; ties go to the
smallest id; an empty table stays empty; further columns of any name are kept, a column ``shard`` gives way to the last
stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import decontaminate, extendible, mixing, quality, simhash
from terraloom.llm.common import stored, table

SHARD_BYTES = 1 << 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each SimHash component."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def name_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the name of their shard of at most ``SHARD_BYTES``."""
    return extendible.named_shards(docs, SHARD_BYTES)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", name_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
