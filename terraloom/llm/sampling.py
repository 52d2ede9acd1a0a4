"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id as text falls into the fold that is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, folds: int, fold: int, per_class: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most ``per_class`` rows of either label outside of the held-out fold.

    Rows are taken in the order of a hash of the id, so the choice does not depend on the order or
    partitioning of the table. An id that occurs more than once has its smallest label; rows with a
    null id or label are not used.
    """
    rows = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y"))
    take = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return take(0).unionByName(take(1))
