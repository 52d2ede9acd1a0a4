"""Helpers shared by the corpus operators: Arrow batches of texts, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terraloom.session import scratch_path, ship_package

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: pa.Array) -> Iterator[bytes]:
    """The bytes of each string of an Arrow column, one at a time; null reads as empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].tolist() if len(col) else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = col.is_valid().to_pylist() if col.null_count else None
    for i in range(len(col)):
        yield bytes(view[at[i] : at[i + 1]]) if valid is None or valid[i] else b""


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps start from the files: lost executors cost no recomputation beyond this point,
    and every reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
