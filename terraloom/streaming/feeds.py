"""Structured Streaming over landed observations: windows, spells, upserts, limits.

Streams read files as they land; a watermark bounds the state, and every sink is a written
table (or an idempotent ``foreachBatch``), never driver memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from terraloom.functions.calendar import capped_doy
from terraloom.operators.windows import latest_by_key
from terraloom.session import scratch_path

LATENCY = "3 days"  # fixed value: how late observations may arrive


def landed(spark: SparkSession, path: str, schema: StructType, time_col: str, max_files: int | None = None) -> DataFrame:
    """Stream over a table, be it one file or a folder of part files, with an event-time column
    ``ts`` (zone-less times are read in the session zone, UTC). ``max_files`` bounds a micro-batch.

    The path goes to the source as a pattern that only it matches: a stream takes a plain path for
    a folder, a pattern for whatever it finds.
    """
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col(time_col).cast("timestamp"))


def tumbling_means(stream: DataFrame, keys: list[str], value: str, width: str = "1 day", delay: str = LATENCY) -> DataFrame:
    """Daily aggregates per key, emitted once the watermark has passed the window."""
    w = F.window("ts", width)
    agg = stream.withWatermark("ts", delay).groupBy(w, *keys).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("window.start").alias("start"), *keys, "mean", "total", "n")


def sliding_sums(stream: DataFrame, keys: list[str], value: str, width: str = "7 days", slide: str = "1 day", delay: str = LATENCY) -> DataFrame:
    """Rolling sums that look ``width`` ahead from each start."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("window.start").alias("start"), *keys, "total", "n")


def spells(stream: DataFrame, keys: list[str], flag: Column, gap: str = "1 day 1 second", delay: str = LATENCY) -> DataFrame:
    """Spells of flagged observations: sessions that close after a gap of more than a day.

    Each task merges the sessions of its own rows before the exchange, so that a key with most of the rows sends few
    sessions and not its rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    hot = stream.withWatermark("ts", delay).filter(flag)
    agg = hot.groupBy(F.session_window("ts", gap), *keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "first", "last", "n")


def latest_per_station(stream: DataFrame, keys: list[str], value: str, ttl: str = "600 seconds", delay: str = LATENCY) -> DataFrame:
    """Newest value per key and time-to-live slot."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", ttl), *keys).agg(F.max("ts").alias("as_of"), F.max_by(value, "ts").alias("latest"))
    return agg.select(F.col("window.start").alias("slot"), *keys, "as_of", "latest")


def first_in_slot(stream: DataFrame, keys: list[str], slot: str = "3 hours", delay: str = LATENCY) -> DataFrame:
    """The first alert of each key in each slot of event time, and how many it stands for. A fixed rule
    that does not depend on the order of arrival, with a partial ``min`` before the shuffle."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", slot), *keys).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("window.start").alias("slot"), *keys, "first", "n")


def with_anomaly(stream: DataFrame, clim: DataFrame, value: str, normal: str, keys: list[str]) -> DataFrame:
    """Stream-static join: observation minus the normal of its day of year."""
    d = stream.withColumn("doy", capped_doy(F.to_date("ts")))
    return d.join(clim, [*keys, "doy"], "left").withColumn("anomaly", F.col(value) - F.col(normal))


# --------------------------------------------------------------------------- upsert
def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each micro-batch replaces its own folder, so a repeated
    batch leaves the same table. Late rows enter here however late they are."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_observations(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """Latest-wins view over the upserted batches (the newer batch, then the newer row)."""
    d = spark.read.parquet(path)
    return latest_by_key(d, keys, [F.col("batch"), F.col(order)]).drop("batch")


# --------------------------------------------------------------------------- limiter
def _limiter(keys: list[str], cooldown: float, cap: int):
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sent = state.get if state.exists else (-(2**62), 0)
        if sent >= cap:
            for _ in chunks:
                pass
            return
        # only the times are kept while the chunks of a micro-batch stream in
        times = np.sort(np.concatenate([c["us"].to_numpy(dtype="int64") for c in chunks]))
        step, out = int(cooldown * 1_000_000), []
        while sent < cap:
            at = int(np.searchsorted(times, last + step)) if sent else 0
            if at >= len(times):
                break
            last, sent = int(times[at]), sent + 1
            out.append((*key, last, sent))
        state.update((last, sent))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "us", "n"])

    return run


def rate_limited(stream: DataFrame, keys: list[str], cooldown: float = 30.0, cap: int = 6) -> DataFrame:
    """Requests that pass a per-key cooldown (seconds) and a cap on how many may pass.

    The state per key is two numbers. ``maxFilesPerTrigger`` of the source bounds what one
    key can bring in a micro-batch, of which only the times are held.
    """
    fields = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    us = stream.select(*keys, F.unix_micros("ts").alias("us"))
    passed = us.groupBy(*keys).applyInPandasWithState(
        _limiter(keys, cooldown, cap), f"{fields}, us bigint, n int", "last bigint, sent int", "append", GroupStateTimeout.NoTimeout
    )
    return passed.select(*keys, F.timestamp_micros("us").alias("ts"), "n")


# --------------------------------------------------------------------------- running
def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what has landed, write it to the shared folder, return the written table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_upsert(stream: DataFrame, label: str) -> str:
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = stream.writeStream.foreachBatch(upsert_into(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return out
