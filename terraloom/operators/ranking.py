"""Ranks and exact quantiles inside groups that may be too large for one task.

Rows are cut into slices by range partitioning on (keys, order, tie), which balances itself
by sampling whatever the distribution, ties included as long as ``tie`` tells rows apart.
The slices are counted (a table of at most groups + partitions rows) and a window only ever
sees one slice. The sliced rows are written once, so that counts and rows agree on the slice
borders also when tasks are run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.session import cut_lineage


def sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_slice``, the range partition of a row under ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


def slice_offsets(d: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Rows (or summed weight) of a key before each of its slices, and in all of them."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    per = d.groupBy(*keys, "_slice").agg(size.alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_slice"))
    return per.select(*keys, "_slice", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))


def group_rank(df: DataFrame, keys: list[str], order: str, tie: str, rank: str = "rank", total: str = "total") -> DataFrame:
    """Rank from 1 (ascending ``order``, then ``tie``) and size of the group."""
    d = sliced(df, [*keys, order, tie])
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order, tie))
    j = d.withColumn("_inside", inside).join(slice_offsets(d, keys), [*keys, "_slice"])
    return j.withColumns({rank: F.col("_before") + F.col("_inside"), total: F.col("_total")}).drop(
        "_slice", "_before", "_inside", "_total"
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, exact, without gathering a group.

    Equal values are counted together first. ``probs`` maps output names to probabilities.
    """
    v = F.col(value)
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    d = sliced(counts, [*keys, "_v"])
    running = F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_v"))
    j = d.withColumn("_run", running).join(slice_offsets(d, keys, "_c"), [*keys, "_slice"])
    last = F.col("_before") + F.col("_run")  # rank (from 1) of the value's last copy
    first = last - F.col("_c")
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((k >= first) & (k < last), F.col("_v")))  # noqa: E731, B023
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        out.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return j.groupBy(*keys).agg(*out)
