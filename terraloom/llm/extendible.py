"""Extendible hashing over DataFrames: a directory indexed by hash-prefix bits.

The whole key space starts as one bucket. A bucket that holds more than its limit is split on one
more bit of the hash; buckets that fit stay as they are, so neighbours may have different depths.
The directory is worked out from counts, not from rows: a round counts rows and bytes by a fine
prefix (a partial aggregate), adds the counts up to every shorter prefix, and gives each fine cell
the shortest prefix that fits. The first round looks a few bits past the depth that evenly spread
rows would need; only the rows of cells that still do not fit there (heavy rows and repeated keys)
go into a second round, down to the last bit. Nothing but the cell counts is shuffled, and the directory is a
DataFrame of its own: it is never collected.

Rows whose whole hash agrees cannot be told apart by more bits. If they overfill their bucket, it
gets overflow pages: rows of equal size are numbered inside slices of the written table, and a page
takes as many as fit. A single row above the limit is a bucket or page of its own.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored

BITS = 60


def hash60(key: str | Column) -> Column:
    """The first 60 bits of the key's MD5 digest; a null key hashes like the empty string."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: int) -> Column:
    """The first ``depth`` of the 60 bits."""
    return F.shiftright(h, BITS - depth)


def _cells(rows: DataFrame, limit: int, top: int, fine: int) -> DataFrame:
    """(cell, depth, prefix, fits) for each prefix of ``fine`` bits that has rows: the shortest
    prefix from ``top`` bits on that fits, or the cell itself with ``fits`` false."""
    hist = rows.groupBy(_prefix("_h", fine).alias("cell")).agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    hist = stored(hist, "cells")
    levels = hist.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(top), F.lit(fine))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {fine} - depth)")
    )
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("c"))
    fitting = sums.filter((F.col("b") <= limit) | (F.col("c") == 1)).select("depth", "prefix")
    best = levels.select("cell", "depth", "prefix").join(fitting, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    depth = F.coalesce("depth", F.lit(fine))
    return hist.select("cell").join(best, "cell", "left").select(
        F.col("cell").alias("_cell"), depth.alias("_depth"), F.expr(f"shiftright(cell, {fine} - coalesce(depth, {fine}))").alias("_prefix"), F.col("depth").isNotNull().alias("_fits")
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows whose 60 bits agree."""
    cut = stored(rows.withColumn("_slice", F.spark_partition_id()), "overflow")
    per = cut.groupBy("_h", "_size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_h", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("_h", "_size", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_h", "_size", "_slice").orderBy("_slice"))
    room = F.greatest(F.floor(F.lit(limit) / F.greatest("_size", F.lit(1))), F.lit(1))
    paged = cut.withColumn("_at", at).join(offsets, ["_h", "_size", "_slice"])
    number = F.floor((F.col("_before") + F.col("_at") - 1) / room)
    return paged.withColumns({
        "_depth": F.lit(BITS), "_prefix": F.col("_h"), "_page": F.concat_ws("-", F.col("_size").cast("string"), number.cast("string"))
    }).drop("_slice", "_at", "_before")


def assign(rows: DataFrame, limit: int) -> DataFrame:
    """Give every row its bucket.

    ``rows`` has the columns ``_h`` (60 bits) and ``_size`` (bytes, not null) beside any others; the
    result has all of them and ``_depth``, ``_prefix`` and ``_page`` (null but for overflow pages).
    """
    total = rows.agg(F.sum("_size"), F.count(F.lit(1))).first()
    done, rest, top = None, rows, 0
    fine = min(BITS, max(2, (max(1, (total[0] or 0) // limit)).bit_length() + 3))
    while True:
        cells = stored(_cells(rest, limit, top, fine), "directory")
        placed = rest.withColumn("_cell", _prefix("_h", fine)).join(cells, "_cell").drop("_cell")
        fit = placed.filter("_fits").drop("_fits").withColumn("_page", F.lit(None).cast("string"))
        done = fit if done is None else done.unionByName(fit)
        if cells.filter("NOT _fits").limit(1).count() == 0:
            return done
        rest = stored(placed.filter("NOT _fits").drop("_fits", "_depth", "_prefix"), "split")
        if fine == BITS:
            return done.unionByName(_pages(rest, limit))
        top, fine = fine + 1, BITS


def bucket_name(depth: str = "_depth", prefix: str = "_prefix", page: str = "_page") -> Column:
    """The prefix bits as text, "all" for the undivided space, with an overflow page's number."""
    bits = F.expr(f"CASE WHEN {depth} = 0 THEN 'all' ELSE lpad(bin({prefix}), CAST({depth} AS INT), '0') END")
    return F.concat_ws("-", bits, F.col(page))


def shards(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_size`` (UTF-8 bytes of the text), ``_depth``, ``_prefix`` and ``_page``.

    Defined results: a null text has 0 bytes; a null id hashes like the empty string; repeated rows
    share a shard as long as they fit and else fill overflow pages; an empty table gives no rows.
    All columns of ``docs`` are kept; their names must not begin with an underscore.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return assign(docs.withColumns({"_h": hash60(doc_id), "_size": size}), limit).drop("_h")


def named_shards(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """The rows of ``docs`` with the name of their shard as the last column ``name``; a column of that name in ``docs`` gives way
    to it. Other columns may have any names."""
    cols = [c for c in docs.columns if c.lower() != name.lower()]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), hash60(doc_id).alias("_h"), size.alias("_size"))
    return assign(rows, limit).select("row", bucket_name().alias("_name")).select("row.*", "_name").toDF(*cols, name)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the output of ``shards`` as one folder per shard; a shard is written by one task."""
    named = sharded.withColumn("shard", bucket_name()).drop("_depth", "_prefix", "_page", "_size")
    named.repartition("shard").write.partitionBy("shard").parquet(path)
