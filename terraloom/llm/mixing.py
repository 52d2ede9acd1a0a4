"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of a budget of words. A source is never repeated more than
``EPOCHS`` times: targets are clamped at that many times the source's size and the excess goes to
the other sources in proportion to their weights, again and again until no target is above its cap.
Targets are ``weight * level`` below the cap, so only the level is worked out on the driver, from two
sums over the sources in each round; a round clamps at least one more source or is the last.

A source with target T and size S takes floor(T / S) whole repetitions of each document. The rest is
one fractional repetition: documents in the order of a seeded hash of their id are taken whole until
the target is reached; ``mix`` counts the words that the document at the border would have to give for the source to meet
its target to the word, ``repeated`` takes that document whole or not at all. The border is found without sorting a source: words are counted by cells of
the hash (a partial aggregate), the cells' running sum gives the border cell, and only that cell's
documents are put in order. Reruns agree, as nothing but the ids and the seed decides.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its own
and comes last; a null doc_id hashes like the empty string; rows that repeat a doc_id within a source
are one unit of the fractional repetition (all taken or none), each row keeping its own size; a
source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
CELL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def place(doc_id: str, seed: int) -> Column:
    """A number of 60 bits: the seeded order of the documents."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) with one row per source.

    Sources in order of their code points, null last, get the weights in turn.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))  # one row per source
    ring = F.array(*[F.lit(float(w)) for w in weights])
    s = stored(sources.withColumn("weight", F.element_at(ring, ((order - 1) % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * epochs
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        clamped = F.col("weight") * level > cap if level else F.lit(False)
        fixed, free = s.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not free:
            level = math.inf if total else 0.0
            break
        new = (total - (fixed or 0)) / free
        if new <= level:
            break
        level = new
    target = cap.cast("double") if math.isinf(level) else F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _rules(sized: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> tuple[DataFrame, DataFrame]:
    """From (source, doc_id, size, u): a row for each source, with its whole repetitions and its border
    cell, and the part that each document of a border cell gives to the fractional repetition."""
    cells = stored(sized.groupBy("source", _cell("u").alias("cell")).agg(F.sum("size").alias("words")), "cells")
    sums = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = source_targets(sums, weights, share, epochs)
    whole = F.coalesce(F.floor(F.round(F.col("target")) / F.nullif("source_size", F.lit(0))), F.lit(0))
    goals = goals.withColumn("whole", whole).withColumn("rest", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    goals = stored(goals, "goals")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    running = cells.withColumn("upto", upto)
    border = stored(running.join(goals, running["source"].eqNullSafe(goals["source"])).filter("upto - words < rest AND upto >= rest").select(
        goals["source"], "cell", (F.col("upto") - F.col("words")).alias("before")
    ), "border")
    ruled = stored(goals.join(border, goals["source"].eqNullSafe(border["source"]), "left").select(
        goals["source"].alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"),
        F.col("rest").alias("_rest"), F.coalesce("cell", F.lit(-1)).alias("_border"), F.coalesce("before", F.lit(0)).alias("_before"),
    ), "rules")
    inner = sized.join(ruled, sized["source"].eqNullSafe(ruled["_source"])).filter(_cell("u") == F.col("_border"))
    units = inner.groupBy("source", "u", "doc_id").agg(F.sum("size").alias("unit"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    start = F.col("_before") + F.sum("unit").over(Window.partitionBy("source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("unit")
    part = units.withColumn("start", start).select(
        F.col("source").alias("_unit_source"), F.col("doc_id").alias("_unit_id"),
        F.when(F.col("unit") > 0, F.least(F.greatest((F.col("_rest") - F.col("start")) / F.col("unit"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("_part"),
    )
    return ruled, part


def _cell(u: str) -> Column:
    return F.shiftright(u, 60 - CELL_BITS)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with ``_size``, ``_source_size``, ``_target``, ``_whole`` (repetitions) and ``_part``
    (of one more repetition)."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), place(doc_id, seed).alias("u")), "sized")
    ruled, part = _rules(sized, weights, share, epochs)
    at = docs.withColumns({"_size": size, "_u": place(doc_id, seed)})
    at = at.join(ruled, at[source].eqNullSafe(ruled["_source"]))
    cell = _cell("_u")
    edge = at.filter(cell == F.col("_border"))
    edge = edge.join(part, edge[source].eqNullSafe(part["_unit_source"]) & edge[doc_id].eqNullSafe(part["_unit_id"])).drop("_unit_source", "_unit_id")
    others = at.filter(cell != F.col("_border")).withColumn("_part", F.when(cell < F.col("_border"), 1.0).otherwise(0.0))
    return others.unionByName(edge).drop("_u", "_source", "_rest", "_border", "_before")


def taken() -> Column:
    return (F.col("_whole") * F.col("_size") + F.round(F.col("_part") * F.col("_size"))).cast("bigint")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of ``docs``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    return mixed(narrow, **how).select("doc_id", F.col("_size").alias("size"), "source", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken().alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns as they are, each as often as the mix takes it. The unit at the
    border of a source's target is taken whole or not at all, whichever comes nearer to the target."""
    rows = mixed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source"), **how)
    copies = (F.col("_whole") + (F.col("_part") >= 0.5).cast("bigint")).cast("int")
    return rows.filter(copies > 0).select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("k")).select("row.*")
