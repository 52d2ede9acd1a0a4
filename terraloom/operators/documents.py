"""Result documents: collections, dashboards, listings, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators import windows as wn
from terraloom.schemas import CLASSES


def mean_land_cover(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share per class over all documents of a key; a missing class counts 0."""
    cover = [
        F.round(F.sum(F.coalesce(F.try_element_at("land_cover", F.lit(c)), F.lit(0.0))) / F.count(F.lit(1)), 2).alias(c) for c in CLASSES
    ]
    return docs.groupBy(*keys).agg(*cover)


def land_cover_delta(docs: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Newer half minus older half of the mean land cover; 0 with fewer than two documents."""
    halves = mean_land_cover(wn.half_split(docs, keys, order, tie), [*keys, "half"])
    side = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    return halves.groupBy(*keys).agg(
        *[F.round(F.coalesce(side("newer", c) - side("older", c), F.lit(0.0)), 2).alias(c) for c in CLASSES]
    )


def object_totals(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.explode("object_counts").alias("label", "n")).groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def totals(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, reports, objects and mean confidence per key."""
    n_objects = F.aggregate(F.map_values("object_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.coalesce(F.length("report_url"), F.lit(0)) > 0).alias("reports"),
        F.sum(n_objects).alias("objects"),
        F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count(F.lit(1)), 1).alias("avg_confidence"),
    )


def dominant(cover: Column) -> Column:
    """Key of the largest map value, the first entry on a tie; NULL for an empty map."""
    entries = F.transform(F.map_entries(cover), lambda e, k: F.struct(e["value"].alias("v"), (-k).alias("o"), e["key"].alias("k")))
    return F.array_max(entries)["k"]


def newest(docs: DataFrame, keys: list[str], order: str, tie: str, limit: int = 50) -> DataFrame:
    """Newest-first listing per key. The rank filter is a group limit, which Spark applies
    in every task before the shuffle, so a key with very many documents is cut early."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc())
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def recent(docs: DataFrame, keys: list[str], order: str, tie: str, limit: int = 6) -> DataFrame:
    top = newest(docs, keys, order, tie, limit)
    return top.withColumn("dominant", F.coalesce(dominant(F.col("land_cover")), F.lit("none")))


def confidence_trend(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Chronological (name, confidence) rows, in a distributed sort."""
    return docs.select(*keys, order, "name", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).orderBy(*keys, order)


def latest(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Current documents of an append-only change log: the newest entry per key, deletions
    (``deleted``) dropped."""
    out = wn.latest_by_key(changes, [key], [F.col(order)])
    return out.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in changes.columns else out


def document_key(doc_id: Column, email: Column) -> Column:
    """Key of a document: its id, else its e-mail, else a random one."""
    return F.coalesce(F.when(doc_id != "", doc_id), F.when(email != "", email), F.expr("uuid()"))


def project(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Whitelisted columns only; unknown ones become NULL."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in columns])


def headlines(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Well-formed articles, the first of each title (trimmed, case ignored) kept.

    The first is found with a ``min`` aggregate, so a title repeated a billion times is
    reduced in every task. ``limit`` is held between 1 and 20.
    """
    t = F.trim(F.coalesce("title", F.lit("")))
    ok = articles.filter((t != "") & (F.coalesce("url", F.lit("")) != ""))
    rest = [c for c in articles.columns if c != "position"]
    first = ok.groupBy(F.lower(t).alias("_t")).agg(F.min(F.struct("position", F.struct(*rest).alias("r"))).alias("_m"))
    out = first.select("_m.position", "_m.r.*")
    if limit is None:
        return out
    return out.orderBy("position").limit(max(1, min(int(limit), 20)))
