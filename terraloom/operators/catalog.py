"""Dataset catalogue: selection, availability, freshness, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_climatology() -> Column:
    return F.coalesce(F.col("kind") == "climatology", F.lit(False))


def find(
    catalogue: DataFrame, climatology: bool = False, max_days: int | None = None, min_days: int | None = None,
    source_contains: str | None = None,
) -> DataFrame:
    """Catalogue predicate; day limits apply to daily entries only."""
    out = catalogue.filter(is_climatology() == F.lit(climatology))
    if source_contains:
        out = out.filter(F.lower("source").contains(source_contains.lower()))
    if not climatology:
        days = F.coalesce(F.col("days"), F.lit(0))
        if max_days is not None:
            out = out.filter(days <= max_days)
        if min_days is not None:
            out = out.filter(days >= min_days)
    return out


def newest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Newest entry per key by ``created_at``; the first listed (``ord``) wins a tie."""
    return _pick(entries, keys, [F.coalesce("created_at", F.lit("")), -F.col("ord")])


def _pick(entries: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in entries.columns if c not in keys]
    o = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    return entries.groupBy(*keys).agg(F.max(F.struct(o.alias("o"), F.struct(*rest).alias("r"))).alias("_m")).select(*keys, "_m.r.*")


def preferred(entries: DataFrame, keys: list[str], source: str, max_days: int = 180) -> DataFrame:
    """Three-step fallback: the named source within ``max_days``, then any source within
    ``max_days``, then any; within the best step the newest entry."""
    daily = entries.filter(~is_climatology())
    short = F.coalesce(F.col("days"), F.lit(0)) <= max_days
    step = F.when(short & F.lower("source").contains(source.lower()), 2).when(short, 1).otherwise(0)
    return _pick(daily, keys, [step, F.coalesce("created_at", F.lit("")), -F.col("ord")])


def available(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with both a daily entry and a climatology."""
    daily = catalogue.filter(~is_climatology()).select(*keys).distinct()
    return daily.join(catalogue.filter(is_climatology()).select(*keys), keys, "left_semi")


def available_in_both(catalogue: DataFrame, keys: list[str], first: str, second: str, max_days: int = 180) -> DataFrame:
    """Keys for which both sources have a daily entry of at most ``max_days``."""
    pick = lambda s: find(catalogue, False, max_days=max_days, source_contains=s).select(*keys)
    return pick(first).intersect(pick(second))


def newest_end(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    daily = catalogue.filter(~is_climatology() & F.col("end_ymd").isNotNull())
    return daily.groupBy(*keys).agg(F.max("end_ymd").alias("newest_end"))


def stale_jobs(jobs: DataFrame, catalogue: DataFrame, target_end: Column, keys: list[str]) -> DataFrame:
    """Jobs with ``stale`` = newest stored day before the target; never ingested is stale."""
    j = jobs.join(newest_end(catalogue, keys), keys, "left")
    return j.withColumn("stale", F.coalesce(F.col("newest_end"), F.lit("")) < target_end)


def feed_status(catalogue: DataFrame, today: Column, keys: list[str], fresh_days: int = 7) -> DataFrame:
    """'active' when the newest stored day is at most ``fresh_days`` old, else 'stale'."""
    as_of = F.try_to_date(F.col("newest_end"), "yyyyMMdd")
    age = F.datediff(today, as_of)
    return newest_end(catalogue, keys).withColumn("as_of", as_of).withColumn(
        "status", F.when(age <= fresh_days, "active").otherwise("stale")
    )


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Entries replaced by key: the old ones with an incoming key go, the incoming stay."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def invalid_rows(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Quality report: rows whose ``key`` the registry does not know. The registry table is
    a fixed list, so it is broadcast."""
    return rows.join(F.broadcast(dim.select(key)), key, "left_anti")
