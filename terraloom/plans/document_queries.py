"""Queries over result documents, news and event payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import documents as dc
from terraloom.plans.registry import query
from terraloom.plans.shape import i, r
from terraloom.schemas import CLASSES
from terraloom.sources import tables as tb

D = f"WITH {tb.DOCS}"
LC = [c.lower() for c in CLASSES]
K = ["owner"]


def _means(where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return ", ".join(f"round(sum(coalesce(lc_{c}, 0)){f} / count(*){f}, 2) AS {c}" for c in LC)


@query("doc_land_cover", f"{D} SELECT owner, {_means()} FROM docs GROUP BY owner")
def doc_land_cover(spark, sf):
    m = dc.mean_land_cover(tb.docs(spark, sf), K)
    return m.select("owner", *[F.col(c).alias(c.lower()) for c in CLASSES])


@query(
    "doc_land_cover_delta",
    f"""{D}, h AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at) <= count(*) OVER (PARTITION BY owner) // 2 AS older FROM docs),
    o AS (SELECT owner, {_means('older')} FROM h GROUP BY owner), n AS (SELECT owner, {_means('NOT older')} FROM h GROUP BY owner)
    SELECT owner, {', '.join(f'round(coalesce(n.{c} - o.{c}, 0), 2) AS {c}' for c in LC)} FROM n JOIN o USING (owner)""",
)
def doc_land_cover_delta(spark, sf):
    d = dc.land_cover_delta(tb.docs(spark, sf), K, "created_at", "id")
    return d.select("owner", *[F.col(c).alias(c.lower()) for c in CLASSES])


@query(
    "doc_object_totals",
    f"{D} SELECT owner, 'Building' AS label, CAST(sum(n_building) AS BIGINT) AS n FROM docs GROUP BY owner UNION ALL SELECT owner, 'Road', CAST(sum(n_road) AS BIGINT) FROM docs WHERE n_road IS NOT NULL GROUP BY owner",
)
def doc_object_totals(spark, sf):
    return dc.object_totals(tb.docs(spark, sf), K)


@query(
    "doc_dashboard",
    f"""{D} SELECT owner, count(*) AS images, count(*) FILTER (WHERE report_url IS NOT NULL) AS reports, CAST(sum(n_building + coalesce(n_road, 0)) AS BIGINT) AS objects,
      round(sum(confidence) / count(*), 1) AS avg_confidence FROM docs GROUP BY owner""",
)
def doc_dashboard(spark, sf):
    return dc.totals(tb.docs(spark, sf), K)


@query(
    "doc_recent",
    f"""{D}, m AS (SELECT *, greatest(lc_forest, lc_water, lc_agriculture, coalesce(lc_urban, -1), lc_others) AS mx FROM docs)
    SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC) AS rank, id, CASE WHEN lc_forest = mx THEN 'Forest' WHEN lc_water = mx THEN 'Water' WHEN lc_agriculture = mx THEN 'Agriculture'
      WHEN lc_urban = mx THEN 'Urban' ELSE 'Others' END AS dominant FROM m QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at DESC) <= 6""",
)
def doc_recent(spark, sf):
    return dc.recent(tb.docs(spark, sf), K, "created_at", "id").select("owner", i("rank"), "id", "dominant")


@query(
    "doc_listing",
    f"{D} SELECT owner, id, name FROM docs QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at DESC) <= 50",
)
def doc_listing(spark, sf):
    """Listing: the newest 50 per owner, whitelisted columns."""
    return dc.project(dc.newest(tb.docs(spark, sf), K, "created_at", "id", 50), ["owner", "id", "name"])


@query("doc_confidence_trend", f"{D} SELECT owner, created_at, name, confidence FROM docs")
def doc_confidence_trend(spark, sf):
    return dc.confidence_trend(tb.docs(spark, sf), K, "created_at")


@query(
    "latest_docs",
    """SELECT DISTINCT ON (conv_id) conv_id AS id, turn AS seq, role, length(text) AS n_chars FROM conversations ORDER BY conv_id, turn DESC""",
)
def latest_docs(spark, sf):
    """Conversations as a change log: every turn replaces the document of its conversation."""
    c = tb.table(spark, sf, "conversations")
    log = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "role", F.length("text").alias("n_chars"))
    return dc.latest(log).select("id", "seq", "role", i("n_chars"))


@query(
    "latest_docs_tombstones",
    """SELECT id, seq FROM (SELECT DISTINCT ON (conv_id) conv_id AS id, turn AS seq, role = 'assistant' AND length(text) % 3 = 0 AS deleted FROM conversations ORDER BY conv_id, turn DESC) WHERE NOT deleted""",
)
def latest_docs_tombstones(spark, sf):
    c = tb.table(spark, sf, "conversations")
    gone = (F.col("role") == "assistant") & (F.pmod(F.length("text"), F.lit(3)) == 0)
    log = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), gone.alias("deleted"))
    return dc.latest(log).select("id", "seq")


@query(
    "news_dedupe",
    f"""WITH {tb.NEWS} SELECT DISTINCT ON (lower(trim(title, ' '))) position, title, url, source FROM news WHERE trim(title, ' ') <> '' AND url IS NOT NULL ORDER BY lower(trim(title, ' ')), position""",
)
def news_dedupe(spark, sf):
    return dc.headlines(tb.news(spark, sf)).select("position", "title", "url", "source")


@query(
    "news_top",
    f"""WITH {tb.NEWS}, k AS (SELECT DISTINCT ON (lower(trim(title, ' '))) position, title FROM news WHERE trim(title, ' ') <> '' AND url IS NOT NULL ORDER BY lower(trim(title, ' ')), position)
    SELECT * FROM k ORDER BY position LIMIT 20""",
)
def news_top(spark, sf):
    """Top-k report: the first 20 headlines (50 are asked for, 20 is the cap)."""
    return dc.headlines(tb.news(spark, sf), 50).select("position", "title")


@query(
    "json_props",
    """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value) / 9.9991, 4) AS value FROM events GROUP BY ALL""",
)
def json_props(spark, sf):
    e = tb.table(spark, sf, "events").withColumn("p", F.from_json("props", "k BIGINT"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value") / 9.9991, 4, "value"))
