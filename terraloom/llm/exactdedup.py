"""Exact duplicates through an extendible-hash index on files of the shared folder.

1. Index entries: every row's 64-bit hash, SHA-256 and length of the normalised text (each run of
   white space becomes one space), written once. Texts stay where they are.
2. Chains: entries are counted by (hash, SHA-256) with partial aggregates, so a group of copies is
   one chain, whatever its size. Rows of one-row chains are done.
3. Directory: the other chains are spread over buckets by hash prefix; only buckets that hold more
   text than ``BUCKET_BYTES`` are split on another bit (``extendible.assign``). A chain that is larger
   itself gets overflow pages, and its rows are dealt to them by their id.
4. Owner tasks: a task owns whole buckets and pages, that is, ranges of the hash. It gets the rows of
   their chains and one head text for each chain and page, and compares every text with the
   heads byte by byte. A text that equals no head (a collision of both hashes) opens a new place in
   the chain; such texts are then grouped by their bytes.

Defined results: null counts as empty; the smallest non-null doc_id of equal texts stays (null if
all are null); rows that repeat the staying id are all marked as kept; leading and trailing white
space is one space, not removed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import SPACE, stored
from terraloom.llm.extendible import assign

BUCKET_BYTES = 16 << 20


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def _sha(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _compare(rows: pa.Table) -> pa.Table:
    """One bucket or page: each row's place in its chain, 0 if it equals the chain's head."""
    heads: dict[tuple[int, str], bytes] = {}
    h, sha, head, norm = (rows.column(c) for c in ("h", "sha", "is_head", "norm"))
    places: list[bool | None] = [None] * len(rows)
    texts = norm.cast(pa.binary())
    for i in range(len(rows)):
        if head[i].as_py():
            heads[h[i].as_py(), sha[i].as_py()] = texts[i].as_py()
    for i in range(len(rows)):
        if not head[i].as_py():
            places[i] = texts[i].as_py() == heads[h[i].as_py(), sha[i].as_py()]
    keep = pa.array([p is not None for p in places])
    same = pa.array(places, pa.bool_())
    other = pa.compute.if_else(pa.compute.fill_null(same, True), pa.scalar(None, pa.string()), norm.combine_chunks())
    out = pa.table([rows.column("doc_id"), h, sha, rows.column("head_id"), rows.column("rows"), same, other], names=["doc_id", "h", "sha", "head_id", "rows", "same", "other"])
    return out.filter(keep)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    norm = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), normalised(text).alias("norm"))
    hashed = norm.select("doc_id", _hash(F.col("norm")).alias("h"), _sha(F.col("norm")).alias("sha"), "norm")
    entries = stored(hashed.select("doc_id", "h", "sha", F.octet_length("norm").cast("bigint").alias("n")), "entries")
    chains = stored(entries.groupBy("h", "sha").agg(F.min("doc_id").alias("head_id"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")), "chains")
    single = chains.filter("rows = 1").select("sha", F.col("head_id").alias("doc_id"), F.col("head_id").alias("keep_id"), "rows")

    pages = F.least(F.greatest(F.ceil(F.col("rows") * F.col("n") / bucket_bytes), F.lit(1)), "rows")  # a head each: no more text than the rows have
    several = chains.filter("rows > 1").withColumns({
        "_h": F.shiftrightunsigned("h", 4), "_size": F.least(F.col("rows") * F.col("n"), F.lit(bucket_bytes)), "pages": pages,
    })
    directory = assign(several, bucket_bytes).select("h", "sha", "head_id", "rows", "pages", "_depth", "_prefix")
    # merge: the texts move at every size of the directory, so that the plan does not change with the input
    found = hashed.join(directory.hint("merge"), ["h", "sha"])
    page = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), "pages").alias("page")
    chained = stored(found.select("doc_id", "h", "sha", "norm", "head_id", "rows", "_depth", "_prefix", "pages", page), "chained")
    heads = chained.groupBy("h", "sha", "_depth", "_prefix", "pages").agg(F.min("norm").alias("norm"))
    copies = heads.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    nothing = F.lit(None).cast("bigint")
    members = chained.select("doc_id", "h", "sha", "norm", "head_id", "rows", "_depth", "_prefix", "page", F.lit(False).alias("is_head")).unionByName(
        copies.select(nothing.alias("doc_id"), "h", "sha", "norm", nothing.alias("head_id"), nothing.alias("rows"), "_depth", "_prefix", "page", F.lit(True).alias("is_head"))
    )
    schema = "doc_id bigint, h bigint, sha string, head_id bigint, rows bigint, same boolean, other string"
    judged = stored(members.groupBy("_depth", "_prefix", "page").applyInArrow(_compare, schema), "judged")
    broken = judged.filter("NOT same").select("h", "sha").distinct()
    parts = [single.select("doc_id", "keep_id", "rows", "sha")]
    if broken.limit(1).count() == 0:
        parts.append(judged.select("doc_id", F.col("head_id").alias("keep_id"), "rows", "sha"))
    else:
        whole = judged.join(broken, ["h", "sha"], "left_anti")
        parts.append(whole.select("doc_id", F.col("head_id").alias("keep_id"), "rows", "sha"))
        split = judged.join(broken, ["h", "sha"]).withColumn("place", F.coalesce(F.concat(F.lit("+"), "other"), F.lit("")))
        groups = split.groupBy("h", "sha", "place").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
        parts.append(split.drop("rows").join(groups, ["h", "sha", "place"]).select("doc_id", "keep_id", "rows", "sha"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "doc_id", "keep_id", F.col("rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
