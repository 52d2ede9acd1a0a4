"""The corpus queries, one for each numbered operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import decontaminate, exactdedup, extendible, langmodel, maintext, mixing, passages, prefixtrie, quality, simhash, tokencount, toxicity, whitening
from terraloom.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op7_benchmark_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN iw USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHARD_BYTES = 1 << 20


@query("op3_extendible_shards", f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT doc_id, n, h, depth, h >> (60 - depth) AS p FROM d, (SELECT unnest(range(0, 61))::INT AS depth)),
s AS (SELECT depth, p, sum(n) AS b, count(*) AS c FROM lv GROUP BY depth, p),
leaf AS (SELECT doc_id, n, h, min(depth) AS depth FROM lv JOIN s USING (depth, p) WHERE b <= {SHARD_BYTES} OR c = 1 GROUP BY doc_id, n, h)
SELECT doc_id, n AS n_bytes, depth, CASE WHEN depth = 0 THEN 'all' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard FROM leaf
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of one MiB: the unit that a training loader fetches and shuffles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("_size"), extendible.hash60("doc_id").alias("_h"))
    out = extendible.assign(stored(docs, "sizes"), SHARD_BYTES)
    return out.select("doc_id", F.col("_size").alias("n_bytes"), F.col("_depth").alias("depth"), extendible.bucket_name().alias("shard"))


_SQL_SPACE = r"'[\x20\x09-\x0D]+'"


@query("op4_exact_dedup", f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SQL_SPACE}, ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op8_source_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s),
c AS (SELECT k, 3 * source_size / w AS r, (SELECT sum(source_size) FROM s)::DOUBLE AS total,
             (sum(3 * source_size) OVER (ORDER BY k) - 3 * source_size)::DOUBLE AS fixed, sum(w) OVER () - sum(w) OVER (ORDER BY k) + w AS free FROM o),
l AS (SELECT (total - fixed) / free AS level FROM c WHERE (total - fixed) / free <= r ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(w * (SELECT level FROM l), (3 * source_size)::DOUBLE) AS target FROM s),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(round(target) / source_size) END::BIGINT AS whole FROM t),
h AS (SELECT *, round(target)::BIGINT - whole * source_size AS rest FROM g),
un AS (SELECT source, u, doc_id, sum(size)::BIGINT AS unit FROM d GROUP BY ALL),
st AS (SELECT source, u, doc_id, unit, (sum(unit) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) - unit)::BIGINT AS start FROM un),
p AS (SELECT st.source, st.doc_id, CASE WHEN unit > 0 THEN least(greatest((rest - start) / unit, 0.0), 1.0) ELSE 0.0 END AS part FROM st JOIN h ON st.source IS NOT DISTINCT FROM h.source)
SELECT d.doc_id, d.size, h.source_size, h.target, (whole * size + round(part * size))::BIGINT AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.doc_id IS NOT DISTINCT FROM p.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(table(spark, sf_dir, "pages"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


@query("op11_lm_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.scores(table(spark, sf_dir, "documents"))


# the CRC-32 of the decimal id, bit by bit, as the engine has no such function
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, g, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t),
l AS (SELECT conv_id, count(*) AS n FROM n GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % {prefixtrie.GROUP} AS base, ({_CRC32} % {prefixtrie.MOST_SHARED + 1})::BIGINT AS h FROM l),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(l.n, 0)) AS taken FROM c LEFT JOIN l ON l.conv_id = c.base),
r AS (SELECT k.conv_id, n.pos AS depth, g, words FROM k JOIN n ON n.conv_id = k.base AND n.pos <= k.taken
      UNION ALL SELECT k.conv_id, taken + n.pos - h, g, words FROM k JOIN n ON n.conv_id = k.conv_id AND n.pos > h),
p AS (SELECT conv_id, depth, words, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
v AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY name, depth),
e AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(name) AS name FROM p GROUP BY conv_id) GROUP BY name),
u AS (SELECT left(name, 64 * (depth - 1)) AS name, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(u.n, 0) AS n_children FROM v LEFT JOIN u USING (name)),
s AS (SELECT left(name, 64 * a) AS name, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved
      FROM (SELECT name, n_children, n_convs, words, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (name) LEFT JOIN e USING (name) LEFT JOIN v q ON f.depth > 0 AND q.name = left(f.name, 64 * (f.depth - 1))
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
