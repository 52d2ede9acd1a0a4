"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: a text's words are lower-cased (A-Z) and cut at white space; every shingle of
three words, repeats included, is hashed with XXH64 (seed 42); a bit of the fingerprint is set
if more than half of the hashes set it.

Links: two fingerprints link at ``RADIUS`` = 3 or fewer differing bits. The radius is split
between the two ends of a link. A pair that differs in one or two bits meets in a variant within
one bit of both. A pair that differs in three bits has one end of odd parity, and two of the three
bits lie in the same half of the word: the odd end also emits its variants with two bits of one
half flipped, and meets the other end's one-bit variant. So a fingerprint emits 65 variants, 1057
if its parity is odd. All who meet in a variant that some member reaches with one flip are within
three bits of that member: they are linked to it as a star, never pair by pair, and a variant is
met by at most 1057 different fingerprints.

Before that, the same idea on half words sets aside fingerprints that cannot have a neighbour: of
two linked fingerprints one half differs in at most one bit, so halves (and, from the side of odd
parity, their one-bit variants) must meet. Only fingerprints that meet another one there go on.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal
fingerprints are one node, however many rows have it; the component id is the smallest non-null
doc_id of the component (null if all are null); rows with the same doc_id are kept as they are;
an empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import free_name, stored, utf8
from terraloom.llm.components import components

RADIUS = 3
SEED = 42
BLOCK = 1 << 16  # shingles whose bits are counted at once, so that a long text needs no more memory

ONE_BIT = [1 << i for i in range(63)] + [-(1 << 63)]
TWO_BITS = [ONE_BIT[i] ^ ONE_BIT[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed integer."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[width - 1 :] or ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(last), BLOCK):
        hashes = [digest(line[s : e - 1], SEED) for s, e in zip(starts[k:], last[k : k + BLOCK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * counts > len(last), bitorder="little").view("<i8")[0])
    return value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = pa.array([fingerprint(t) for t in utf8(b.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), prints], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _with_near_halves(fps: DataFrame) -> DataFrame:
    """Fingerprints of which one half meets another fingerprint's half within one bit."""
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")),
    )).alias("h")).select("fp", "h.*")
    odd = F.bit_count("half") % 2 == 1
    keys = halves.select("fp", "side", "half", F.explode(F.when(odd, _longs([0, *ONE_BIT[:32]])).otherwise(_longs([0]))).alias("flip")).select(
        "fp", F.col("half").bitwiseXOR(F.col("flip")).bitwiseOR(F.shiftleft(F.col("side").cast("bigint"), 32)).alias("key")
    ).repartition("key")  # one exchange for the minima and for the join with them
    met = keys.groupBy("key").agg(F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).filter("_lo < _hi").select("key")
    return keys.join(met, "key").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints at distance 3 or less whose components are
    those of all such pairs. ``fps`` has one column ``fp`` of distinct values."""
    live = stored(_with_near_halves(fps), "live")
    near = [0, *ONE_BIT]
    variants = live.select("fp", F.explode(
        F.when(F.bit_count("fp") % 2 == 1, _longs([*near, *TWO_BITS])).otherwise(_longs(near))
    ).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), (F.bit_count("flip") <= 1).alias("close"))
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("variant"))
    met = variants.withColumn("hub", hub).filter("hub != fp").select(F.greatest("hub", "fp").alias("a"), F.least("hub", "fp").alias("b")).distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _labels(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    joined = nodes.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    return prints.join(_labels(prints).drop("root"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each component does: the
    one with the smallest doc_id. Of rows of the component that repeat this id one stays; a row without an id stays only
    if no row of its component has one, and then one such row does."""
    prints = stored(fingerprints(docs), "fingerprints")
    labels = stored(_labels(prints), "labels")
    own = prints.join(labels, "fp").filter("doc_id = component_id")
    stay = stored(own.groupBy("root", "doc_id").agg(F.min("fp").alias("fp")), "stay")
    no = free_name(docs, "row_number")
    kept = docs.join(stay, "doc_id", "left_semi")
    often = stored(prints.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id").join(stay, "doc_id", "left_semi"), "repeated")
    if not often.isEmpty():  # the id alone does not tell which row: its fingerprint does
        numbered = stored(kept.join(often, "doc_id", "left_semi").withColumn(no, F.monotonically_increasing_id()), "numbered")
        marks = fingerprints(numbered, no).select(F.col("doc_id").alias(no), "fp").join(numbered.select(no, "doc_id"), no)
        one = marks.join(stay, ["doc_id", "fp"]).groupBy("doc_id", "fp").agg(F.min(no).alias(no)).select(no)
        kept = kept.join(often, "doc_id", "left_anti").select(docs.columns).unionByName(numbered.join(one, no, "left_semi").select(docs.columns))
    if prints.filter("doc_id IS NULL").limit(1).count() == 0:
        return kept.select(docs.columns)
    unnamed = labels.filter("component_id IS NULL").groupBy("root").agg(F.min("fp").alias("fp")).select("fp")
    nameless = docs.filter("doc_id IS NULL").withColumn(no, F.monotonically_increasing_id())
    firsts = fingerprints(nameless, no).join(unnamed, "fp").groupBy("fp").agg(F.min("doc_id").alias(no)).select(no)
    return kept.select(docs.columns).unionByName(nameless.join(firsts, no, "left_semi").select(docs.columns))


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
