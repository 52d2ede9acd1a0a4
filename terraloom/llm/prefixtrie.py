"""Conversation prefix trie: sizes of shared prefixes by an Euler tour.

Rebuilding: turns are numbered inside each conversation and conversation c takes its first turns from
conversation c - c % 20, as many as crc32(decimal c) % 4 says, and the others from itself.

Nodes: a prefix of d turns is named by d and the exclusive or of hashes (SHA-256, 120 bits) of the pairs
(place, turn). Such names come from running sums, so that a conversation of any length is cut into slices of its
places; the parent's name is the name without the last turn's hash. A node's members are counted with partial
aggregates, however many share it.

Euler tour: each node has an enter and an exit arc. After enter(v) comes the enter arc of v's first child, or
exit(v); after exit(v) the enter arc of the next sibling, or the parent's exit arc. Siblings are ordered by
slices of a hash, so that a node with very many children is linked slice by slice. Runs of nodes with a single
child (a conversation's own end, mostly) are first put together into one pair of arcs that weighs as many.

List ranking: pointers are doubled until they meet one of every ``SPACING``-th arcs (by hash), then doubled among
these alone, whose list is that much shorter, so the long list is read a few times and not once for each of its
binary digits. A pointer has one predecessor at most, so these joins have no hot key. Every round is a written table.

Subtrees: the rank is the arc's position. Sums over a subtree are differences of prefix sums at the positions of
its exit and enter arcs; positions are dense, so the prefix sums are added up in three levels of equal slices.

The digest of a node's ending conversations is sequential by definition: their ids are sorted by range
partitioning and joined into pieces of ``PIECE`` ids, and the pieces go through SHA-256 one after another as a stream;
a task holds one piece at a time.

Defined results: a null role or text is empty, a null turn comes first, turns of one number come in the order of a
digest of role and text, repeated rows are turns of their own; rows without a conv_id are no conversation; an empty table
gives no rows (no root either); other columns are ignored. c % 20 has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored

GROUP = 20
MOST_SHARED = 3
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BITS = 12
SPACING = 16
PIECE = 4096
KEY = ["depth", "k1", "k2"]
UPTO = (Window.unboundedPreceding, 0)


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits."""
    hexa = F.sha2(text, 256)
    return tuple(F.conv(F.substring(hexa, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def _running(per: DataFrame, keys: list[str], slice_: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, slice, sums): what lies before each slice but the first of its key."""
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(slice_))
    return per.select(*keys, slice_, *[c.over(before).alias(n) for n, c in sums.items()], at.alias("_at")).filter("_at > 1").drop("_at")


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words) of every turn, pos from 1."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256).alias("digest"),
        F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("no"),
    ).filter("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("no")]
    cut = stored(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "sorted")
    before = _running(cut.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n")), ["conv_id"], "slice", {"before": F.sum("n")})
    at = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order[1:]))
    placed = cut.withColumn("at", at).join(before, ["conv_id", "slice"], "left")
    return stored(placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, size) and their turns (conv_id, depth, digest, words, size)."""
    lengths = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("bigint")
    own = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), shared.alias("h"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n", "base_n"), "conversations")
    later = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words", "size")
    heads = turns.filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv_id", "base")
    first = heads.join(convs, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "words", "size")
    return convs.select("conv_id", "size"), later.unionByName(first)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, size): the names of each prefix and of its parent."""
    t1, t2 = _hashes(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    cut = stored(turns.select("conv_id", "depth", "words", "size", t1.alias("t1"), t2.alias("t2"), F.shiftright("depth", SLICE_BITS).alias("slice")), "turns")
    per = cut.groupBy("conv_id", "slice").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = _running(per, ["conv_id"], "slice", {"b1": F.bit_xor("s1"), "b2": F.bit_xor("s2")})
    w = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(*UPTO)
    inner = cut.withColumns({"x1": F.bit_xor("t1").over(w), "x2": F.bit_xor("t2").over(w)}).join(before, ["conv_id", "slice"], "left")
    k1, k2 = (F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2))
    out = inner.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), "t1", "t2", "words", "size")
    return stored(out.select("*", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2")).drop("t1", "t2"), "prefixes")


def _nodes(convs: DataFrame, named: DataFrame) -> DataFrame:
    """(node, depth, k1, k2, p1, p2, conv_id, n_convs, words), a row for each node, the root included."""
    inner = named.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.groupBy(zero.alias("depth"), zero.alias("k1"), zero.alias("k2")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = inner.unionByName(root.select("*", none.alias("p1"), none.alias("p2"), zero.alias("words")))
    return stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _parents(nodes: DataFrame) -> DataFrame:
    """(node, parent, parent_conv_id) of every node but the root."""
    up = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("depth > 0").select("node", (F.col("depth") - 1).alias("d"), "p1", "p2")
    return stored(below.join(up, ["d", "p1", "p2"]).select("node", "parent", "parent_conv_id"), "parents")


def _chains(nodes: DataFrame) -> DataFrame:
    """(node, parent, chain, place, length): runs of nodes whose parent has one child and the same smallest
    member. A chain is named by its top node; place counts from 0."""
    only = F.coalesce("parent_children", F.lit(0)) == 1
    w = Window.partitionBy("conv_id", F.shiftright("depth", SLICE_BITS)).orderBy("depth")
    goes_on = only & F.coalesce(F.col("parent_conv_id") == F.col("conv_id"), F.lit(False)) & F.lag("node").over(w).isNotNull()
    tops = nodes.withColumn("top", F.when(~goes_on, F.col("node")))
    placed = tops.withColumn("chain", F.last("top", ignorenulls=True).over(w.rowsBetween(*UPTO)))
    own = Window.partitionBy("conv_id", F.shiftright("depth", SLICE_BITS), "chain")
    return stored(placed.select(
        "node", "parent", "chain", (F.row_number().over(own.orderBy("depth")) - 1).alias("place"), F.count(F.lit(1)).over(own).alias("length")
    ), "chains")


def _arcs(chains: DataFrame) -> DataFrame:
    """(id, next, dist): the tour's arcs, 2 * chain to enter and 2 * chain + 1 to leave, and their weights."""
    tops = chains.filter("node = chain").select("chain", "parent", "length")
    above = chains.select(F.col("node").alias("parent"), F.col("chain").alias("above"))
    tops = stored(tops.join(above, "parent", "left").select("chain", "above", "length"), "tops")
    slices = max(1, int(tops.count() ** 0.5))
    sib = tops.filter("above IS NOT NULL").select("chain", "above", F.pmod(F.xxhash64("chain"), F.lit(slices)).alias("slice"))
    after = F.lead("chain").over(Window.partitionBy("above", "slice").orderBy("chain"))
    firsts = sib.groupBy("above", "slice").agg(F.min("chain").alias("first"))
    later = firsts.select("above", "slice", F.lead("first").over(Window.partitionBy("above").orderBy("slice")).alias("next_first"))
    nexts = sib.withColumn("after", after).join(later, ["above", "slice"]).select("chain", F.coalesce("after", "next_first").alias("sibling"))
    child = firsts.groupBy("above").agg(F.min(F.struct("slice", "first")).getField("first").alias("child")).withColumnRenamed("above", "chain")
    full = tops.join(nexts, "chain", "left").join(child, "chain", "left")
    enter = full.select((F.col("chain") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("chain") * 2 + 1).alias("next"), F.col("length").alias("dist"))
    leave = full.select((F.col("chain") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("above") * 2 + 1).alias("next"), F.col("length").alias("dist"))
    return stored(enter.unionByName(leave), "arcs")


def _follow(arcs: DataFrame, until: Column) -> DataFrame:
    """Doubles pointers until each is null or holds ``until``; dist adds up what was passed."""
    while True:
        moves = F.col("next").isNotNull() & ~until
        if arcs.filter(moves).isEmpty():
            return arcs
        there = arcs.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"))
        moved = arcs.filter(moves).join(there, "next").select("id", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"))
        arcs = stored(moved.unionByName(arcs.filter(~moves)), "ranking")


def ranks(arcs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(id, dist): the weights from each arc to the end of the list, both included, of arcs (id, next, dist) with
    their own weights."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(spacing)) == 0
    near = _follow(arcs, mark("next"))
    marks = stored(near.filter(mark("id")), "marks")
    far = _follow(marks, F.lit(False)).select(F.col("id").alias("next"), F.col("dist").alias("rest"))
    return near.join(far, "next", "left").select("id", (F.col("dist") + F.coalesce("rest", F.lit(0))).alias("dist"))


def prefix_sums(points: DataFrame, values: list[str], bits: int = SLICE_BITS) -> DataFrame:
    """``points`` (pos, values, ...) with the sums of the values up to each pos, itself included. Positions are
    different and dense, so that slices of them are small."""
    upto = lambda w: {v: F.sum(v).over(w.rowsBetween(*UPTO)) for v in values}
    cut = points.withColumns({"s1": F.shiftright("pos", bits), "s2": F.shiftright("pos", 2 * bits)})
    one = cut.groupBy("s2", "s1").agg(*[F.sum(v).alias(v) for v in values])
    two = one.groupBy("s2").agg(*[F.sum(v).alias(v) for v in values])
    total = Window.orderBy("s2")  # a row for each 2^24 positions
    two = two.select("s2", *[(F.sum(v).over(total.rowsBetween(*UPTO)) - F.col(v)).alias(f"{v}_2") for v in values])
    inside = Window.partitionBy("s2").orderBy("s1").rowsBetween(*UPTO)
    one = one.select("s2", "s1", *[(F.sum(v).over(inside) - F.col(v)).alias(f"{v}_1") for v in values])
    out = cut.withColumns(upto(Window.partitionBy("s2", "s1").orderBy("pos"))).join(one, ["s2", "s1"]).join(two, "s2")
    return out.withColumns({v: F.col(v) + F.col(f"{v}_1") + F.col(f"{v}_2") for v in values}).select(points.columns)


def _subtrees(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from prefix sums at the positions of the arcs."""
    dist = stored(ranks(_arcs(chains)), "ranks")
    size = 2 * nodes.count()
    start = dist.select(F.expr("shiftright(id, 1)").alias("chain"), (F.col("id") % 2).alias("side"), (F.lit(size) - F.col("dist")).alias("start"))
    values = nodes.select("node", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sides = chains.join(values, "node").withColumn("side", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    enters = F.col("side") == 0
    points = sides.join(start, ["chain", "side"]).select(
        "node", "side", F.when(enters, F.col("start") + F.col("place")).otherwise(F.col("start") + F.col("length") - 1 - F.col("place")).alias("pos"),
        F.when(enters, F.col("leaves")).otherwise(0).alias("leaves"), F.when(enters, F.col("saved")).otherwise(0).alias("saved"),
        F.when(enters, F.col("leaves")).otherwise(0).alias("own_leaves"), F.when(enters, F.col("saved")).otherwise(0).alias("own_saved"),
    )
    summed = prefix_sums(stored(points, "positions"), ["leaves", "saved"])
    total = lambda v: F.sum(F.when(enters, F.col(f"own_{v}") - F.col(v)).otherwise(F.col(v)))
    return summed.groupBy("node").agg(total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) to (depth, k1, k2, first, ids): up to PIECE ids of one node, comma-joined."""
    names, kinds = [*KEY, "first", "ids"], [pa.int64()] * 4 + [pa.string()]
    key, ids, done = None, [], []

    def close() -> None:
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for *k, conv in zip(*(c.to_pylist() for c in b.columns)):
            if k != key or len(ids) == PIECE:
                close()
                key = k
            ids.append(conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (depth, k1, k2, ends_sha256)."""
    names, kinds = [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
    key, state, done = None, None, []
    for b in batches:
        for *k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
            if k != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*key, state.hexdigest())]), kinds)], names=names)


def _ends(convs: DataFrame, named: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where a conversation ends."""
    zero = F.lit(0).cast("bigint")
    at = named.filter("depth = size").select("depth", "k1", "k2", "conv_id").unionByName(
        convs.filter("size = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    )
    order = [*KEY, "conv_id"]
    pieces = at.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    per_node = stored(pieces, "pieces").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return per_node.mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    convs, turns = rebuilt(numbered(conversations, conv_id, turn, role, text))
    named = prefixes(turns)
    nodes = _nodes(convs, named)
    parents = _parents(nodes)
    counts = stored(parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")), "children")
    own = nodes.join(parents, "node", "left").join(counts.withColumnRenamed("n_children", "parent_children"), "parent", "left")
    own = own.join(counts.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stored(own, "family")
    out = own.join(_subtrees(own, _chains(own)), "node").join(_ends(convs, named), KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
