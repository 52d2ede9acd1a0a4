"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles (words lower-cased from A to Z, cut at white space). A
passage is a run of at least ``LEAST`` shingles, that is, of 50 words or more. Two passages are
near-duplicates if the Jaccard similarity of their shingle sets is ``SIMILARITY`` or more.

Min-hashes of all passages of a text are held as compact windows: under one hash function, the shingle with the
smallest hash of a passage is the top of a Cartesian tree over the text, and all passages that share it form a
rectangle of starts (l to lo) and ends (hi to r). Where the rectangles of two functions meet, both min-hashes are
known for all passages in the overlap; such an overlap is a region, its key the hash of both. Passages of similarity
s have equal keys under one of ``BANDS`` pairs of functions with probability 1 - (1 - s^2)^4, 0.98 at 0.8. Regions of
longer passages only are left out: of two long near-duplicates some part of ``LEAST`` shingles is about as
similar as the whole, and each part of that length is in a region.

1. Texts that are equal are folded: the smallest id stands for all of them, the others are linked to it.
2. The regions of all texts are found, and those kept whose key different documents share.
3. Regions of a key whose passages of ``LEAST`` shingles are the same ones, word for word, are a class; the smallest id
   stands for it, the others are linked to it.
4. Join: of a key of up to ``FEW`` classes all pairs of classes are candidates, so it is done. At later levels that bound is
   raised, to ``MOST`` at most, as long as the pairs of all keys up to it are no more than ``ALL`` or the candidates of level 0. In a key of more, each class is linked to few heads. The links of a pair of documents are joined into one candidate with the hull of the places.
5. Verification: the shingles around both hulls are compared, the matching stretches cut out and kept if they
   are near-duplicates.
6. In a key of more than that bound, verified passages connect the classes they cover on both sides; what is connected is a
   part of the key. A head was compared with all other parts and leaves. A key that has one part then is done. All classes of
   the others are open: their regions are cut once more, by the rectangles of one further function, and go through 2 to 6 with
   keys that have one min-hash more and with other heads, until no key has two parts. Their part goes with them, and classes of
   one part are not compared again; a key counts by the pairs of classes in different parts.

A line that very many documents share brings them under one key at first, but not all their passages have
the smallest hash of each further function inside the line: what only the line connects comes apart at
every level, until its keys have few classes. A pair of near-duplicates stays together with its similarity s as the
probability; at the first ``FORKED`` levels two functions cut independently, which makes it 1 - (1 - s)^2. No key is given up or cut, and
no class leaves a key while it may be near one that it is not connected with.

Only texts with candidates are read for verification: a bitmap of fixed size (``BITMAP`` bits) says which
may have any; as it fills up more texts are read, none is lost. ``REACH`` shingles to either side of the hull are
compared, so a passage that goes on for longer without another shared region is linked in parts. Of more than ``PAIRS``
candidates, those with near partners in common are compared in one block of bounded size, to which a text is sent once.

A passage may have changed words at its edges: a stretch of equal shingles that is a little short of ``LEAST`` grows over
unequal shingles as long as the similarity holds. So texts that have 45 words in a row in common (41 shingles) and go on
have near-duplicate passages of 50 words (41 equal shingles of 51 in all); with 44 words they have none.

Defined results: rows without an id cannot be named and are not compared; texts below 50 words have no
passage; rows that repeat a doc_id are not compared with each other; a null text has none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored, utf8

SHINGLE = 5
LEAST = 46
SIMILARITY = 0.8
BANDS = 4
FIRST = 2  # functions of a band at level 0; each further level adds one
FEW = 32  # classes of a key that are compared pair by pair, at least
ALL = 100_000  # pairs of classes of a later level up to which that bound is raised; or as many as level 0 compared
MOST = 2048  # no key of more classes is compared pair by pair
FORKED = 2  # levels at which two further functions cut a region, each for itself
HEADS = 8  # most heads of a key of more classes; there are 1, 2, 4, 8, 8, ... from level to level
REACH = 1024  # shingles around the shared places that are compared
ROOM = 1 << 19  # shingles of the smaller ids, and of the others, that a block may hold; a longer text stands alone
PAIRS = 10_000  # candidates of a level that are compared without sharing texts
HUB = 256  # pairs of a document with larger ids from which it gathers no pairs of others
BROADCAST_ROWS = 1_000_000
BITMAP = 1 << 22
BATCH = 50_000  # shingles whose windows are found at once
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"

Regions = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, l, lo, hi, r


def rehash(hashes: np.ndarray, function: int) -> np.ndarray:
    """The hash function of that number, applied to 64-bit hashes (the SplitMix64 finaliser)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (function + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A number for each byte: 0 for white space, the same for a letter from A to Z and its lower case."""
    out = rehash(np.arange(256, dtype=np.uint64), 0)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


LETTERS = _letters()
STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the 64-bit numbers
PIECE = 1 << 18  # bytes of a text whose words are hashed at once
GAP = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of STEP and of its inverse."""
    def upto(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return upto(STEP), upto(pow(STEP, -1, 1 << 64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order: a polynomial in STEP over the letters' numbers. All words of a piece are summed
    in one pass, each at its place in the piece, and moved to the first place by the inverse powers."""
    out, at = [], 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        value = LETTERS[np.frombuffer(text, np.uint8, end - at, at)]
        turns = np.flatnonzero(np.diff(np.concatenate(([False], value != 0, [False]))))
        if len(turns):
            size = 1 << (end - at - 1).bit_length()
            power, inverse = _powers(max(size, 1 << 12))
            value *= power[: len(value)]
            out.append(np.add.reduceat(value, turns[::2]) * inverse[turns[::2]])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the five-word shingles, in order."""
    each = word_hashes(text)
    n = len(each) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = rehash(each, 0)
    out = each[:n].copy()
    for k in range(1, SHINGLE):
        out *= np.uint64(STEP)
        out += each[k : k + n]
    return rehash(out, 1)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest value of each run of that width, by doubling."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[:n], x[width - k : width - k + n])


def _next_smaller(value: np.ndarray) -> np.ndarray:
    """For each value the place of the next one below it, or the length. Minima of runs of doubling length are skipped, the
    longest first; no run goes on beyond a 0. What a 0 itself gets is not used."""
    zeros = np.concatenate(([-1], np.flatnonzero(value == 0), [len(value)]))
    low = [np.append(value, np.uint64(0))]
    for k in range(int(np.diff(zeros).max()).bit_length() - 1):
        low.append(np.zeros_like(low[-1]))
        np.minimum(low[-2][: -1 << k], low[-2][1 << k :], out=low[-1][: -1 << k])
    at = np.arange(1, len(value) + 1)
    own = np.maximum(value, np.uint64(1))
    for k in reversed(range(len(low))):
        at += (low[k][at] >= own).astype(np.int64) << k
    return at


def compact_windows(hashes: np.ndarray, least: int = LEAST) -> Regions:
    """(hash, l, lo, hi, r): every run i..j of ``least`` or more with l <= i <= lo and hi <= j <= r has that smallest hash.

    Only the smallest hash of some run of exactly ``least`` has a window, and so have the nearest smaller ones beside it:
    the tree is between these. Equal hashes at distances up to ``least`` share a row (lo is the
    last of them, hi the first); else lo is hi. A hash of 0 ends a text: no window holds one.
    """
    if len(hashes) < least:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    pad = np.zeros(least - 1, np.uint64)
    low = _sliding(hashes, least, np.minimum)
    at = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), least, np.maximum) == hashes)
    key = hashes[at]
    after, before = _next_smaller(key), len(key) - 1 - _next_smaller(key[::-1])[::-1]
    l = np.concatenate(([-1], at))[before + 1] + 1
    r = np.concatenate((at, [len(hashes)]))[after] - 1
    real = (key != 0) & (r - l + 1 >= least)
    key, l, at, r = key[real], l[real], at[real], r[real]
    order = np.lexsort((at, l, key))
    key, l, at, r = key[order], l[order], at[order], r[order]
    first = np.ones(len(at), bool)
    first[1:] = (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (np.diff(at) > least)
    start = np.flatnonzero(first)
    end = np.concatenate((start[1:], [len(at)]))[: len(start)] - 1
    order = np.argsort(at[start], kind="stable")
    start, end = start[order], end[order]
    return key[start], l[start], at[end], at[start], r[start]


def meet(regions: Regions, windows: Regions, least: int = LEAST) -> tuple[Regions, np.ndarray]:
    """The overlaps of regions with the windows of one more function that hold a run of exactly ``least``, and which region
    each is a part of.

    Windows come in the order of hi, so those within a region's reach are a range; no other pair is looked at."""
    key, l, lo, hi, r = regions
    key2, l2, lo2, hi2, r2 = windows
    reach = int((lo2 - hi2).max()) if len(key2) else 0
    a, b = np.searchsorted(hi2, l - reach), np.searchsorted(hi2, r, "right")
    counts = b - a
    i = np.repeat(np.arange(len(key)), counts)
    j = np.arange(counts.sum()) + np.repeat(a - np.cumsum(counts) + counts, counts)
    l, lo, hi, r = np.maximum(l[i], l2[j]), np.minimum(lo[i], lo2[j]), np.maximum(hi[i], hi2[j]), np.minimum(r[i], r2[j])
    some = np.flatnonzero((l <= lo) & (hi <= r) & (r - l + 1 >= least) & (hi - lo < least))
    return (rehash(key[i[some]], 0) + key2[j[some]], l[some], lo[some], hi[some], r[some]), i[some]


def functions(band: int, level: int) -> list[int]:
    """The numbers of a band's hash functions: ``FIRST`` of its own, and one more for each level. The bits of ``band // BANDS``
    say which of two it is at the first ``FORKED`` levels."""
    fork, own = divmod(band, BANDS)
    return [FIRST * own + k + 1 for k in range(FIRST)] + [FIRST * BANDS + BANDS * (2 * k + (fork >> k & 1)) + own + 1 for k in range(level)]


def regions(texts: list[np.ndarray], level: int = 0, parents: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first, last): the keys of all bands and the places of their shingles in the texts; with ``parents``, only
    parts of regions that had one of a text's parent keys a level before."""
    return classed_regions(texts, level, parents)[:4]


def classed_regions(texts: list[np.ndarray], level: int = 0, parents: list[np.ndarray] | None = None, parts: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """The columns of ``regions`` and a hash of all shingles of the region's passages of ``LEAST``, in order; with ``parts``,
    a number for each parent key, also that of the region's parent."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.concatenate((t, [np.uint64(0)])) for t in texts])
    ends = starts + sizes - 1
    power, inverse = _powers(max(1 << (len(flat) - 1).bit_length(), 1 << 12))
    upto = np.concatenate(([np.uint64(0)], np.cumsum(flat * power[: len(flat)])))
    if parents is not None:
        wanted = np.concatenate([rehash(p.view(np.uint64), 0) + np.uint64(t) for t, p in enumerate(parents)])
        order = np.argsort(wanted)
        wanted = wanted[order]
        numbers = np.concatenate(parts)[order] if parts is not None else np.zeros(len(wanted), np.int64)

    def windows(function: int) -> Regions:
        hashes = rehash(flat, function) | np.uint64(1)
        hashes[ends] = 0
        return compact_windows(hashes)

    out = []
    for band in range(BANDS << min(level, FORKED)):
        first, *more = functions(band, level)
        key, *place = windows(first)
        found = (key + np.uint64(band % BANDS), *place)
        part = np.zeros(len(key), np.int64)
        for k, f in enumerate(more):
            if parents is not None and k == len(more) - 1:
                text = np.searchsorted(starts, found[1], "right") - 1
                own = rehash(found[0], 0) + text.astype(np.uint64)
                held = _among(own, wanted, True)
                part = numbers[np.searchsorted(wanted, own[held])]
                found = tuple(c[held] for c in found)
            if not len(found[0]):
                part = part[:0]
                break
            found, at = meet(found, windows(f))
            part = part[at] if parents is not None and k == len(more) - 1 else np.zeros(len(at), np.int64)
        key, l, lo, hi, r = found
        text = np.searchsorted(starts, l, "right") - 1
        begin, end = np.maximum(l, hi - LEAST + 1), np.minimum(lo + LEAST - 1, r) + 1
        same = rehash((upto[end] - upto[begin]) * inverse[begin], 2)
        out.append((key, text, np.minimum(lo, hi) - starts[text], np.maximum(lo, hi) - starts[text], same, part))
    return tuple(np.concatenate(c) for c in zip(*out))


REGIONS = "key bigint, same bigint, doc bigint, l int, r int"
PARTS = REGIONS + ", part bigint"


def _regions(level: int = 0):
    """A step that makes rows of ``REGIONS`` from (doc, text), or at later levels of ``PARTS`` from (doc, seq, parents, parts)."""

    def batch(docs: list[int], texts: list[np.ndarray], above: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, text, first, last, same, part = classed_regions(texts, level, *zip(*above))
        arrays = [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(np.array(docs, np.int64)[text]), pa.array(first.astype(np.int32)), pa.array((last + 1).astype(np.int32))]
        names = ["key", "same", "doc", "l", "r"]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(part)], names=[*names, "part"]) if level else pa.RecordBatch.from_arrays(arrays, names=names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, above, size = [], [], [], 0
        for b in batches:
            rows = map(shingles, utf8(b.column(1))) if not level else (s.view(np.uint64) for s in _values(b.column(1)))
            for doc, seq, p in zip(b.column(0).to_pylist(), rows, zip(_values(b.column(2)), _values(b.column(3))) if level else [()] * len(b)):
                if len(seq) < LEAST:
                    continue
                docs.append(doc)
                texts.append(seq)
                above.append(p)
                size += len(seq)
                if size >= BATCH:
                    yield batch(docs, texts, above)
                    docs, texts, above, size = [], [], [], 0
        if docs:
            yield batch(docs, texts, above)

    return step


def _values(col: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists of numbers."""
    ends = np.asarray(col.offsets)
    flat = np.asarray(col.values)
    return [flat[ends[i] : ends[i + 1]] for i in range(len(col))]


def runs(match: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [s, e) of matches without a gap."""
    turns = np.flatnonzero(np.diff(np.concatenate(([False], match, [False])).astype(np.int8))).tolist()
    return list(zip(turns[::2], turns[1::2]))


SHARE = 2 * SIMILARITY / (1 + SIMILARITY)


def stretches(match: np.ndarray, share: float = SHARE) -> list[list[tuple[int, int]]]:
    """Runs put together as long as matches make up that share; equally long passages of that share
    are just similar enough."""
    out: list[list[tuple[int, int]]] = []
    held = 0
    for s, e in runs(match):
        if out and held + e - s >= share * (e - out[-1][0][0]):
            out[-1].append((s, e))
            held += e - s
        else:
            out.append([(s, e)])
            held = e - s
    return out


def _grown(a: np.ndarray, b: np.ndarray, p: int, q: int, s: int, e: int, least: int) -> tuple[int, int, int, int, float]:
    """The most similar pair of stretches that holds a[p:q] and b[s:e] and reaches ``least``, by as many shingles more on
    the left and the right as are missing; as it is where the texts do not go on."""
    best = (p, q, s, e, -1.0)
    for more in range(max(0, least - max(q - p, e - s)) + 1):
        left, right = more, max(0, least - max(q - p, e - s)) - more
        p2, q2, s2, e2 = p - left, q + right, s - left, e + right
        if p2 >= 0 and s2 >= 0 and q2 <= len(a) and e2 <= len(b):
            x, y = set(a[p2:q2].tolist()), set(b[s2:e2].tolist())
            best = max(best, (p2, q2, s2, e2, len(x & y) / len(x | y)), key=lambda f: f[4])
    return best


def _among(x: np.ndarray, y: np.ndarray, ordered: bool = False) -> np.ndarray:
    """Which values of x are in y."""
    if not len(y):
        return np.zeros(len(x), bool)
    y = y if ordered else np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def common_passages(a: np.ndarray, b: np.ndarray, least: int = LEAST, ordered: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate stretches (start and end in a, start and end in b, similarity) of two shingle sequences.

    A stretch that is a little short grows over unequal shingles at its edges. One that is not similar enough
    as a whole is split at its widest gap, down to single runs. ``ordered`` may hold the sorted values of a.
    """
    out = []
    match = _among(b, a) if ordered is None else _among(b, ordered, True)
    if np.count_nonzero(match) < SHARE * SIMILARITY * least - 1:  # no stretch can be long enough
        return out
    todo = stretches(match)
    while todo:
        parts = todo.pop()
        s, e = parts[0][0], parts[-1][1]
        if e - s < SIMILARITY * least:
            continue
        p, q = max(((x[0][0], x[-1][1]) for x in stretches(_among(a, b[s:e]))), key=lambda x: x[1] - x[0])
        found = _grown(a, b, p, q, s, e, least)
        if found[4] >= SIMILARITY:
            out.append(found)
        elif len(parts) > 1:
            cut = max(range(1, len(parts)), key=lambda k: parts[k][0] - parts[k - 1][1])
            todo += [parts[:cut], parts[cut:]]
    return out


PASSAGES = "doc_id bigint, start_word int, end_word int, other_doc_id bigint, other_start int, other_end int, similarity double"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of one block at a time are held, and its pairs compared as they come."""
    block, texts = None, {}
    for batch in batches:
        rows = []
        blocks, docs, others, *places = (batch.column(k).to_pylist() for k in range(7))
        seqs = _values(batch.column(7))
        for i, (at, a, b) in enumerate(zip(blocks, docs, others)):
            if at != block:
                block, texts = at, {}
            a_from, a_to, b_from, b_to = (p[i] for p in places)
            if b is None:
                texts.setdefault(a, []).append((a_from, seqs[i].copy(), np.sort(seqs[i])))
                continue
            for (a_at, x, ordered), (b_at, y, _) in product(texts.get(a, ()), texts.get(b, ())):  # of a repeated id each text
                part = x[a_from - a_at : a_to - a_at]
                for p, q, s, e, alike in common_passages(part, y[b_from - b_at : b_to - b_at], ordered=ordered if len(part) == len(x) else None):
                    rows.append((b, b_from + s, b_from + e + SHINGLE - 1, a, a_from + p, a_from + q + SHINGLE - 1, alike))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            once = dict.fromkeys(rows)  # of a repeated id with equal texts
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*once), kinds)], names=[f.split()[0] for f in PASSAGES.split(", ")])


def _written(df: DataFrame, label: str) -> DataFrame:
    """``stored``; what was exchanged for the table goes once it is written, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df, label)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits at the hashes of all ids. At most BITMAP / 64 numbers come to the driver."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(BITMAP))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out


def _sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, seq): the shingles of the documents that may be among ``ids``."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))  # BITMAP / 8 bytes, whatever the input

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            at = b.column(1).to_numpy()
            wanted = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            some = b.filter(pa.array(wanted.astype(bool)))
            seqs = pa.array([shingles(t).view(np.int64) for t in utf8(some.column(2))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), seqs], names=["doc", "seq"])

    bit = F.pmod(F.xxhash64("doc"), F.lit(BITMAP)).alias("bit")
    return docs.select("doc", bit, "text").mapInArrow(read, "doc bigint, seq array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """A written table of two numbers a row, to be broadcast if its count allows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _from(l: str, r: str) -> Column:
    """Where the compared part of a text begins whose shared places lie in l..r."""
    return F.greatest(F.lit(0), F.col(l) - REACH - 2 * (F.col(r) - F.col(l)))


def _upto(l: str, r: str) -> Column:
    """Where it ends, if the text goes on for that long."""
    return F.col(r) + REACH + 2 * (F.col(r) - F.col(l))


def _folded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stand for all equal texts, rows (doc, head, words) of the others)."""
    marked = docs.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    groups = marked.groupBy("_sha").agg(F.min("doc").alias("head"), F.max("doc").alias("_last")).filter("head < _last").select("_sha", "head")
    joined = marked.join(_small(_written(groups, "equal")), "_sha", "left")
    words = F.when(F.col("doc") != F.col("head"), F.regexp_count("text", F.lit(WORD)))  # named with the head: counted after the join only
    copies = joined.filter("doc != head").select("doc", "head", words.alias("words"))
    return joined.filter("head IS NULL OR doc = head").select("doc", "text"), copies.filter(F.col("words") >= LEAST + SHINGLE - 1)


OWN = "xxhash64(key, doc, l, r)"  # the number of a region


def _heads(classes: DataFrame, level: int) -> DataFrame:
    """(key, doc, l, r, part): the heads of each key, the first of its documents in as many orders."""
    orders = [F.xxhash64("doc", F.lit(level), F.lit(k)) for k in range(min(HEADS, 1 << level))] if level else [F.lit(0).cast("bigint")]
    first = [F.min(F.struct(o.alias("o"), "doc", "l", "r", "part")) for o in orders]
    found = classes.groupBy("key").agg(F.array(*first).alias("h"))
    return found.select("key", F.explode(F.array_distinct(F.transform("h", lambda h: h.dropFields("o")))).alias("h")).select("key", "h.*")


def _members(found: DataFrame) -> DataFrame:
    """(key, same, doc, l, r, part, c, first, others, n): the regions of keys that different documents and parts share, each with the region
    c that stands for its class, whether it is that one, the number of classes in other parts of its key, and how many classes
    would make as many pairs as its key has between parts. At level 0 a part is a class. All of it takes one exchange."""
    key, order = Window.partitionBy("key"), Window.partitionBy("key", "same").orderBy("doc", "l", "r")
    parted = "part" in found.columns
    several = found
    for c in ["doc", "part"][: 1 + parted]:
        several = several.withColumn(f"_lo_{c}", F.min(c).over(key)).withColumn(f"_hi_{c}", F.max(c).over(key))
    several = several.filter("_lo_doc < _hi_doc" + " AND _lo_part < _hi_part" * parted).select(found.columns)
    classed = several.withColumn("c", F.first(F.struct("doc", "l", "r", *["part"] * parted)).over(order)).withColumn("first", F.row_number().over(order) == 1)
    one = F.col("first").cast("int")
    if not parted:
        return classed.withColumn("n", F.sum(one).over(key))
    counted = classed.withColumn("_m", F.sum(one).over(Window.partitionBy("key", "part"))).withColumn("others", F.sum(one).over(key) - F.col("_m"))
    pairs = F.sum(one * F.col("others")).over(key)  # each twice
    return counted.withColumn("n", F.ceil((1 + F.sqrt(1 + 4 * pairs)) / 2)).drop("_m")


def _few(classes: DataFrame, most_pairs: int) -> tuple[int, bool]:
    """Up to how many classes of a key are compared pair by pair, and whether any key has more: as many as keep the pairs
    within ``most_pairs``, so that the last open classes need no level after level."""
    bounds = [b for b in (FEW << k for k in range(MOST.bit_length())) if most_pairs and b <= MOST]
    pairs = [F.sum(F.when(F.col("n") <= b, F.col("others"))).alias(f"p{b}") for b in bounds]
    most, *each = classes.agg(F.max("n"), *pairs).first()
    few = max([FEW, *(b for b, p in zip(bounds, each) if (p or 0) <= 2 * most_pairs)])
    return few, (most or 0) > few


def _links(rows: DataFrame, others: DataFrame, more: Column | None = None) -> DataFrame:
    """(a, b): places of different documents under one key and in different parts of it, the smaller id first."""
    me, other = F.struct("doc", "l", "r"), F.struct("h.doc", "h.l", "h.r")
    named = others.select("key", F.struct("doc", "l", "r", "part", *[c for c in ("same",) if c in others.columns]).alias("h"))
    both = rows.join(named, "key").filter("doc != h.doc AND part != h.part")
    return (both if more is None else both.filter(more)).select(F.least(me, other).alias("a"), F.greatest(me, other).alias("b"))


def _candidates(members: DataFrame, classes: DataFrame, few: int, heads: DataFrame | None) -> DataFrame:
    """(a, b, al, ar, bl, br): pairs of documents, the smaller id first, with the hulls of their places: members beside their
    class, classes of a key of few beside each other, the other classes beside the heads of their key; not those of one part."""
    some = classes.filter(F.col("n").between(2, few))
    copies = members.filter("doc != c.doc AND part != c.part" if "part" in members.columns else "doc != c.doc")
    pairs = copies.select(F.struct("c.doc", "c.l", "c.r").alias("a"), F.struct("doc", "l", "r").alias("b"))
    pairs = pairs.unionByName(_links(some, some, F.col("same") < F.col("h.same")))
    if heads is not None:
        pairs = pairs.unionByName(_links(classes.filter(F.col("n") > few), heads))
    return pairs.groupBy(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).agg(
        F.min("a.l").alias("al"), F.max("a.r").alias("ar"), F.min("b.l").alias("bl"), F.max("b.r").alias("br")
    )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (key, a, b), which come in the order of their keys: a root is the smallest node it reaches."""

    def step(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    held = []
    for batch in batches:
        key, a, b = (batch.column(k).to_numpy() for k in range(3))
        cut = np.searchsorted(key, key[-1]) if len(key) else 0
        if cut:  # all edges of the keys before the last are here
            yield step(*(np.concatenate([*(h[k] for h in held), c[:cut]]) for k, c in enumerate((a, b))))
            held = []
        held.append((a[cut:], b[cut:]))
    if held:
        yield step(*(np.concatenate([h[k] for h in held]) for k in range(2)))


def _joined(many: DataFrame, good: DataFrame, level: int) -> DataFrame:
    """(key, doc, l, r, part): the classes, with the parts of their keys that verified passages connect. A passage and the one
    it repeats connect the classes that they cover; classes of one part stay in one."""
    x = many.select("key", F.expr(OWN).alias("node"), "doc", "l", "r", "part")
    ends = F.col("l"), F.col("r") + SHINGLE - 1
    one = x.join(good, (F.col("doc") == F.col("doc_id")) & (F.col("start_word") <= ends[0]) & (F.col("end_word") >= ends[1]))
    one = one.select("key", F.col("node").alias("a"), F.col("other_doc_id").alias("doc"), "other_start", "other_end")
    both = one.join(x, ["key", "doc"]).filter((F.col("other_start") <= ends[0]) & (F.col("other_end") >= ends[1]))
    edges = both.select("key", "a", F.col("node").alias("b"))
    if level:
        edges = edges.unionByName(x.select("key", F.col("node").alias("a"), F.xxhash64("key", "part").alias("b")))
    # 16 bytes for each edge of a key in its task
    roots = edges.distinct().repartition("key").sortWithinPartitions("key").mapInArrow(_roots, "node bigint, root bigint")
    return x.join(roots, "node", "left").select("key", "doc", "l", "r", F.coalesce("root", "part").alias("part"))


def _ranges(found: DataFrame, *more: str | Column) -> DataFrame:
    """(a, b, afrom, ato, bfrom, bto): the parts of their texts in which candidates are compared, and further columns."""
    return found.select("a", "b", *[f(f"{x}l", f"{x}r").alias(f"{x}{name}") for x in "ab" for f, name in ((_from, "from"), (_upto, "to"))], *more)


def _blocks(found: DataFrame) -> DataFrame:
    """(a, b, afrom, ato, bfrom, bto, block): the compared parts of the candidates, and the block in which they are compared.
    Pairs whose smaller ids have the same smallest partner share one, so that a text goes there once for all its pairs;
    where these texts may have more than ``ROOM`` shingles on either side, they are dealt over a grid of blocks. A
    document of more than ``HUB`` pairs, such as the head of a line that very many share, does not gather the others' pairs."""
    hubs = found.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HUB).select("a")  # at most one row for HUB pairs
    least = found.join(F.broadcast(hubs), "a", "left_anti").groupBy(F.col("b").alias("a")).agg(F.min("a").alias("_root"))
    rooted = _ranges(found.join(least, "a", "left"), F.coalesce("_root", "a").alias("_root"))
    ends = [rooted.select("_root", F.lit(x).alias("_x"), F.col(x).alias("_doc"), F.col(f"{x}from").alias("_lo"), F.col(f"{x}to").alias("_hi")) for x in "ab"]
    texts = ends[0].unionByName(ends[1]).groupBy("_root", "_x", "_doc").agg((F.max("_hi") - F.min("_lo")).alias("_n"))
    sides = [F.ceil(F.sum(F.when(F.col("_x") == x, F.col("_n"))) / ROOM).alias(f"_{x}") for x in "ab"]
    large = texts.groupBy("_root").agg(*sides).filter("_a > 1 OR _b > 1")  # at most one row for ROOM shingles
    out = rooted.join(F.broadcast(large), "_root", "left")
    cell = [F.pmod(F.xxhash64(x), F.coalesce(f"_{x}", F.lit(1))) for x in "ab"]
    return out.select(*rooted.columns[:-1], F.xxhash64("_root", *cell).alias("block"))


def _parts(placed: DataFrame, seqs: DataFrame) -> DataFrame:
    """(block, doc, lo, seq): of each text, once for each of its blocks, what is compared there."""
    ends = [placed.select("block", F.col(x).alias("doc"), F.col(f"{x}from").alias("lo"), F.col(f"{x}to").alias("hi")) for x in "ab"]
    places = ends[0].unionByName(ends[1]).groupBy("block", "doc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return places.join(seqs, "doc").select("block", "doc", "lo", F.slice("seq", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("seq"))


def _compared(found: DataFrame, seqs: DataFrame) -> DataFrame:
    """Passages of the candidates. The texts of a block come before its pairs."""
    # of few pairs, as at the later levels, each is a block of its own: that costs no exchange but its two texts
    placed = _written(_blocks(found), "blocks") if found.count() > PAIRS else _ranges(found, F.xxhash64("a", "b").alias("block"))
    texts = _parts(placed, seqs).select("block", F.col("doc").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("lo").alias("afrom"), "seq")
    both = texts.unionByName(placed, allowMissingColumns=True).select("block", "a", "b", "afrom", "ato", "bfrom", "bto", "seq")
    return both.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(_verify, PASSAGES)


def near_duplicate_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, other_doc_id, other_start, other_end, similarity): a passage of a document
    and the passage of another that it repeats, as word ranges with the end left out. A passage that many
    documents share is linked to few of them, which connects them all."""
    rows, copies = _folded(docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL"))
    zero = F.lit(0)
    out = copies.select(
        F.col("doc").alias("doc_id"), zero.alias("start_word"), F.col("words").alias("end_word"),
        F.col("head").alias("other_doc_id"), zero.alias("other_start"), F.col("words").alias("other_end"), F.lit(1.0).alias("similarity"),
    )
    found = rows.mapInArrow(_regions(), REGIONS)
    tried = seqs = None
    level = first = 0
    while True:
        # the regions of all texts are found and exchanged once; keys of one document go before anything is written
        members = _written(_members(found), "members")
        classes = members.filter("first")
        if not level:
            classes = classes.withColumn("part", F.expr(OWN)).withColumn("others", F.col("n") - 1)
        classes = classes.select("key", "same", "doc", "l", "r", "part", "others", "n")
        few, more = _few(classes, first)
        many = classes.filter(F.col("n") > few)
        heads = _written(_heads(many, level), "heads") if more else None
        pairs = _candidates(members, classes, few, heads)
        if tried is not None:  # not again what lay within the compared part, with all its passages of LEAST
            near = F.lit(True)
            for l, r in (("al", "ar"), ("bl", "br")):
                near &= (F.col(f"p.{l}") >= F.col(f"t.{l}") - REACH + LEAST) & (F.col(f"p.{r}") <= F.col(f"t.{r}") + REACH - LEAST)
            same = (F.col("p.a") == F.col("t.a")) & (F.col("p.b") == F.col("t.b"))
            pairs = pairs.alias("p").join(tried.alias("t"), same & near, "left_anti")
        pairs = _written(pairs, "candidates")
        first = first or max(ALL, pairs.count())  # later levels compare no more than that or what FEW makes
        tried = pairs if tried is None else tried.unionByName(pairs)
        ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
        good = _written(_compared(pairs, _sequences(rows, ids) if seqs is None else seqs), "passages")
        out = out.unionByName(good)
        # keys of few classes are done, and those that verified passages connect; a head was compared with all other parts
        if not more:
            return out.distinct()
        left = _joined(many, good, level).join(heads.drop("part"), ["key", "doc", "l", "r"], "left_anti")
        left = left.groupBy("key", "doc").agg(F.min("part").alias("part"), F.max("part").alias("_part"))
        left = _written(left.select("key", "doc", F.when(F.col("part") == F.col("_part"), F.col("part")).otherwise(F.lit(0)).alias("part")), "left")
        several = left.groupBy("key").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"), F.min("part").alias("_part"), F.max("part").alias("_other"))
        several = several.filter("_lo < _hi AND (_part < _other OR _other = 0)").select("key")
        open_ = _written(left.join(several, "key").groupBy("doc").agg(F.collect_list(F.struct("key", "part")).alias("parents")), "open")
        if open_.isEmpty():
            return out.distinct()
        level += 1
        # later levels need no other texts than the open ones, which get fewer at every level
        held = F.broadcast(open_) if left.count() <= BROADCAST_ROWS else open_
        seqs = _written((_sequences(rows, open_.select("doc")) if seqs is None else seqs.drop("parents")).join(held, "doc"), "sequences")
        found = seqs.select("doc", "seq", "parents.key", "parents.part").mapInArrow(_regions(level), PARTS)
        # a document with places in several parts of a key is in none of them
        found = found.withColumn("part", F.when(F.col("part") == 0, F.expr(OWN)).otherwise(F.col("part")))
