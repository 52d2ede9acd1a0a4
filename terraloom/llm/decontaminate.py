"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Words: A-Z are lower-cased; a word is a run of digits, letters a-z and characters from U+0080 on.
A window is ten consecutive words of an item; an item of one to nine words is one window. Every
different word of the items gets a character of its own, so that a window is a string of at most
ten characters and a text, with one filler for all other words, is a string with one character a
word: the automaton reads each text once, and a match's end is a word position, from which the
word's place in the original text follows (``hit_spans``).

The automaton goes to every executor, so its size is checked first. A benchmark with more than
``MAX_WINDOWS`` words is cut into parts of about as many different windows, by a hash of the window; each part has
an automaton of its own, every text is read once for each part, and the hits of a row are put together. Results
are the same, row by row, at every size.

Defined results: null and empty texts have no words and are clean; items without words have no
window; an item with a null id cannot be named and is left out; repeated items count once; repeated
documents are judged row by row; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import free_name, stored, utf8

WIDTH = 10
MAX_WINDOWS = 300_000
ORIGINAL = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing

#: One table for both steps: lower-case A-Z, and a space for every byte outside of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FILLER = "\x00"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class Matcher:
    """The automaton over windows; each window carries the items it belongs to."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            for w in windows_of(words_of(text)):
                owners.setdefault(w, set()).add(item)
        self.letter: dict[bytes, str] = {}
        self.find = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.find.add_word("".join(self.letter.setdefault(x, self._next()) for x in w), (len(w), ids))
        if owners:
            self.find.make_automaton()

    def _next(self) -> str:
        n = len(self.letter) + 1
        return chr(n if n < 0xD800 else n + 0x800)  # past the surrogates

    def hits(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Positions of the hit words, ascending, and the items with an occurring window."""
        if not self.letter:
            return [], set()
        get = self.letter.get
        found: set[int] = set()
        at: list[int] = []
        end = 0
        spans = sorted((last + 1 - n, last + 1, ids) for last, (n, ids) in self.find.iter("".join([get(w, FILLER) for w in words])))
        for s, e, ids in spans:
            at.extend(range(max(s, end), e))
            end = max(end, e)
            found |= ids
        return at, found


def hit_spans(text: str, matcher: Matcher) -> list[tuple[int, int]]:
    """Character ranges of the original text that the hit words take, neighbours joined."""
    at, _ = matcher.hits(words_of(text.encode()))
    if not at:
        return []
    places = [m.span() for m in ORIGINAL.finditer(text)]
    spans: list[tuple[int, int]] = []
    for k, i in enumerate(at):
        if k and at[k - 1] == i - 1:
            spans[-1] = (spans[-1][0], places[i][1])
        else:
            spans.append(places[i])
    return spans


def digest(items: set[int] | list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OUT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_built: dict[str, Matcher] = {}


def _matcher(key: str, items: Broadcast) -> Matcher:
    """Built once in each worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items.value)
    return _built[key]


def _rows(ids: pa.Array, found: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[], [], [], []]
    arrays = [ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array([n > 0 for n in cols[1]], pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _by_automaton(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, shared)
        for b in batches:
            found = []
            for t in utf8(b.column(1)):
                words = words_of(t)
                at, ids = m.hits(words)
                found.append((len(words), len(at), len(ids), digest(ids)))
            yield _rows(b.column(0), found)

    return docs.mapInArrow(judge, OUT)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            (i, xxhash.xxh64_intdigest(line) - (1 << 63), line.decode())
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))) for w in set(windows_of(words_of(t))) for line in [b" ".join(w)]
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string()])], names=["item_id", "h", "words"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(words_of(t)) for t in utf8(b.column(2))], pa.int64())], names=["id", "doc_id", "n_words"])


def _hits_by_parts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, at, items) of the rows (id, text) that a part of the windows hits: positions of the hit words and the items."""
    windows = stored(items.mapInArrow(_item_windows, "item_id bigint, h bigint, words string").distinct(), "windows")
    parts = max(1, -(-windows.count() // MAX_WINDOWS)) if MAX_WINDOWS > 0 else 3
    found = None
    for k in range(parts):
        some = [(r.item_id, r.words.encode()) for r in windows.filter(F.pmod("h", F.lit(parts)) == k).select("item_id", "words").collect()]
        shared, key = rows.sparkSession.sparkContext.broadcast(some), uuid.uuid4().hex  # about MAX_WINDOWS windows

        def judge(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, key: str = key) -> Iterator[pa.RecordBatch]:
            m = _matcher(key, shared)
            for b in batches:
                hits = [(i, *m.hits(words_of(t))) for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)))]
                hits = [(i, at, sorted(ids)) for i, at, ids in hits if at]
                cols = list(zip(*hits)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64()))], names=["id", "at", "items"])

        part = stored(rows.select("id", "text").mapInArrow(judge, "id bigint, at array<bigint>, items array<bigint>"), "hits")
        found = part if found is None else found.unionByName(part)
    return found


def _by_parts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same result for a benchmark of any size."""
    rows = stored(docs.withColumn("id", F.monotonically_increasing_id()).select("id", "doc_id", "text"), "numbered")
    hit = _hits_by_parts(rows, items)
    hit_words = hit.select("id", F.explode("at").alias("word")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hit.select("id", F.explode("items").alias("item_id")).distinct().groupBy("id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256")
    )
    counts = rows.mapInArrow(_word_counts, "id bigint, doc_id bigint, n_words bigint")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return counts.join(hit_words, "id", "left").join(names, "id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(digest([]))).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items, small = _items(bench, item_id, item_text)
    if small:
        return _by_automaton(narrow, [(r.item_id, r.text.encode()) for r in items.collect()])
    return _by_parts(narrow, items)


def _items(bench: DataFrame, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, bool]:
    """The usable items, and whether their automaton has a size that every executor can hold."""
    items = bench.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    # a window or word takes at least one word of its item, and a word at least two bytes with its separator
    most = items.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0
    return items, most <= MAX_WINDOWS


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without any occurring window."""
    items, small = _items(bench)
    if not small:
        no = free_name(docs, "row_number")
        rows = stored(docs.withColumn(no, F.monotonically_increasing_id()), "numbered")
        bad = _hits_by_parts(rows.select(F.col(no).alias("id"), "text"), items).select(F.col("id").alias(no)).distinct()
        return rows.join(bad, no, "left_anti").select(docs.columns)
    shared, key = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.collect()]), uuid.uuid4().hex
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, shared)
        for b in batches:
            yield b.filter(pa.array([not m.hits(words_of(t))[0] for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
