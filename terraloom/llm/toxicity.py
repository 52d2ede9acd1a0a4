"""Toxicity scores: a lexicon trie read through Levenshtein automata, weighted by context.

Lexicon: whole words and word stems that labelled toxic texts have far more often than others
(``KL_MIN`` nats of evidence over the labelled sample, near copies counted once). It is a trie; a stem matches every word that begins
with it. Words are runs of a-z, digits, @ and all bytes from 0x80 on, after A-Z are lower-cased.

Matching: the Levenshtein automata of all entries run over the trie together. A configuration is a
trie node and the number of errors so far; a set of configurations is a state of one deterministic
automaton, and its transitions are worked out when a text first asks for them. All words of a text
step through it at once. Entries of five bytes or more allow one error, of nine or more two.

Context: the ``WINDOW`` words on either side of a hit decide whether it counts as used or as quoted
(quotation marks on both sides, or a reporting word), and add direct address and other hits nearby.
The score is a logistic model of the counts by kind of match and context, fitted on the labelled sample;
quoted hits have features of their own, so they weigh nothing unless labelled texts say otherwise.

Defined results: null, empty and wordless texts have no hits and get the score of the intercept;
repeated rows are scored one by one; without labels of both classes all scores are the share of label
1 (0 without any); an empty table gives no rows; other columns are ignored, and the id, the language,
the source and the labels are never inputs of a score. Texts are read whole; the sample is bounded by
``PER_CLASS`` rows of either label and the lexicon by ``LEXICON_MAX`` entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored, utf8
from terraloom.llm.sampling import held_out, labelled_sample

FOLDS, FOLD = 3, 1
PER_CLASS = 4000
LEXICON_MAX = 1000
KL_MIN = 14.0
STEM_MIN, STEM_MAX = 3, 8  # letters of a stem
WINDOW = 5
STATES_MAX = 100_000

#: Words that report speech, words of direct address, quotation marks.
REPORTING = frozenset(w.encode() for w in (
    "said", "says", "called", "calls", "quote", "quoted", "wrote", "term", "word", "sagte", "nannte", "zitat", "dit", "citation", "dijo", "cita",
))
DIRECT = frozenset(w.encode() for w in ("you", "your", "u", "du", "dein", "tu", "toi", "ton", "vous", "tú", "eres"))
QUOTES = re.compile("|".join('"“”„«»').encode())

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), 64, *range(97, 123), *range(128, 256)]] = True
WORD = re.compile(rb"[0-9@a-z\x80-\xff]+")
WIDE_MARKS = re.compile(rb"\xe2\x80[\x80-\xaf]|\xc2[\xa0-\xbf]")  # spaces, dashes and quotation marks beyond ASCII


def lowered(text: bytes) -> bytes:
    """A-Z lower-cased, wide marks as spaces; every byte keeps its place."""
    low = text.lower()
    return WIDE_MARKS.sub(lambda m: b" " * len(m[0]), low) if b"\xc2" in low or b"\xe2\x80" in low else low


def allowed(term: str | bytes) -> int:
    n = len(term)
    return 2 if n >= 9 else 1 if n >= 5 else 0


class Automaton:
    """Levenshtein automata of all entries over their trie, made deterministic as texts need it."""

    def __init__(self, words: list[bytes], stems: list[bytes]) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.errors = [0]  # most errors that an entry at or below the node allows
        self.word: dict[int, int] = {}  # node -> allowed errors
        self.stem: dict[int, int] = {}
        for entries, at in ((words, self.word), (stems, self.stem)):
            for w in entries:
                node, k = 0, allowed(w) if entries is words else (1 if len(w) >= 7 else 0)
                self.errors[0] = max(self.errors[0], k)
                for b in w:
                    if b not in self.child[node]:
                        self.child[node][b] = len(self.child)
                        self.child.append({})
                        self.errors.append(0)
                    node = self.child[node][b]
                    self.errors[node] = max(self.errors[node], k)
                at[node] = k
        self.longest = max(map(len, words + stems), default=0) + 2
        used = sorted({b for c in self.child for b in c})
        self.symbol = np.full(256, len(used), np.int32)
        self.symbol[used] = np.arange(len(used))
        self.letters = [*used, None]
        self.start_over()

    def start_over(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.verdict: list[int] = []
        self.step = np.empty((0, len(self.letters)), np.int32)
        self._state(frozenset())  # 0: nothing can match any more
        self._state(self._closed({0: 0}))  # 1: the start

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With letters left out: nodes further down at one more error each. -1: a stem is complete."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if node < 0 or nodes.get(node, 99) < e:
                continue
            if node in self.stem and e <= self.stem[node] and e < nodes.get(-1, 99):
                nodes[-1] = e
            for n in self.child[node].values():
                if e + 1 <= self.errors[n] and e + 1 < nodes.get(n, 99):
                    nodes[n] = e + 1
                    todo.append((n, e + 1))
        return frozenset(nodes.items())

    def _state(self, key: frozenset) -> int:
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            words = [e for n, e in key if n >= 0 and n in self.word and e <= self.word[n]]
            stem = dict(key).get(-1)
            self.verdict.append(1 + (min(words) > 0) if words else 3 + (stem > 0) if stem is not None else 0)
            if len(self.sets) > len(self.step):
                more = np.full((max(64, len(self.step)), len(self.letters)), -1, np.int32)
                self.step = np.concatenate((self.step, more))
        return self.number[key]

    def _next(self, state: int, symbol: int) -> int:
        nodes: dict[int, int] = {}
        letter = self.letters[symbol]

        def put(n: int, e: int) -> None:
            if e <= self.errors[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for node, e in self.sets[state]:
            if node < 0:
                nodes[-1] = min(e, nodes.get(-1, 99))
                continue
            put(node, e + 1)  # a letter too many
            for b, n in self.child[node].items():
                put(n, e + (b != letter))
        return self._state(self._closed(nodes)) if nodes else 0

    def match(self, codes: np.ndarray) -> np.ndarray:
        """codes: one row of letter symbols a word, -1 behind its end. Verdicts: 0 none, 1 word, 2 word
        with errors, 3 stem, 4 stem with errors."""
        if len(self.sets) > STATES_MAX:
            self.start_over()
        state = np.ones(len(codes), np.int32)
        for column in codes.T:
            live = np.flatnonzero((column >= 0) & (state > 0))
            if not len(live):
                break
            s, c = state[live], column[live]
            to = self.step[s, c]
            if (to < 0).any():
                for a, b in {(int(a), int(b)) for a, b in zip(s[to < 0], c[to < 0])}:
                    n = self._next(a, b)
                    self.step[a, b] = n
                to = self.step[s, c]
            state[live] = to
        return np.array(self.verdict, np.int8)[state]


#: Of each text: hits by kind (4) and context (used, quoted), the presence of either, direct address,
#: crowding, used hits in a hundred words.
FEATURES = 13


@dataclass
class Model:
    words: list[bytes]
    stems: list[bytes]
    weights: np.ndarray  # the intercept last
    automaton: Automaton | None = field(default=None, repr=False)

    def hits(self, text: bytes) -> list[tuple[int, int, int, bool]]:
        """(start, end, kind, quoted) of each hit, in bytes of the text."""
        if self.automaton is None:
            self.automaton = Automaton(self.words, self.stems)
        return find_hits(text, self.automaton)[0]

    def score(self, text: bytes) -> float:
        if self.automaton is None:
            self.automaton = Automaton(self.words, self.stems)
        z = float(features(text, self.automaton) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}


def find_hits(text: bytes, automaton: Automaton) -> tuple[list[tuple[int, int, int, bool]], int, int, int]:
    """Hits; how many have direct address or another hit in their window; words."""
    low = lowered(text)
    data = np.frombuffer(low, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = LETTER[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    found: list[tuple[int, int]] = []
    width = automaton.longest + 1
    steps = np.arange(width)
    for k in range(0, len(starts), 1 << 15):
        s, e = starts[k : k + (1 << 15), None], ends[k : k + (1 << 15), None]
        at = s + steps
        codes = np.where(at < e, automaton.symbol[data[np.minimum(at, len(data) - 1)]], -1)
        verdicts = automaton.match(codes)
        found += [(k + int(i), int(verdicts[i])) for i in np.flatnonzero(verdicts)]
    hits, direct, crowded = [], 0, 0
    places = [i for i, _ in found]
    for j, (i, kind) in enumerate(found):
        lo, hi = max(0, i - WINDOW), min(len(starts) - 1, i + WINDOW)
        before, after = low[starts[lo] : starts[i]], low[ends[i] : ends[hi]]
        around = set(WORD.findall(before)) | set(WORD.findall(after))
        marks = QUOTES.search(text[max(0, int(starts[lo]) - 3) : starts[i]]) and QUOTES.search(text[ends[i] : ends[hi] + 3])
        quoted = bool(marks or around & REPORTING)
        direct += bool(around & DIRECT)
        crowded += bool(j and places[j - 1] >= lo or j + 1 < len(places) and places[j + 1] <= hi)
        hits.append((int(starts[i]), int(ends[i]), kind, quoted))
    return hits, direct, crowded, len(starts)


def features(text: bytes, automaton: Automaton) -> np.ndarray:
    hits, direct, crowded, n = find_hits(text, automaton) if automaton.longest > 2 else ([], 0, 0, 0)
    out = np.zeros(FEATURES)
    for _, _, kind, quoted in hits:
        out[kind - 1 + 4 * quoted] += 1
    out[8], out[9] = float(out[:4].any()), float(out[4:8].any())
    out[10], out[11], out[12] = direct, crowded, 100 * out[:4].sum() / max(n, 10)
    return np.minimum(np.log1p(out), 3.0)


def candidates(text: bytes) -> set[str]:
    """Entries that a text could teach: its words as "word", their beginnings as "stem*"."""
    out = set()
    for w in set(WORD.findall(lowered(text))):
        word = w.decode("utf-8", "ignore")
        if 3 <= len(word) <= 24 and not word.isdigit():
            out.add(word)
            out.update(word[:n] + "*" for n in range(STEM_MIN, min(STEM_MAX, len(word) - 1) + 1))
    return out


def sketch(text: bytes) -> int:
    """The smallest hash of the three-word shingles: near copies mostly share it."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) - (1 << 63)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sketches = pa.array([sketch(t) for t in utf8(b.column(2))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sketches], names=["doc_id", "y", "text", "sketch"])


def choose(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> tuple[list[bytes], list[bytes]]:
    """Words and stems from (candidate, toxic texts, other texts)."""
    share = n_pos / max(1, n_pos + n_neg)
    strong = {}
    for term, t, c in counts:
        p = t / (t + c)
        kl = p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0)
        if p > share and (t + c) * kl >= KL_MIN and t / n_pos >= 8 * (c + 0.5) / (n_neg + 1):
            strong[term] = t
    best: dict[str, int] = {}
    for term, t in strong.items():
        if not term.endswith("*"):
            for n in range(STEM_MIN, min(STEM_MAX, len(term) - 1) + 1):
                best[term[:n]] = max(best.get(term[:n], 0), t)
    # a stem is an entry if it says much more than any one word that it begins; of nested stems the longest with nearly all texts
    stems: list[str] = []
    rank = sorted((s[:-1] for s in strong if s.endswith("*") and strong[s] >= 1.5 * best.get(s[:-1], 0)), key=lambda s: (len(s), s))
    for s in rank:
        longer = [x for x in rank if len(x) > len(s) and x.startswith(s) and strong[x + "*"] >= 0.9 * strong[s + "*"]]
        if not longer and not any(s.startswith(x) for x in stems):
            stems.append(s)
    words = [w for w in strong if not w.endswith("*") and not any(w.startswith(s) for s in stems)]
    keep = sorted(words, key=lambda w: (-strong[w], w)) , sorted(stems, key=lambda s: (-strong[s + "*"], s))
    return [w.encode() for w in keep[0][: LEXICON_MAX // 2]], [s.encode() for s in keep[1][: LEXICON_MAX // 2]]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and intercept by Newton steps; the intercept is not shrunk."""
    x1 = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x1.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-4
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        g = x1.T @ (weight * (p - y)) + shrink * w
        h = (x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(shrink)
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 4.0 / max(1e-9, float(np.abs(d).max())))
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = stored(labelled_sample(labels, "toxic", FOLDS, FOLD, per_class), "sample")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # two times per_class ids at most
    # one row for each id, however many share it: that with the smallest hash of its text
    chosen = chosen.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # copies of one text are evidence of one text: without this a copied text would teach all its words
    one = chosen.select("doc_id", "y", "text").mapInArrow(_sketched, "doc_id bigint, y int, text string, sketch bigint").groupBy("y", "sketch")
    texts = stored(one.agg(F.min_by("text", "doc_id").alias("text")).select("y", "text"), "texts")
    sizes = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").alias("t")).filter("doc_id IS NOT NULL AND t IN (0, 1)")
    prior = known.filter(~held_out("doc_id", FOLDS, FOLD)).agg(F.avg("t")).first()[0] or 0.0
    if not n_pos or not n_neg:
        return Model([], [], np.append(np.zeros(FEATURES), np.log((prior + 1e-9) / (1 - prior + 1e-9))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                tally[y].update(candidates(t))
            terms = list(tally[0].keys() | tally[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([tally[1][t] for t in terms], pa.int64()), pa.array([tally[0][t] for t in terms], pa.int64())], names=["term", "t", "c"])

    counted = texts.mapInArrow(count, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    strong = counted.filter((F.col("t") >= 5) & (F.col("t") / n_pos >= 8 * (F.col("c") + 0.5) / (n_neg + 1))).orderBy(F.desc("t"), "term").limit(20 * LEXICON_MAX)
    words, stems = choose([tuple(r) for r in strong.collect()], n_pos, n_neg)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words, stems)
        for b in batches:
            rows = [features(t, automaton).tolist() for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    got = texts.mapInArrow(describe, "y int, x array<double>").toArrow()
    y = got["y"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), FEATURES)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of the parts
    x, y = x[order], y[order]
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return Model(words, stems, logistic(x, y, weight))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # LEXICON_MAX entries at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in utf8(b.column(1))], pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = narrow.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
