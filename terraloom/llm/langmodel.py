"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased and cut at white space, and one end token. Counts of all
tokens of all training texts are gathered by partial aggregates and one exchange; the table of counts stays on
Spark. The most frequent words of up to ``LONGEST`` bytes, ``COMMON`` at most, go to every task (a bounded table); the
other words of a text are looked up by a join with the counts.

Units: the end token and the most frequent words are a unit each, all other words fall into ``CLASSES`` by their
last two bytes. The model predicts the next unit from the ``CONTEXT`` units before it: each has a vector, scaled
for its distance by a diagonal matrix; their sum times the unit's own vector, plus its bias, is its score.

Training: documents are dealt to ``ROUNDS`` rounds by a hash, each training document is used once. In a round every
task trains from the same parameters over its own documents, in numpy: the true unit is told from ``NOISE`` units
drawn from the counts (noise-contrastive estimation, shared by a minibatch); the parameters of all tasks are then
averaged, weighted by their tokens, on Spark. What comes to the driver are the sums of the parameters.

Scoring: batched matrix products give the scores of all units after each context, and their softmax is a
probability; a word of a class has its class's probability times (c + 1) / Z, Z summing c + 1 over the class and one
unseen word. So the probabilities of all words, and of one unseen word for each class, add up to one.

Defined results: a null or empty text is one end token; a null doc_id is a training row; rows that repeat a doc_id
are scored, and counted, one by one; without training rows nothing is known and base scores are 0; an empty table gives no rows;
other columns are ignored. Reruns differ at most in the last digits, as far as the order of sums does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored, utf8
from terraloom.llm.sampling import held_out

FOLDS, FOLD = 7, 2
UNITS = 256
CLASSES = 61
COMMON = 1 << 17
LONGEST = 64
DIM = 16
CONTEXT = 4
NOISE = 32
ROUNDS = 3
BATCH = 2048
RATE = 0.15
FLUSH = 200_000  # different words that a task counts before it sends them on
ROWS = 1024  # positions scored at once
END = 0


def suffix_class(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big") % CLASSES


def _class_column(word: str) -> Column:
    return (F.conv(F.hex(F.expr(f"substring({word}, -2)")), 16, 10).cast("bigint") % CLASSES).cast("int")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both touch ASCII only


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in utf8(b.column(0)):
            held.update(words_of(t))
            if len(held) >= FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


def counts(training: DataFrame) -> DataFrame:
    """(word, c) of the training texts, column ``text``; the end token is not among them."""
    parts = training.select("text").mapInArrow(_counted, "word binary, n bigint")
    return stored(parts.groupBy("word").agg(F.sum("n").alias("c")), "counts")


@dataclass
class Vocabulary:
    """What every task has to know of the counts; its size does not depend on the input."""

    common: list[bytes]  # most frequent first
    count: np.ndarray  # of the common words
    ends: int
    total: int  # N
    distinct: int  # V
    units: int
    unit_count: np.ndarray
    log_z: np.ndarray  # log10 of Z of each unit, 0 for a word's own

    @property
    def own(self) -> int:
        """Units before the classes: the end token and single words."""
        return self.units - CLASSES

    def log_base(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))

    def unit(self, rank: int, word: bytes) -> int:
        return rank + 1 if rank < self.own - 1 else self.own + suffix_class(word)


def vocabulary(table: DataFrame, ends: int, common: int = COMMON, units: int = UNITS) -> Vocabulary:
    sums = table.groupBy(_class_column("word").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    # whole steps of the count, the highest first, as long as they have ``common`` words at most
    step = F.floor(F.log2("c") * 16).cast("int")
    short = table.filter(F.octet_length("word") <= LONGEST)
    least, held = 1 << 30, 0
    for r in sorted(short.groupBy(step.alias("k")).count().collect(), key=lambda r: -r.k):
        held += r["count"]
        if held > common:
            break
        least = r.k
    top = short.filter(step >= least).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    own = units - CLASSES
    mass, size = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        mass[r.k], size[r.k] = r.c, r.v
    total, distinct = int(mass.sum()) + ends, int(size.sum()) + (ends > 0)
    single = np.zeros(own, np.int64)
    single[0] = ends
    for k, r in enumerate(top[: own - 1]):
        single[k + 1] = r.c
        mass[suffix_class(bytes(r.word))] -= r.c
        size[suffix_class(bytes(r.word))] -= 1
    log_z = np.concatenate((np.zeros(own), np.log10(mass + size + 1.0)))
    return Vocabulary([bytes(r.word) for r in top], np.array([r.c for r in top], np.int64), ends, total, distinct, units, np.concatenate((single, mass)), log_z)


class Reader:
    """Texts as units, built once in a task."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.rank = {w: i for i, w in enumerate(v.common)}
        self.unit = np.array([v.unit(i, w) for i, w in enumerate(v.common)] + [0], np.int32)
        self.logs = np.log10(np.append(v.count, 0) + 1.0)
        self.known = np.log10(v.ends + 1.0)

    def units(self, text: bytes) -> np.ndarray:
        """Units with the end token."""
        return self._read(text)[0]

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """Units with the end token, ranks of the words (-1: not common) and the other words' numbers."""
        units, rank, words, rare = self._read(text)
        return units, rank, Counter([words[i] for i in rare])

    def _read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
        words = words_of(text)
        get = self.rank.get
        rank = np.array([get(w, -1) for w in words], np.int32)
        units = np.empty(len(words) + 1, np.int32)
        units[:-1] = self.unit[rank]
        units[-1] = END
        rare = np.flatnonzero(rank < 0).tolist()
        if rare:
            units[rare] = [self.v.own + suffix_class(words[i]) for i in rare]
        return units, rank, words, rare


def contexts(units: np.ndarray, starts: np.ndarray, blank: int) -> np.ndarray:
    """The units at distance 1 to CONTEXT before each position of several texts laid end to end; ``blank`` before a text."""
    n = len(units)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))  # place in the own text
    out = np.full((n, CONTEXT), blank, np.int32)
    for d in range(1, CONTEXT + 1):
        far = np.flatnonzero(at >= d)
        out[far, d - 1] = units[far - d]
    return out


class Model:
    """Context vectors ``r``, distance weights ``c``, unit vectors ``q`` and biases ``b``."""

    def __init__(self, flat: np.ndarray, units: int) -> None:
        self.units = units
        cut = np.cumsum([(units + 1) * DIM, CONTEXT * DIM, units * DIM])
        r, c, q, self.b = np.split(flat, cut)
        self.r, self.c, self.q = r.reshape(units + 1, DIM), c.reshape(CONTEXT, DIM), q.reshape(units, DIM)

    @staticmethod
    def first(v: Vocabulary, seed: int = 1) -> np.ndarray:
        rnd = np.random.default_rng(seed)
        share = (v.unit_count + 1.0) / (v.unit_count + 1.0).sum()
        return np.concatenate((rnd.normal(0, 0.3, (v.units + 1) * DIM), np.ones(CONTEXT * DIM), rnd.normal(0, 0.05, v.units * DIM), np.log(share)))

    def flat(self) -> np.ndarray:
        return np.concatenate((self.r.ravel(), self.c.ravel(), self.q.ravel(), self.b))

    def scaled(self, kind: type = np.float32) -> list[np.ndarray]:
        """The context vectors as each distance sees them."""
        return [(self.r * c).astype(kind) for c in self.c]

    def log10(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of units after their contexts."""
        out = np.empty(len(units))
        q, b, r = np.ascontiguousarray(self.q.T, np.float32), self.b.astype(np.float32), self.scaled()
        for k in range(0, len(units), ROWS):
            near, own = before[k : k + ROWS], units[k : k + ROWS]
            s = _sum(r, near) @ q
            s += b
            mine = s[np.arange(len(own)), own]
            top = s.max(1)
            s -= top[:, None]
            np.exp(s, out=s)
            out[k : k + ROWS] = (mine - top - np.log(s.sum(1))) / np.log(10.0)
        return out


def _sum(r: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    h = r[0].take(before[:, 0], 0)
    for d in range(1, CONTEXT):
        h += r[d].take(before[:, d], 0)
    return h


def _scatter(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each id."""
    out = np.empty((size, rows.shape[1]))
    for d, col in enumerate(np.ascontiguousarray(rows.T, float)):
        out[:, d] = np.bincount(ids, col, size)
    return out


class Trainer:
    """Noise-contrastive estimation by AdaGrad over minibatches of positions."""

    def __init__(self, flat: np.ndarray, v: Vocabulary, seed: int, rate: float = RATE) -> None:
        self.m, self.v, self.rate = Model(flat.copy(), v.units), v, rate
        self.share = (v.unit_count + 1.0) / (v.unit_count + 1.0).sum()
        self.noise = np.log(NOISE * self.share)
        self.rnd = np.random.default_rng(seed)
        self.seen = 0
        self.past = [np.full(x.shape, 1e-3) for x in (self.m.r, self.m.c, self.m.q, self.m.b)]

    def step(self, before: np.ndarray, units: np.ndarray) -> None:
        m, n = self.m, len(units)
        h = _sum(m.scaled(), before)
        q = m.q.astype(np.float32)
        own = q.take(units, 0)
        drawn = self.rnd.choice(len(self.share), NOISE, p=self.share)
        true = (h * own).sum(1) + m.b[units] - self.noise[units]
        false = h @ q[drawn].T + (m.b[drawn] - self.noise[drawn]).astype(np.float32)
        up = -1.0 / (1.0 + np.exp(np.clip(true, -30, 30))) / n
        down = 1.0 / (1.0 + np.exp(np.clip(-false, -30, 30))) / n
        up, down = up.astype(np.float32), down.astype(np.float32)
        dh = up[:, None] * own + down @ q[drawn]
        dq = _scatter(units, up[:, None] * h, m.units)
        np.add.at(dq, drawn, down.T @ h)
        db = np.bincount(units, up, m.units)
        np.add.at(db, drawn, down.sum(0))
        spread = [_scatter(before[:, d], dh, m.units + 1) for d in range(CONTEXT)]
        dr = sum(x * c for x, c in zip(spread, m.c))
        dc = np.array([(x * m.r).sum(0) for x in spread])
        for x, g, past in zip((m.r, m.c, m.q, m.b), (dr, dc, dq, db), self.past):
            past += g * g
            x -= self.rate * g / np.sqrt(past)
        self.seen += n

    def learn(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        units = np.concatenate(texts)
        before = contexts(units, np.cumsum([0, *map(len, texts[:-1])]), self.v.units)
        order = self.rnd.permutation(len(units))
        for k in range(0, len(order), BATCH):
            self.step(before[order[k : k + BATCH]], units[order[k : k + BATCH]])


def train(training: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The parameters after all rounds; ``training`` has the columns doc_id and text."""
    flat = Model.first(v)
    spark = training.sparkSession
    words = spark.sparkContext.broadcast(v)  # COMMON words and numbers
    for k in range(rounds):
        start, rate = flat, RATE / (k + 1)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, t, held, size = None, None, [], 0
            for b in batches:
                reader = reader or Reader(words.value)
                t = t or Trainer(start, words.value, seed=k, rate=rate)
                for text in utf8(b.column(0)):
                    held.append(reader.units(text))
                    size += len(held[-1])
                    if size >= 64 * BATCH:
                        t.learn(held)
                        held, size = [], 0
            if t is not None and (t.seen or held):
                t.learn(held)
                out = np.append(t.m.flat(), 1.0) * t.seen
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["i", "s"])

        part = training.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds)) == k).select("text")
        rows = part.mapInArrow(learn, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        if len(rows):
            total = np.empty(len(rows))
            total[np.asarray(rows["i"])] = np.asarray(rows["s"])
            flat = total[:-1] / total[-1]
    return flat


PARTS = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, times array<bigint>"


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out("doc_id", folds, fold))
    training = rows.filter("NOT held_out")
    table = counts(training)
    v = vocabulary(table, training.count())
    flat = train(training, v)
    spark = docs.sparkSession
    words, units = spark.sparkContext.broadcast(v), v.units

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = None, Model(flat, units)
        names = [f.split()[0] for f in PARTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

        def flush(ids: pa.RecordBatch, read: list) -> pa.RecordBatch:
            texts = [u for u, _, _ in read]
            flatten, starts = np.concatenate(texts), np.cumsum([0, *map(len, texts[:-1])])
            lp = model.log10(contexts(flatten, starts, units), flatten) - reader.v.log_z[flatten]
            own = np.add.reduceat(lp, starts)
            found = []
            for (u, rank, rare), s in zip(read, own.tolist()):
                common = rank[rank >= 0]
                logs = reader.logs[common]
                in_class = logs[reader.unit[common] >= reader.v.own].sum()
                found.append((len(u), len(common) + (reader.v.ends > 0), float(logs.sum() + reader.known), float(s + in_class), list(rare), list(rare.values())))
            arrays = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
            return pa.RecordBatch.from_arrays([*ids.columns, *arrays], names=names)

        for b in batches:
            reader = reader or Reader(words.value)
            ids, read, size, first = b.select([0, 1, 2]), [], 0, 0
            for k, t in enumerate(utf8(b.column(3))):
                read.append(reader.read(t))
                size += len(read[-1][0])
                if size >= 128 * ROWS:
                    yield flush(ids.slice(first, len(read)), read)
                    read, size, first = [], 0, k + 1
            if read:
                yield flush(ids.slice(first, len(read)), read)

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(score, PARTS)
    parts = stored(parts, "scored")
    rare = parts.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n"))).alias("r")).select("row", "r.word", "r.n").join(table, "word")
    found = rare.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return parts.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(v.log_base())).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
