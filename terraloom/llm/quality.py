"""Quality scores from naive-Bayes support vectors.

Features are indicators: a text counts each of its n-grams once, however often it has it. Character
n-grams of two to four symbols are hashed to ``DIM`` places; symbols are the text's bytes, with one
symbol for all digits and one for a run of white space. Behind them come ``SHAPES`` places for what
word and line n-grams say without naming the words: the longest run of one repeated word, the share
of different words and of different lines, and the number of words, each as its class on a scale.

Training, from labelled rows outside of the held-out fold only:

1. counts of every n-gram by class over the labelled sample;
2. log-count ratios r = log of the class shares, smoothed by ``ALPHA``;
3. a linear hinge-loss model on the indicators scaled by r, fitted by dual coordinate descent
   (Hsieh et al., 2008) with the box of a coordinate scaled by its class weight;
4. interpolation of the weights with their mean magnitude (Wang and Manning, 2012);
5. a logistic curve from margin to probability, fitted on a part of the sample that the
   support vectors have not seen.

The sample is bounded by ``PER_CLASS`` rows of either label (``sampling.labelled_sample``), by ``TEXT_BYTES`` for a text and
by ``SAMPLE_BYTES`` in all, so that its features fit the driver; every row of the table is scored, whole.

Defined results: null and empty texts have no n-grams and are judged by their shape alone; repeated
rows are scored one by one; without labels of both classes every score is the share of label 1 (0.5
without any); an empty table gives no rows; other columns are ignored, and the id, the language, the
source and the labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored, utf8
from terraloom.llm.sampling import held_out, labelled_sample

DIM = 1 << 18
SHAPES = 64
WIDTH = DIM + SHAPES
PER_CLASS = 3000
TEXT_BYTES = 1 << 18  # longest text of the sample
SAMPLE_BYTES = 96 << 20  # all texts of the sample
ALPHA = 1.0
BETA = 0.5
FOLDS, FOLD = 5, 0
CHUNK = 1 << 20  # bytes of a text whose n-grams are hashed at once

#: Digits are one symbol, ASCII white space one other; all other bytes stand for themselves.
FOLD_BYTES = np.array([48 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint32)


def ngrams(text: bytes) -> np.ndarray:
    """The distinct hashed n-grams of one text, ascending."""
    marks = np.zeros(DIM, bool)
    for start in range(0, len(text), CHUNK):
        s = FOLD_BYTES[np.frombuffer(text[max(0, start - 3) : start + CHUNK], np.uint8)]
        if len(s) > 1:
            s = s[np.concatenate(([True], (s[1:] != 32) | (s[:-1] != 32)))]
        h = s
        for n in (2, 3, 4):
            if len(s) < n:
                break
            h = (h[:-1] * np.uint32(0x9E3779B1)) ^ s[n - 1 :]
            mixed = h * np.uint32(0x85EBCA6B)
            marks[(mixed ^ (mixed >> np.uint32(15))) >> np.uint32(14)] = True
    return np.concatenate((np.flatnonzero(marks), DIM + np.array(shapes(text))))


def shapes(text: bytes) -> list[int]:
    """One place on each of four scales of 16 classes, ascending."""
    words = text.split()
    lines = text.split(b"\n")
    run = longest = 0
    for same in map(bytes.__eq__, words, words[1:]):
        run = run + 1 if same else 0
        longest = max(longest, run)
    share = lambda part: min(15, 15 * len(set(part)) // max(1, len(part)))
    return [min(15, longest), 16 + share(words), 32 + share(lines), 48 + min(15, len(words).bit_length())]


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, scaling included
    intercept: float
    slope: float  # of the logistic curve
    shift: float

    def score(self, text: bytes) -> float:
        z = self.slope * (float(self.weights[ngrams(text)].sum()) + self.intercept) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    p, q = pos + ALPHA, neg + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge loss. ``rows`` are the places of each row's
    indicators, whose values are ``scale``; ``cost`` bounds each row's dual variable."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([1.0 + float(scale[r] @ scale[r]) for r in rows])  # 1 for the intercept; values are looked up, not kept
    rnd = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rnd.permutation(len(rows)):
            value = scale[rows[i]]
            g = y[i] * (float(w[rows[i]] @ value) + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[rows[i]] += d * value
                b += d
                alpha[i] = new
                moved = max(moved, abs(d) * norms[i] ** 0.5)
        if moved < 1e-3:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift by Newton steps; rows are weighted so that label 1 has the share ``prior``."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = float(margin.std()) or 1.0
    x = margin / spread
    a, c = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        v = weight * p * (1 - p) + 1e-9
        ga, gc = float((weight * (p - t)) @ x) + 1e-3 * a, float((weight * (p - t)).sum())
        haa, hac, hcc = float(v @ (x * x)) + 1e-3, float(v @ x), float(v.sum())
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(dc), 1e-9))
        a, c = a - step * da, c - step * dc
        if max(abs(da), abs(dc)) < 1e-8:
            break
    return max(a, 0.0) / spread, c


def train(rows: list[np.ndarray], y: np.ndarray, prior: float) -> Model:
    """``rows``: n-grams of the sample; ``y``: labels 0 and 1; ``prior``: share of label 1 among all labels."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(WIDTH), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    curve = np.arange(len(y)) % 4 == 3  # for the logistic curve only
    used = ~curve
    if len(set(y[curve].tolist())) < 2 or len(set(y[used].tolist())) < 2:
        curve = used = np.ones(len(y), bool)  # too few rows to set any aside
    fit = [rows[i] for i in np.flatnonzero(used)]
    target = y[used]
    pos, neg = np.zeros(WIDTH), np.zeros(WIDTH)
    for r, label in zip(fit, target):
        (pos if label else neg)[r] += 1
    r = log_count_ratios(pos, neg)
    r[(pos + neg) < 3] = 0.0  # seen in too few rows to say anything
    scale = r / max(np.sqrt(np.mean([float(r[i] @ r[i]) for i in fit])), 1e-9)  # rows of unit length on average
    counts = np.bincount(target, minlength=2)
    cost = 4.0 * len(target) / (2.0 * np.maximum(counts[target], 1))
    w, b = dual_descent(fit, 2.0 * target - 1, scale, cost)
    even = np.full(WIDTH, np.abs(w).mean())
    weights = scale * ((1 - BETA) * even + BETA * w)
    margin = np.array([float(weights[rows[i]].sum()) + b for i in np.flatnonzero(curve)])
    slope, shift = logistic_curve(margin, y[curve], prior)
    return Model(weights, b, slope, shift)


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = pa.array([ngrams(t).astype(np.int32) for t in utf8(b.column(2))], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), grams], names=["doc_id", "y", "grams"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on the labelled sample; features are made where the texts are."""
    sample = stored(labelled_sample(labels, "quality", FOLDS, FOLD, per_class), "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # two times per_class ids at most
    # one row for each id, however many share it: that with the smallest hash of its text
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # the sample is bounded in bytes too: texts of up to TEXT_BYTES, SAMPLE_BYTES of them in the order of a hash of the id
    size = F.octet_length("text")
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # two times per_class rows
    texts = texts.filter(F.coalesce(size, F.lit(0)) <= TEXT_BYTES).withColumn("upto", F.coalesce(upto, F.lit(0))).filter(F.col("upto") <= SAMPLE_BYTES)
    got = texts.select("doc_id", "y", "text").mapInArrow(_indices, "doc_id bigint, y int, grams array<int>").toArrow()
    sizes = pc.list_value_length(got["grams"]).to_numpy()
    order = np.lexsort((sizes, got["doc_id"].to_numpy()))
    order = order[np.random.default_rng(7).permutation(len(order))]
    y = np.asarray(got["y"])[order].astype(np.int64)
    views = [flat[s:e] for flat, at in ((np.asarray(c.values), c.offsets.to_pylist()) for c in got["grams"].chunks) for s, e in zip(at, at[1:])]
    rows = [views[i] for i in order.tolist()]  # no copies
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("q")).filter("doc_id IS NOT NULL AND q IN (0, 1)")
    prior = known.filter(~held_out("doc_id", FOLDS, FOLD)).agg(F.avg("q")).first()[0]
    return train(rows, y, float(prior if prior is not None else 0.5))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # WIDTH numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in utf8(b.column(1))], pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = narrow.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) >= threshold for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
