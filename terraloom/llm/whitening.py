"""Embedding whitening with a covariance by polarisation.

Entries become integers (x = floor(64 c) + 1000000), so that every sum up to the covariance is exact. Each
different vector counts once: n vectors with the sums S. With m = floor(S / n) and r = S - n m, the centred
value n x - S is n u - r for the small integer u = x - m. One pass over the different vectors sums the squares
of u for every dimension and of u_i + u_j for every pair of dimensions; from the exact

    sum (n u - r)^2 = n^2 sum u^2 - n r^2

follow the centred squares of each dimension and of each pair's sum, and half the difference of the pair's
and the two single ones is the pair's cross-covariance (polarisation). They are put together as exact
fractions and rounded once, to the matrix for ``eigh``.

Tasks send one row for each dimension or pair of dimensions, whatever the number of vectors; Spark adds these
up, and d (d + 1) / 2 sums of d-dimensional vectors come to the driver. A frequent vector is met by partial
aggregates (``distinct``). The whitened values' own covariance is measured in a second pass.

Defined results: a vector that is null, or holds null, NaN, an infinity or a number of 1e15 or more (its x would not be
exact), is dropped; so are vectors of another length than the most frequent one (the longer one of a tie).
Rows that repeat a vec_id are kept as they are, a null vec_id too. Directions without variance (an eigenvalue
not above the rounding error of the largest) have no whitened value and are no components, so equal vectors or a single one give
no rows, like an empty table. A deviation that no long can hold is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
LARGEST = 1e15
COMPONENTS = 16
BLOCK = 4096  # vectors worked on at once
SAFE = 1 << 25  # squares of numbers up to this, BLOCK of them, add up in 64 bits


def integers(embedding: str) -> Column:
    return F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET)


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a usable vector, all of one length."""
    usable = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(
        F.col(embedding).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    )
    x = rows.filter(usable).select(F.col(vec_id).cast("bigint").alias("vec_id"), integers(embedding).alias("x"))
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (length.d if length else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a batch, one a row."""
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _blocks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, len(b), BLOCK):
            yield _matrix(b.column(at).slice(k, BLOCK))


def _exact(values: list[int]) -> pa.Array:
    """Whole numbers of any size as text: Spark adds them up as decimals."""
    return pa.array([str(v) for v in values], pa.string())


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for x in _blocks(batches):
            part = [int(hi) * (1 << 32) + int(lo) for hi, lo in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), _exact([n, *total])], names=["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.i: int(r.s) for r in rows}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def squares(u: np.ndarray) -> list[int]:
    """Sums of squares of each column, then of each sum of two columns (i < j, by i)."""
    d = u.shape[1]
    if np.abs(u).max(initial=0) >= SAFE:
        u = u.astype(object)
    out = [int(v) for v in (u * u).sum(0)]
    for i in range(d - 1):
        w = u[:, i : i + 1] + u[:, i + 1 :]
        out += [int(v) for v in ((w * w).sum(0) if w.dtype == object else np.einsum("ij,ij->j", w, w))]
    return out


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance matrix of the vectors of ``fit``, each entry exact but for one rounding."""
    d, centre = len(total), np.array([s // n for s in total])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in _blocks(batches):
            part = squares(x - centre)
            held = part if held is None else [a + b for a, b in zip(held, part)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), _exact(held)], names=["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.i: int(r.s) for r in rows}
    rest = [s - n * (s // n) for s in total]
    centred = lambda square, r: n * square - r * r  # noqa: E731  1/n of the sum of squares of n u - r
    own = [centred(found[i], rest[i]) for i in range(d)]
    v, at = np.zeros((d, d)), d
    for i in range(d):
        v[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = float(Fraction(centred(found[at], rest[i] + rest[j]) - own[i] - own[j], 2 * n * n))
            at += 1
    return v


def axes(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors, one a column, and eigenvalues, falling; only those with variance."""
    values, found = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(v) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)]
    found = found[:, order]
    top = np.abs(found).argmax(0)
    return found * np.where(found[top, range(found.shape[1])] < 0, -1.0, 1.0), values[order]


def deviations(u: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """The sum of (n u - rest)^2 of each row; None if it does not fit a long."""
    about = ((u.astype(float) * n - rest.astype(float)) ** 2).sum(1)
    y = u.astype(np.uint64) * np.uint64(n) - rest.astype(np.uint64)  # modulo 2^64, as the sum below
    out: list[int | None] = (y * y).sum(1, dtype=np.uint64).tolist()
    for k in np.flatnonzero(about > 9e18):
        exact = sum((n * int(a) - int(r)) ** 2 for a, r in zip(u[k], rest))
        out[k] = exact if exact < 1 << 63 else None
    return out


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component."""
    x = vectors(rows, vec_id, embedding)
    fit = stored(x.select("x").distinct(), "vectors")
    n, total = sums(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], OUT)
    v = covariance(fit, n, total)
    found, values = axes(v, components)
    explained = values / np.trace(v) if len(values) else values
    centre, rest = np.array([s // n for s in total]), np.array([s % n for s in total])
    project = found / np.sqrt(values)
    shift = rest / n
    k = len(values)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, k))
        for b in _blocks(batches):
            w = ((b - centre) - shift) @ project
            held += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(held.ravel())], names=["i", "s"])

    error = 0.0
    if k:
        parts = fit.mapInArrow(measure, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        own = np.zeros(k * k)
        own[[r.i for r in parts]] = [r.s for r in parts]
        error = float(np.abs(own.reshape(k, k) / n - np.eye(k)).max())

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b) if k else 0, BLOCK):
                ids, u = b.column(0).slice(at, BLOCK), _matrix(b.column(1).slice(at, BLOCK)) - centre
                w = (u - shift) @ project
                each = np.repeat(np.arange(len(u)), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(u)), pa.int32()), pa.array(np.full(len(each), n)),
                    pa.array(deviations(u, n, rest), pa.int64()).take(pa.array(each)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(u))), pa.array(np.full(len(each), error)),
                ], names=[c.split()[0] for c in OUT.split(", ")])

    return x.mapInArrow(turn, OUT)
