"""Whitening of vectors by shifted CholeskyQR.

The centred rows are never gathered: each pass adds up one Gram matrix, of as many rows and columns as a vector has components, in
parts for each task. The first pass factors the Gram matrix plus a small multiple of the identity, which exists in floating
point however badly the rows are conditioned; the triangular factor turns rows into nearly orthogonal ones by a triangular
solve, and further passes over the solved rows repair what is left. The product of the factors is R of the centred rows' QR
decomposition. The singular values of R give the eigenvalues of the covariance and its right singular vectors the components,
with the accuracy of the rows, not of their squares.

Vectors become whole numbers first, so that counts, sums and squared deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EPS = np.finfo(float).eps
#: Above this, products and sums of whole numbers are worked out with Python's integers.
SAFE = 1 << 62


@dataclass(frozen=True)
class Whole:
    """How a component c becomes the whole number floor(scale * c) + offset."""

    scale: int = 1024
    offset: int = 100_000

    @property
    def largest(self) -> float:
        """Components from here on have no 64-bit whole number; vectors with one count as not finite."""
        return float(2**62 // self.scale)


@dataclass(frozen=True)
class Whitening:
    """``n`` rows, their sums ``sums``, ``values``: eigenvalues of the covariance, falling; ``axes``: a component a column."""

    n: int
    sums: list[int]
    wide: bool
    values: np.ndarray = field(repr=False)
    axes: np.ndarray = field(repr=False)

    @property
    def total(self) -> float:
        return float(self.values.sum())

    @property
    def sound(self) -> np.ndarray:
        """Eigenvalues that are more than rounding; the rows don't vary along the other components."""
        largest = self.values.max(initial=0.0)
        return (self.values > (100 * len(self.values) * EPS) ** 2 * largest) & (self.values > 0)


def whole_rows(batch: pa.RecordBatch, whole: Whole, width: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.floor(whole.scale * flat).astype(np.int64) + whole.offset


def from_mean(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n x - S, exact; with ``wide`` as Python integers."""
    if wide:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def solved(rows: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, one after the other, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _added(vectors: DataFrame, rows_of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the rows: a task sends one number for each entry, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums, any_rows = np.zeros((width, width)), np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch)
                gram += rows.T @ rows
                sums += rows.sum(axis=0)
                any_rows = True
        if any_rows:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, np.full(width, -1))), pa.array(np.append(j, np.arange(width))), pa.array(np.append(gram[i, j], sums))],
                ["i", "j", "x"],
            )

    gram, sums = np.zeros((width, width)), np.zeros(width)
    # one number for each pair of components, however many rows there are
    for i, j, x in vectors.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        if i < 0:
            sums[j] = x
        else:
            gram[i, j] = gram[j, i] = x
    return gram, sums


def _counted(vectors: DataFrame, whole: Whole, width: int) -> tuple[int, list[int], int]:
    """Exact number and sums of the whole-number rows, and the largest magnitude in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, [0] * width, 0
        for batch in batches:
            if batch.num_rows:
                x = whole_rows(batch, whole, width)
                most = max(abs(int(x.min())), abs(int(x.max())))
                added = x.sum(axis=0) if most * len(x) < SAFE else x.astype(object).sum(axis=0)
                n, sums, largest = n + len(x), [s + int(a) for s, a in zip(sums, added.tolist(), strict=True)], max(largest, most)
        if n:
            # sums in two parts, so that adding them can't leave 64 bits
            high, low = [s >> 32 for s in sums], [s & 0xFFFFFFFF for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([n] * width, pa.int64()), pa.array([largest] * width, pa.int64())],
                ["j", "high", "low", "n", "largest"],
            )

    parts = vectors.mapInArrow(run, "j long, high long, low long, n long, largest long")
    found = parts.groupBy("j").agg(F.sum("high"), F.sum("low"), F.sum("n"), F.max("largest")).collect()
    sums, n, largest = [0] * width, 0, 0
    for j, high, low, n, largest in found:
        sums[j] = (high << 32) + low
    return n, sums, largest


def triangular_factor(vectors: DataFrame, rows_of: Callable, width: int, n: int, passes: int) -> np.ndarray:
    """R of the rows' QR decomposition, as the product of the factors of ``passes`` Gram passes at most.

    Every pass but the first works on rows that the factors so far have orthogonalised. A Gram matrix without a Cholesky factor
    (rows that leave out directions altogether) is shifted again; the last one's square root takes the shifts out of R.
    """
    factors: tuple[np.ndarray, ...] = ()
    product = np.eye(width)
    for step in range(passes + 1):
        gram, _ = _added(vectors, lambda batch, known=factors: solved(rows_of(batch), known), width)
        if not gram.any():
            return np.zeros((width, width))
        level, turned = np.linalg.eigh(gram)
        near = np.abs(gram - np.eye(width)).max() <= 100 * width * EPS
        if step == passes or (step and near):
            # the rows that are left are orthonormal but for directions in which there are none
            return (np.sqrt(np.maximum(level, 0))[:, None] * turned.T) @ product
        shift = 11 * (n * width + width * (width + 1)) * EPS / 2 * level[-1]
        try:
            if not step:
                raise np.linalg.LinAlgError  # the first factor is always of a shifted matrix
            factor = np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            factor = _shifted(gram, shift, level[-1])
        factors, product = (*factors, factor), factor @ product
    raise AssertionError


def _shifted(gram: np.ndarray, shift: float, largest: float) -> np.ndarray:
    # with very many rows the bound behind the shift is beyond what is useful
    shift = min(shift, 1e-3 * largest)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift *= 4


def usable(vectors: DataFrame, whole: Whole, vector_col: str, id_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and the number of components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < whole.largest)) & (F.size("v") > 0))
    sizes = finite.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0][0] if sizes else 0
    return finite.where(F.size("v") == width), width


def fit_whitening(rows: DataFrame, width: int, whole: Whole = Whole(), passes: int = 4) -> Whitening:
    """Components of all rows of :func:`usable`: one pass for sums, then at most ``passes`` + 1 Gram passes."""
    n, sums, largest = _counted(rows, whole, width)
    wide = 2 * n * largest >= SAFE

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return from_mean(whole_rows(batch, whole, width), n, sums, wide).astype(np.float64) / n

    r = triangular_factor(rows, centred, width, n, passes) if n else np.zeros((width, width))
    _, singular, right = np.linalg.svd(r)
    # the sign of a component is free: its largest entry is positive
    top = np.abs(right).argmax(axis=1) if width else np.zeros(0, int)
    axes = (right * np.sign(right[np.arange(width), top])[:, None]).T
    return Whitening(n, sums, wide, singular**2 / max(n, 1), axes)


def whiten(
    vectors: DataFrame, components: int = 8, whole: Whole = Whole(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue).

    Rows take part whose vector isn't NULL or empty and holds neither NULL, NaN, infinity nor a number whose whole number leaves 64
    bits; of vectors of several lengths those of the commonest do (the longest of several such). All of them are fitted on. Repeated rows count as
    often as they occur, and a row without an id keeps its NULL. ``component`` counts from 1 by falling eigenvalue. ``deviation``:
    sum over the dimensions of (n x - S)^2, NULL where that leaves 64 bits. Components along which the rows don't vary (one row, equal
    rows, fewer rows than dimensions) have ``whitened`` and ``explained`` 0. ``identity_error``: largest absolute entry of the
    whitened rows' covariance minus the identity, worked out from the rows that are returned; 1 or so with components
    that don't vary. Without usable rows there are none. Other columns are left behind.
    """
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    rows, width = usable(vectors, whole, vector_col, id_col)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    fitted = fit_whitening(rows, width, whole)
    n, sums, wide, k = fitted.n, fitted.sums, fitted.wide, min(components, width)
    sound = fitted.sound[:k]
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, fitted.values[:k], 1)), 0.0)
    axes, values = fitted.axes[:, :k], np.where(sound, fitted.values[:k], 0.0)
    explained = values / fitted.total if fitted.total > 0 else np.zeros(k)

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        away = from_mean(whole_rows(batch, whole, width), n, sums, wide)
        return away, (away.astype(np.float64) / n) @ axes * scale

    gram, total = _added(rows, lambda batch: parts(batch)[1], k)
    mean = total / n
    error = float(np.abs(gram / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away, white = parts(batch)
            most = max(abs(int(away.min())), abs(int(away.max())))
            if most * most * width < SAFE:
                deviation = pa.array((away.astype(np.int64) ** 2).sum(axis=1))
            else:
                exact = (away.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            m = len(white)
            every = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    deviation.take(pa.array(every)), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    pa.array(np.tile(values, m)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    return rows.mapInArrow(run, schema)
