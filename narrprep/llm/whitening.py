"""Whitening of embeddings: covariances by polarisation, exact in integers.

Components become integers, so that sums have no rounding.  The squares of every centred dimension and of the sum of
every two centred dimensions are added up; the square of a sum less both squares is twice the product, so these
variances give all covariances exactly.  The matrix, whose size is that of one vector squared, is assembled and
decomposed on the driver; everything per row runs in tasks.

Centring takes two steps: the whole part of the mean is subtracted before anything is multiplied, what is left of the
mean (a fraction of n) is subtracted from the sums, in integers as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values below this bound have exact sums of squares in 64 bits for all rows of a batch.
_PLAIN = 1 << 20
_BIG = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """Fit of n vectors: whole means, what is left of them (times n), eigenvectors (columns) and eigenvalues."""

    n: int
    base: np.ndarray
    rest: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    shift: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _integers(lists: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of every entry; Python integers where 64 bits may not do."""
    flat = np.asarray(lists.flatten(), np.float64).reshape(-1, width)
    if not flat.size or np.abs(flat).max() < float(1 << 40):
        return np.floor(flat * scale).astype(np.int64) + shift
    whole = lambda c: (int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale)) + shift
    return np.array([whole(c) for c in flat.ravel().tolist()], object).reshape(flat.shape)


def _plain(y: np.ndarray) -> np.ndarray:
    """64-bit values where their squares add up within 64 bits, Python integers elsewhere."""
    if not y.size:
        return y.astype(np.int64)
    if max(int(y.max()), -int(y.min())) < _PLAIN:
        return y.astype(np.int64)
    return y.astype(object)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2**14 rows, for which the bound of ``_plain`` holds."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 14):
            yield batch.slice(a, 1 << 14)


def _sums(batches, width: int, scale: int, shift: int):
    """Rows and sum of every dimension, of one task."""
    n, total = 0, np.zeros(width, object)
    for batch in _batches(batches):
        x = _integers(batch.column("vector"), width, scale, shift)
        n += len(x)
        total += (x if x.dtype == object or not x.size or np.abs(x).max() < 1 << 48 else x.astype(object)).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width), pa.array([Decimal(int(v)) for v in total], _BIG)],
            names=["i", "n", "s"],
        )


def _squares(batches, base: np.ndarray, scale: int, shift: int):
    """Sums of squares of every centred dimension (i = j) and of every sum of two, of one task."""
    width = len(base)
    first, second = np.triu_indices(width)
    total = np.zeros(len(first), object)
    seen = False
    for batch in _batches(batches):
        seen = True
        y = _plain(_integers(batch.column("vector"), width, scale, shift) - base)
        part = []
        for i in range(width):
            both = y[:, i:] + y[:, i : i + 1]
            both[:, 0] = y[:, i]
            part.append((both * both).sum(0))
        total += np.concatenate(part).astype(object)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array([Decimal(int(v)) for v in total], _BIG)],
            names=["i", "j", "s"],
        )


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances (divisor n) from the sums of squares; every entry is the exact quotient, rounded once."""
    d = len(rest)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            product = squares[i, i] if i == j else (squares[i, j] - squares[i, i] - squares[j, j]) // 2
            out[i, j] = out[j, i] = (n * product - rest[i] * rest[j]) / (n * n)
    return out


def _whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    values = F.col(vector).cast("array<double>")
    infinite = float("inf")
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(infinite)))
    return rows.select(F.col(key).alias("key"), values.alias("vector")).filter(F.col("vector").isNotNull()).filter(fine)


def fit_whitening(vectors: DataFrame, width: int, most: int = 32, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Fit over all rows of ``vector``, all of ``width`` entries; None where nothing varies."""
    sums = vectors.select("vector").mapInArrow(partial(_sums, width=width, scale=scale, shift=shift), "i int, n bigint, s decimal(38,0)")
    found = {r["i"]: (r["n"], int(r["s"])) for r in sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    if not found:
        return None
    n = found[0][0]
    base, rest = zip(*(divmod(found[i][1], n) for i in range(width)), strict=True)
    base = np.array(base, object if max(map(abs, base)) >= 1 << 48 else np.int64)
    squares = vectors.select("vector").mapInArrow(partial(_squares, base=base, scale=scale, shift=shift), "i int, j int, s decimal(38,0)")
    pairs = squares.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    matrix = covariance(n, rest, {(r["i"], r["j"]): int(r["s"]) for r in pairs})
    values, components = np.linalg.eigh(matrix)
    values, components = values[::-1], components[:, ::-1]
    real = values > width * np.finfo(float).eps * max(values[0], 0)
    values, components = values[real][:most], components[:, real][:, :most]
    if not len(values):
        return None
    # The largest entry of a component is positive.
    largest = np.take_along_axis(components, np.abs(components).argmax(0)[None], 0)
    return Whitening(n, base, rest, components * np.sign(largest), values, float(np.trace(matrix)), scale, shift)


def _whitened(batch, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers and whitened components of a batch."""
    y = _integers(batch.column("vector"), len(fit.base), fit.scale, fit.shift) - fit.base
    mean = np.array([r / fit.n for r in fit.rest])
    return y, ((y.astype(np.float64) - mean) @ fit.vectors) / np.sqrt(fit.values)


def _moments(batches, fit: Whitening):
    """Sums of the whitened components and of their products, of one task."""
    k = len(fit.values)
    total = np.zeros(k + k * k)
    for batch in batches:
        _, w = _whitened(batch, fit)
        total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "s"])


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(fit.values)
    rows = vectors.select("vector").mapInArrow(partial(_moments, fit=fit), "at int, s double")
    found = {r["at"]: r["s"] / fit.n for r in rows.groupBy("at").agg(F.sum("s").alias("s")).collect()}
    sums = np.array([found[i] for i in range(k + k * k)])
    mean, product = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(y: np.ndarray, fit: Whitening) -> list[int | None]:
    """Sum of (n * x - S)**2 of every row; null where 64 bits can't hold it."""
    largest = fit.n * (max(int(y.max()), -int(y.min())) + 1) if y.size else 0
    plain = largest < 1 << 31 and largest * largest * len(fit.rest) < 1 << 62
    z = (y.astype(np.int64 if plain else object) * fit.n) - np.array(fit.rest, np.int64 if plain else object)
    return [v if v < 1 << 63 else None for v in map(int, (z * z).sum(1))]


def _rows(batches, fit: Whitening, error: float):
    k = len(fit.values)
    for batch in batches:
        many = batch.num_rows
        if not many:
            continue
        y, w = _whitened(batch, fit)
        deviation = pa.array(_deviations(y, fit), pa.int64())
        row = pa.array(np.repeat(np.arange(many), k))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(row), pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                pa.array(np.full(many * k, fit.n)), deviation.take(row), pa.array(w.ravel()),
                pa.array(np.tile(fit.explained, many)), pa.array(np.full(many * k, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Whitened components of every vector: one row per row of ``rows`` and component.

    Entries become x = floor(``scale`` * entry) + ``shift``.  Returns ``vec_id``, ``component`` (from 1, by falling
    eigenvalue, at most ``most``), ``n`` (vectors of the fit), ``deviation`` (exact sum of (n * x - S)**2 over
    dimensions, null beyond 64 bits), ``whitened``, ``explained`` (eigenvalue over trace) and ``identity_error``.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out, as are vectors of another
    length than the most frequent one (of equally frequent ones the longest).  Repeated rows and null ids count as rows
    of their own.  Components without variance (an eigenvalue that is zero but for rounding) have no rows, so a table of
    one vector, or of equal ones, gives an empty table, as an empty one does.  Equal eigenvalues leave the choice of
    their components to the decomposition, the same for all rows.  Sums of squares must fit 38 digits.  Only the two
    columns named are read, so others cannot clash.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = _whole_vectors(rows, key, vector).withColumn("key", F.col("key").cast("bigint"))
    widths = found.groupBy(F.size("vector").alias("width")).count().filter("width > 0")
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    fit = None
    if common:
        found = found.filter(F.size("vector") == common["width"])
        fit = fit_whitening(found, common["width"], most, scale, shift)
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    return found.mapInArrow(partial(_rows, fit=fit, error=identity_error(found, fit)), schema)
