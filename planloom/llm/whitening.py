"""Whitening of embeddings: projections on the main components, each scaled to unit variance.

Entries become integers, so that sums are exact and equal vectors are found by their bytes. The mean and the covariance are of the distinct
vectors (the fit list); both are sums over tasks, and the driver sees one number per pair of dimensions, however many vectors there are.

*Mixed precision*: eigenvectors are first worked out in 32 bits. Ogita and Aishima's iteration then corrects all of
them at once with products of matrices in extended precision: from how far X'X is from the identity and X'VX from diagonal follows a correction whose
error is the square of the one before. It divides by differences of eigenvalues, so those that are as close as the error (clusters)
are told apart by a small problem of their own: V within the cluster's span less its mean, solved in 64 bits, turns
the cluster's vectors. Eigenvalues that are equal have no vectors of their own; any orthogonal ones will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.storage import saved

LARGEST = np.iinfo(np.int64).max
# Rows of a block of whole numbers.
BLOCK = 8192
# Eigenvalues that are this close, as a share of the matrix's norm, are told apart by a problem of their own.
CLOSE = 1e-7


def _integers(column: pa.Array, scale: float) -> Iterator[np.ndarray]:
    """floor(scale * entry) of each list of doubles, without the zeros at its end. What passes 64 bits becomes the nearest long."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    wide = np.abs(values) >= 2.0**63
    whole = np.where(wide, 0, values).astype(np.int64)
    whole[wide] = np.where(values[wide] > 0, LARGEST, -LARGEST - 1)
    start = 0
    for size in pa.compute.list_value_length(column).to_pylist():
        row = whole[start : start + size]
        start += size
        used = np.flatnonzero(row)
        yield row[: used[-1] + 1] if len(used) else row[:0]


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Integers in as few bytes as all of a vector's need; a first byte tells how many. Equal vectors have equal bytes."""
    for batch in batches:
        out = []
        for row in _integers(batch.column("entries"), scale):
            low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
            size = next(size for size in (1, 2, 4, 8) if -(1 << 8 * size - 1) <= low and high < 1 << 8 * size - 1)
            out.append(bytes([size]) + row.astype(f"<i{size}").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["packed"])


def _rows(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    block = np.zeros((len(rows), width), dtype=np.int64)
    for number, row in enumerate(rows):
        block[number, : len(row)] = row
    return block


def _unpacked(batches: Iterator[pa.RecordBatch], width: int | None = None) -> Iterator[np.ndarray]:
    """Blocks of vectors, as wide as the widest of the block unless a width is given."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = [np.frombuffer(v, dtype=f"<i{v[0]}", offset=1) for v in batch.column("packed")[start : start + BLOCK].to_pylist()]
            yield _rows(rows, max(map(len, rows)) if width is None else width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, high, low, largest): sums of the halves of the integers of a dimension, at most 2**31 of them; the count as dimension -1."""
    for block in _unpacked(batches):
        dims = np.arange(-1, block.shape[1])
        sums = [np.append(n, part.sum(axis=0)) for n, part in ((0, block >> 32), (len(block), block & 0xFFFFFFFF))]
        largest = np.append(0, np.maximum(block.max(axis=0), -1 - block.min(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (dims, *sums, largest)], ["dim", "high", "low", "largest"])


@dataclass
class Fit:
    """The fit list's size and sums; the components, one a column, and their eigenvalues."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, block: np.ndarray) -> np.ndarray:
        """n * x - S: as longs if all of them surely are, otherwise as Python's integers."""
        if self.n * (self.largest + 1) + max(map(abs, self.sums), default=0) <= LARGEST:
            return block * self.n - np.array(self.sums, dtype=np.int64)
        return block.astype(object) * self.n - np.array(self.sums, dtype=object)

    def squares(self, deviations: np.ndarray) -> list[int]:
        """The sum of squares of each row, exact."""
        most = max(int(deviations.max()), -int(deviations.min())) if deviations.size else 0
        if most * most * deviations.shape[1] > LARGEST:
            deviations = deviations.astype(object)
        return [int(total) for total in (deviations * deviations).sum(axis=1)]

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return self.centred(deviations) @ self.components / np.sqrt(self.values)


def _products(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """(i, j, product): sums of products of centred dimensions over a task's vectors, for i <= j."""
    width = len(fit.sums)
    total = np.zeros((width, width))
    for block in _unpacked(batches, width):
        centred = fit.centred(fit.deviations(block))
        total += centred.T @ centred
    i, j = np.triu_indices(width)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "product"])


def _projected(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    names = [f"z{number}" for number in range(len(fit.values))]
    for block in _unpacked(batches, len(fit.sums)):
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in fit.whitened(fit.deviations(block)).T.copy()], names)


def _clusters(values: np.ndarray, least: float) -> np.ndarray:
    """The number of each ascending value's cluster: neighbours in one differ by `least` at most."""
    return np.append(0, np.cumsum(np.diff(values) > least))


def _turned(a: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The same span by its own best approximations of eigenvectors: a small problem around the mean of their eigenvalues."""
    inner = span.T @ (a @ span)
    inner -= np.trace(inner) / len(inner) * (span.T @ span)
    turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1].astype(span.dtype)
    # Orthogonal beyond double precision by one step of Newton's method.
    return span @ (turn + turn @ (np.eye(len(turn)) - turn.T @ turn) / 2)


def eigenvectors(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, right to double precision.

    The largest entry of each vector is positive.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max()) if size else 0.0
    if scale == 0.0:
        return np.zeros(size), np.eye(size)
    wide = np.longdouble
    a = matrix.astype(wide) / scale
    a = (a + a.T) / 2
    norm = np.linalg.norm(a.astype(np.float64))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    for _ in range(rounds):
        lost, s = np.eye(size) - x.T @ x, x.T @ (a @ x)
        order = np.argsort(np.diag(s))
        x, s, lost = x[:, order], s[np.ix_(order, order)], lost[np.ix_(order, order)]
        off = (s - np.diag(np.diag(s))).astype(np.float64)
        error = 2 * (np.linalg.norm(off) + norm * np.linalg.norm(lost.astype(np.float64)))
        cluster = _clusters(np.diag(s) / (1 - np.diag(lost)), max(error, CLOSE * norm))
        for number in np.flatnonzero(np.bincount(cluster) > 1):
            x[:, cluster == number] = _turned(a, x[:, cluster == number])
        lost, s = np.eye(size) - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(lost))
        same = cluster[:, None] == cluster[None, :]
        gap = np.where(same, 1, values[None, :] - values[:, None])
        correction = np.where(same, lost / 2, (s + values[None, :] * lost) / gap)
        x = x + x @ correction
        if np.abs(correction).max() <= np.finfo(np.float64).eps / 16:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    return (values[order] * scale).astype(np.float64), x


def fitted(distinct: DataFrame, components: int) -> Fit:
    """The fit of a table of distinct packed vectors."""
    sums = distinct.mapInArrow(_sums, "dim long, high long, low long, largest long").groupBy("dim")
    # Halves of sums stay exact as decimals, however many there are.
    found = sums.agg(
        F.sum(F.col("high").cast("decimal(20, 0)")).alias("high"), F.sum(F.col("low").cast("decimal(20, 0)")).alias("low"), F.max("largest").alias("largest")
    ).toArrow().to_pylist()
    totals = {row["dim"]: (int(row["high"]) << 32) + int(row["low"]) for row in found}
    fit = Fit(totals.pop(-1, 0), [totals[dim] for dim in sorted(totals)], max((row["largest"] for row in found), default=0),
              np.zeros((0, 0)), np.zeros(0), 0.0)
    width = len(fit.sums)
    if not width:
        return fit
    products = distinct.mapInArrow(lambda batches: _products(batches, fit), "i int, j int, product double")
    found = products.groupBy("i", "j").agg(F.sum("product").alias("product")).toPandas()
    covariance = np.zeros((width, width))
    covariance[found["i"], found["j"]] = covariance[found["j"], found["i"]] = found["product"] / fit.n
    values, vectors = eigenvectors(covariance)
    # Directions in which all vectors agree can't be scaled to unit variance.
    varied = int((values > values[0] * width * np.finfo(np.float64).eps).sum())
    count = min(components, varied)
    fit.components, fit.values, fit.trace = vectors[:, :count], values[:count], float(np.trace(covariance))
    return fit


def _identity_error(distinct: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    names = [f"z{number}" for number in range(len(fit.values))]
    if not names:
        return 0.0
    projected = distinct.mapInArrow(lambda batches: _projected(batches, fit), ", ".join(f"{name} double" for name in names))
    pairs = [(a, b) for place, a in enumerate(names) for b in names[place:]]
    found = projected.agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def _scored(batches: Iterator[pa.RecordBatch], fit: Fit, scale: float, error: float) -> Iterator[pa.RecordBatch]:
    count, width = len(fit.values), len(fit.sums)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            rows = list(_integers(part.column("entries"), scale))
            deviations = fit.deviations(_rows(rows, width))
            squares = fit.squares(deviations)
            rows = len(squares)
            columns = [
                np.repeat(np.arange(rows), count),
                np.tile(np.arange(1, count + 1), rows),
                fit.whitened(deviations).ravel(),
                np.tile(fit.values / fit.trace, rows),
            ]
            at, component, whitened, explained = (pa.array(column) for column in columns)
            narrow = pa.array([total if total <= LARGEST else None for total in squares], pa.int64())
            wide = pa.array([Decimal(total) if total < 10**38 else None for total in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(at), component.cast(pa.int32()), pa.array([fit.n] * len(at), pa.int64()),
                    narrow.take(at), whitened, explained, pa.array([error] * len(at), pa.float64()), wide.take(at),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"],
            )


def whitened_vectors(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide: a row for each vector and component.

    `vectors` has vec_id and embedding, an array of numbers; other columns are ignored. Rows whose vector is null or has a null or non-finite
    entry are left out. An entry c becomes floor(scale * c), a long; beyond 64 bits the nearest long. Vectors that are
    shorter than others end in zeros, so an empty one is the zero vector.

    The fit list holds each distinct vector once: n of them with sums S. Components are numbered from 1 by falling eigenvalue of its covariance, at most
    `components` of them, and only those with variance: if all vectors are equal there is no row. whitened is the centred
    vector's projection over the square root of the eigenvalue, explained the eigenvalue's share of all variance, identity_error the largest
    entry of the whitened fit list's covariance minus the identity. deviation is the sum of (n * x - S)**2 over the dimensions, exact, and null if it passes
    64 bits; deviation_wide is the same as a decimal of 38 digits. Repeated rows and null vec_ids get rows as any other.
    """
    sound = F.forall("entries", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("entries"))
    rows = rows.where(F.col("entries").isNotNull() & sound)
    packed = rows.select("entries").mapInArrow(lambda batches: _packed(batches, float(scale)), "packed binary")
    distinct = saved(packed.distinct(), "whitening-fit")
    fit = fitted(distinct, components)
    error = _identity_error(distinct, fit)
    return rows.mapInArrow(
        lambda batches: _scored(batches, fit, float(scale), error),
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
        "deviation_wide decimal(38, 0)",
    )
