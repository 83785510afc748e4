"""Whitening of embeddings with a covariance found by polarisation.

Entries become integers x = floor(scale * c) + shift, so all sums are exact. A first pass gives n and the sums S by
dimension. A second one adds up, for every dimension i and every sum of two dimensions i + j, the squares of the values
less their integer means; in integers, sum((n*x - S)^2) = n * (n * sum(d^2) - r^2) with d = x - S div n and
r = S mod n. Two variances and that of the sum give each cross-covariance: (Q(i + j) - Q(i) - Q(j)) / 2. The matrix of
these, each entry rounded once, goes to `eigh` on the driver: it grows with the dimensions only. A third pass measures the
covariance of the whitened rows, the last returns them.

Partial sums leave a task as three limbs of 40 bits, added by a grouped sum: exact up to 2^140, one row for each
pair of dimensions and task.

Defined cases: vectors that are null or hold a null or a non-finite entry are dropped. Vectors of another length than
most others (of equally many, the longer) are dropped as well. An empty table and vectors without variance give no rows; components whose eigenvalue is zero to
double precision are left out. scale * c is held within 2^60 either way. Equal rows and null ids are rows like any other. A
deviation beyond 38 digits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LIMB = 40
#: Values within this and blocks of so many rows keep sums of squares in 64 bits; others are taken as Python integers.
SMALL, ROWS = 1 << 21, 1 << 14
#: Longs of a block of pair sums.
BLOCK = 1 << 18


def vectors(frame: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows without null or non-finite entries; v as doubles."""
    v = F.col(vector).cast("array<double>")
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return frame.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & good)


def integers(batch: pa.RecordBatch, dims: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """x of each row and dimension, as longs."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(np.clip(values * scale, -(2.0**60), 2.0**60)).astype(np.int64) + shift


def _limbs(value: int) -> tuple[int, int, int]:
    low = value & (1 << LIMB) - 1
    middle = value >> LIMB & (1 << LIMB) - 1
    return low, middle, value >> 2 * LIMB


def _whole(row) -> int:
    return int(row["low"]) + (int(row["middle"]) << LIMB) + (int(row["high"]) << 2 * LIMB)


def _partial(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    low, middle, high = zip(*map(_limbs, map(int, totals)), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), *[pa.array(x, pa.int64()) for x in (low, middle, high)]], names=["at", "low", "middle", "high"])


def _added(partials: DataFrame, most: int) -> list[int]:
    """The sums by number; at most `most` of them come to the driver."""
    out = [0] * most
    for row in partials.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("low", "middle", "high")]).toLocalIterator():
        out[row["at"]] = _whole(row)
    return out


PARTIAL = "at long, low long, middle long, high long"


def sums(rows: DataFrame, dims: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """n and the exact sum of x in each dimension."""

    def run(batches):
        total = np.zeros(dims + 1, object)
        for batch in batches:
            x = integers(batch, dims, scale, shift)
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                wide = part if np.abs(part).max() < 1 << 48 else part.astype(object)
                total[:dims] += wide.sum(axis=0).astype(object)
                total[dims] += len(part)
        yield from _partial(total)

    found = _added(rows.mapInArrow(run, PARTIAL), dims + 1)
    return found[-1], found[:-1]


def pair_numbers(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions i <= j of all squares: first each alone (i = j), then all pairs."""
    i, j = np.triu_indices(dims, 1)
    return np.concatenate([np.arange(dims), i]), np.concatenate([np.arange(dims), j])


def squares_of(d: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of d_i^2 for each dimension, then of (d_i + d_j)^2 for each pair, as Python integers."""
    dims = d.shape[1]
    i, j = np.triu_indices(dims, 1)
    total = np.zeros(dims + len(i), object)
    step = max(1, min(ROWS, BLOCK // max(1, len(i))))
    for at in range(0, len(d), step):
        part = d[at : at + step]
        if np.abs(part.astype(np.float64)).max() >= SMALL:
            part = part.astype(object)
        both = part[:, i] + part[:, j]
        total[:dims] += (part * part).sum(axis=0).astype(object)
        total[dims:] += (both * both).sum(axis=0).astype(object)
    return total


def squares(rows: DataFrame, means: list[int], scale: int, shift: int) -> list[int]:
    """`squares_of` x less the integer means, over all rows."""
    dims = len(means)
    middle = np.array(means, np.int64)

    def run(batches):
        total = np.zeros(dims + dims * (dims - 1) // 2, object)
        for batch in batches:
            total += squares_of(integers(batch, dims, scale, shift) - middle)
        yield from _partial(total)

    return _added(rows.mapInArrow(run, PARTIAL), dims + dims * (dims - 1) // 2)


def covariance(n: int, rest: list[int], found: list[int]) -> np.ndarray:
    """Covariances from the squares, by polarisation; each is an exact fraction that is rounded once."""
    dims = len(rest)
    i, j = pair_numbers(dims)
    alone = [n * found[k] - rest[k] ** 2 for k in range(dims)]  # n^2 times the variance
    out = np.zeros((dims, dims))
    for a, b, square in zip(i.tolist(), j.tolist(), found, strict=True):
        if a == b:
            out[a, a] = alone[a] / n**2
        else:
            joint = n * square - (rest[a] + rest[b]) ** 2
            out[a, b] = out[b, a] = (joint - alone[a] - alone[b]) / (2 * n**2)
    return out


def components_of(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) by falling eigenvalue; those of no variance are left out."""
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    flat = values <= max(values[0], 0.0) * len(values) * np.finfo(float).eps
    keep = min(most, int(np.argmax(flat)) if flat.any() else len(values))
    return values[:keep], axes[:, :keep]


def _usual_length(rows: DataFrame) -> int:
    """The length that most vectors have; of equally many the longer."""
    found = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dims")).alias("m")).first()["m"]
    return found["dims"] if found else 0


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component (at most `most`): the whitened coordinate and what describes the fit."""
    rows = vectors(frame, key, vector)
    dims = _usual_length(rows)
    rows = rows.filter(F.size("v") == dims)
    nothing = frame.sparkSession.createDataFrame([], f"{RESULT}, identity_error double")
    if not dims:
        return nothing
    n, total = sums(rows, dims, scale, shift)
    means, rest = [s // n for s in total], [s % n for s in total]
    matrix = covariance(n, rest, squares(rows, means, scale, shift))
    values, axes = components_of(matrix, most)
    count = len(values)
    if not count:
        return nothing
    middle, off = np.array(means, np.int64), np.array([r / n for r in rest])
    turn, explained = axes / np.sqrt(values), values / np.trace(matrix)

    def turned(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - off) @ turn

    def spread(batches):
        inner, mean = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            w = turned(integers(batch, dims, scale, shift))
            inner += w.T @ w
            mean += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count * (count + 1))), pa.array(np.concatenate([inner.ravel(), mean]))], names=["at", "total"])

    def result(batches):
        left = [int(r) for r in rest]
        for batch in batches:
            x = integers(batch, dims, scale, shift)
            whitened = turned(x)
            d = x - middle
            largest = int(np.abs(d.astype(np.float64)).max()) if len(d) else 0
            if (largest * n + n) ** 2 * dims < 1 << 62:
                own = ((n * d - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                own = ((n * d.astype(object) - np.array(left, object)) ** 2).sum(axis=1).tolist()
            deviation = pa.array([v if v < 10**38 else None for v in own], pa.decimal128(38, 0))
            for at in range(0, len(x), 2048):
                size = min(2048, len(x) - at)
                one = np.repeat(np.arange(at, at + size), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(one)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(len(one), n, np.int64)), deviation.take(pa.array(one)),
                    pa.array(whitened[at : at + size].ravel()), pa.array(np.tile(explained, size)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    added = np.zeros(count * (count + 1))
    for row in rows.mapInArrow(spread, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).toLocalIterator():
        added[row["at"]] = row["total"] / n
    mean = added[count * count :]
    error = float(np.abs(added[: count * count].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())
    return rows.mapInArrow(result, RESULT).withColumn("identity_error", F.lit(error))
