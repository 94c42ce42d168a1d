"""Embedding whitening by LOBPCG on distributed covariance-block products.

The leading eigenvectors of the covariance come from blocks of vectors alone: each step multiplies a block by the
covariance in one Spark job over the centred rows (every task adds up C' (C B) for its rows C, the sums of tasks are
added by entry), and the covariance itself is never made. A step's basis is the block of iterates, of their
residuals and of the previous directions, made orthonormal, with directions that add nothing left out; the Rayleigh-
Ritz step on it gives the next iterates. Iterates whose residual is certified keep their place in the basis and stop
to add residuals. The steps end when every wanted pair (e, u) has |V u - e u| <= tolerance * e_1, with V u from a
fresh product over the rows, not from an update; without progress they end in an error that tells the residuals.

Rows are quantised to x = floor(64 c) + 1000000 and centred exactly: n x - S in whole numbers, with S the sums
of the dimensions, then divided by n.

Defined results: vectors that are null, empty, or hold a null, non-finite or absolute entry of 2^40 or more take no
part; of several lengths the most frequent takes part (the smaller in a tie). Repeated rows all count, null
vec_ids are kept, extra columns are left out. Components of no variance (an eigenvalue up to 1e-12 of the largest)
cannot be whitened and are not returned, so equal rows alone, or one row, give no result; an empty table neither.
Where n x - S or the sum of its squares is beyond 64 bits, it is worked out in Python's integers, and a sum that a
long cannot hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship, table

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 40)
#: Iterates beyond those wanted, which speed up the last of them.
GUARD = 8
TOLERANCE, STEPS = 1e-13, 200
#: An eigenvalue up to this share of the largest counts as none.
NOTHING = 1e-12
#: Rows that a task multiplies at once.
ROWS = 4096


def quantised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of an Arrow batch that take part, and their whole numbers, a row each."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    fit = (np.abs(c) < LIMIT).all(axis=1)
    return rows[fit], np.floor(c[fit] * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Fit:
    """Of the fit list: rows, length, sums of the dimensions, total variance; and what was found."""

    n: int
    dim: int
    sums: list[int]
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    residuals: np.ndarray
    steps: int


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: int64, or Python's integers where those could overflow."""
    s = np.array(sums, dtype=object)
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) < 1 << 62:
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _squares(d: np.ndarray) -> list[int]:
    """The sum of each row's squares, exactly."""
    if d.dtype != object and (not d.size or d.shape[1] * max(abs(int(d.min())), abs(int(d.max()))) ** 2 < 1 << 62):
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.astype(object).tolist()]


def _sizes(vectors: DataFrame) -> int:
    """The length of most vectors."""
    fit = vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    first = fit.orderBy(F.desc("n"), "dim").first()
    return first["dim"] if first else 0


def _added(vectors: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over all rows of part(batch's vectors), a matrix of that shape: added up in each task, then by entry.

    shape[0] * shape[1] rows leave each task, are added in a shuffle by their place, and as many reach the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                total += part(b.column(0).slice(lo, ROWS))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "value"])

    out = np.zeros(shape[0] * shape[1])
    t = vectors.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[t["at"].to_numpy()] = t["value"].to_numpy()
    return out.reshape(shape)


def moments(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of the dimensions; a task's sums of 2^63 or more would be an error in the JVM's decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            x = quantised(b.column(0), dim)[1]
            n += len(x)
            sums = [s + int(v) for s, v in zip(sums, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))], names=["at", "value"])

    added = vectors.mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in added}  # dim + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def product(vectors: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance times the block, over the centred rows."""
    dim = len(sums)

    def part(column: pa.Array) -> np.ndarray:
        c = _centred(quantised(column, dim)[1], n, sums)
        return c.T @ (c @ block)

    return _added(vectors, block.shape, part) / n


def _orthonormal(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What new adds to an orthonormal basis, made orthonormal; columns that add nothing are left out."""
    for _ in range(2):  # twice is enough
        new = new - basis @ (basis.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-300] / size[size > 1e-300]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * s[0]]
    return new


def lobpcg(multiply, dim: int, wanted: int, seed: int = 0, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals, steps) of the `wanted` largest eigenpairs of the symmetric map multiply(block)."""
    m = min(dim, wanted + GUARD)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, m)))
    previous = np.zeros((dim, 0))
    vx, fresh = multiply(x), True
    best, idle = np.inf, 0
    for step in range(1, steps + 1):
        value, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-value)
        value, x, vx = value[order], x @ turn[:, order], vx @ turn[:, order]
        residual = vx - x * value
        size = np.linalg.norm(residual[:, :wanted], axis=0)
        if (size <= tolerance * max(value[0], 0.0)).all():
            if fresh:
                return value[:wanted], x[:, :wanted], size, step
            x, _ = np.linalg.qr(x)
            vx, fresh = multiply(x), True  # what is certified is true of the rows
            continue
        best, idle = (size.max(), 0) if size.max() < best / 2 else (best, idle + 1)
        if idle > 20:
            break
        # residuals that are certified add nothing but noise
        open_ = np.linalg.norm(residual, axis=0) > tolerance * max(value[0], 0.0)
        w = _orthonormal(x, residual[:, open_])
        basis = np.hstack([x, w])
        basis = np.hstack([basis, _orthonormal(basis, previous)]) if previous.shape[1] and basis.shape[1] < dim else basis
        vb = np.hstack([vx, multiply(basis[:, m:])]) if basis.shape[1] > m else vx
        ritz, turn = np.linalg.eigh((basis.T @ vb + vb.T @ basis) / 2)
        top = turn[:, np.argsort(-ritz)[:m]]
        previous = basis[:, m:] @ top[m:]
        x, vx, fresh = basis @ top, vb @ top, False
    raise RuntimeError(f"residuals stay at {size.max():.3g} after {step} steps, above {tolerance * max(value[0], 0.0):.3g}")


def fit(vectors: DataFrame, components: int = 32, seed: int = 0) -> Fit | None:
    """The leading components of vectors (column v); None without rows. What reaches the driver is blocks of dim rows."""
    dim = _sizes(vectors)
    n, sums = moments(vectors, dim) if dim else (0, [])
    if not n:
        return None

    def squares(column: pa.Array) -> np.ndarray:
        return np.array([[(_centred(quantised(column, dim)[1], n, sums) ** 2).sum()]])

    trace = float(_added(vectors, (1, 1), squares)[0, 0]) / n
    if not trace > 0:
        return Fit(n, dim, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0)
    values, found, residuals, steps = lobpcg(lambda b: product(vectors, n, sums, b), dim, min(components, dim), seed)
    some = values > NOTHING * values[0]
    return Fit(n, dim, sums, trace, values[some], found[:, some], residuals[some], steps)


def identity_error(vectors: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened rows, about their own mean, minus the identity."""
    k, turn = len(f.values), f.vectors / np.sqrt(f.values)

    def part(column: pa.Array) -> np.ndarray:
        z = _centred(quantised(column, f.dim)[1], f.n, f.sums) @ turn
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = _added(vectors, (k + 1, k), part) / f.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 32, vector: str = "embedding", vec_id: str = "vec_id", seed: int = 0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col(f"`{vector}`").alias("v"))
    f = fit(vectors, components, seed)
    sent = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    types = f"vec_id {sent.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if f is None or not len(f.values):
        return spark.createDataFrame([], types)
    error, k = identity_error(vectors, f), len(f.values)
    turn, explained = f.vectors / np.sqrt(f.values), f.values / f.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rows, x = quantised(part.column(1), f.dim)
                d = _deviations(x, f.n, f.sums)
                z = (d / f.n).astype(np.float64) @ turn
                ids = part.column(0).take(pa.array(np.repeat(rows, k)))
                many = len(rows) * k
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(many, f.n)), pa.array(np.repeat(np.array(_squares(d), np.int64), k)), pa.array(z.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(many, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return sent.mapInArrow(run, types)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
