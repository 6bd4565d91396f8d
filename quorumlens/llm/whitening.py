"""Whitening of embeddings by a matrix-free block Lanczos iteration: the covariance is only ever multiplied with a block of vectors.

Each product is a pass over the vectors: a task holds its own batch and one sum of dims x block numbers. The driver
holds numbers by dims and block alone (the Krylov basis, at most dims x dims), whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64, 1_000_000


def usable_vectors(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> tuple[DataFrame, int]:
    """((vec_id, x: array<long>), dims): vectors without null or non-finite entries as whole numbers floor(64 c) + 1,000,000.

    Vectors of no entries are left out, and where lengths differ all but those of the commonest length (of equals the
    longest). An entry beyond the range of a long is an error.
    """
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    table = materialize(rows.where(good).select(F.col(ident).alias("vec_id"), x.alias("x")), "vectors")
    lengths = table.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.greatest(F.max(F.array_max("x")), -F.min(F.array_min("x"))).alias("peak"))
    common = lengths.agg(F.max_by(F.struct("d", "n", "peak"), F.struct("n", "d"))).first()[0]
    if common is None:
        return table, 0
    if common["n"] * common["peak"] >= 1 << 62:
        raise OverflowError("n times an entry does not fit into a long")
    return table.where(F.size("x") == common["d"]), common["d"]


def _matrix(batch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sum_over(table: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of part(batch of x) over all batches: a row a task and place, added up before and after a shuffle by place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                p = part(_matrix(b, dims))
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "v"])

    sums = table.select("x").mapInArrow(run, f"place long, v {kind}").groupBy("place").agg(F.sum("v").alias("v"))
    found = sums.toPandas()  # dims x block numbers
    out = np.zeros(len(found), np.int64 if kind == "long" else np.float64)
    out[found["place"].to_numpy()] = found["v"].to_numpy()
    return out


class Centred:
    """The centred vectors (n x - S) / n of a table, as an operator that takes passes over it."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims = table, dims
        sums = _sum_over(table, dims, lambda x: np.append(x.sum(axis=0), len(x)), "long") if dims else np.zeros(1, np.int64)
        self.n, self.sums = (int(sums[-1]), sums[:-1]) if len(sums) else (0, np.zeros(dims, np.int64))
        self.passes = 0

    def rows(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def gram(self, block: np.ndarray) -> np.ndarray:
        """V block, V being the covariance by divisor n, without V."""
        self.passes += 1
        rows, n, k = self.rows(), self.n, block.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            c = rows(x)
            return c.T @ (c @ block)

        return _sum_over(self.table, self.dims, part, "double").reshape(self.dims, k) / n


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = 16, tolerance: float = 1e-13, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the `wanted` largest eigenpairs of a symmetric, positive semidefinite operator of size dims.

    multiply(B) gives the operator times a block of columns. New blocks are orthogonalised against the whole basis
    twice. What is left of a column after that may be nothing (breakdown: the Krylov space is closed); the
    iteration then restarts in place with random directions orthogonal to the basis, so no eigenvalue is missed that
    the start had no part in, nor one of higher multiplicity than the block. It ends as soon as the residual norms of
    the wanted Ritz pairs, which the last coupling block gives, are tolerance times the largest value, or the basis is
    the whole space. The pairs are then refined by one Rayleigh-Ritz step on the operator itself.
    """
    random = np.random.default_rng(seed)
    wanted, block = min(wanted, dims), max(1, min(block, dims))

    def orthogonal(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            columns = columns - basis @ (basis.T @ columns)
        return columns

    def independent(columns: np.ndarray, basis: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(an orthonormal basis of columns orthogonal to basis, their coefficients); columns under floor count as nothing."""
        u, s, vt = np.linalg.svd(columns, full_matrices=False)
        keep = s > floor
        q = orthogonal(u[:, keep], basis)
        q, r = np.linalg.qr(q)
        return q, (r * s[keep]) @ vt[keep]

    basis = np.zeros((dims, 0))
    new, _ = np.linalg.qr(random.standard_normal((dims, block)))
    images = np.zeros((dims, 0))  # the operator times the basis
    values, small, scale = np.zeros(0), np.zeros((0, 0)), 0.0
    while True:
        image = multiply(new)
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        projected = basis.T @ images
        values, small = np.linalg.eigh((projected + projected.T) / 2)
        values, small = values[::-1], small[:, ::-1]
        scale = max(float(abs(values[0])), np.finfo(float).tiny)
        if basis.shape[1] >= dims:
            break
        left = orthogonal(image, basis)
        fresh, coupling = independent(left, basis, 1e-12 * scale * np.sqrt(dims))
        room = min(block, dims - basis.shape[1])
        fresh, coupling = fresh[:, :room], coupling[:room]
        residual = np.linalg.norm(coupling @ small[-new.shape[1] :, :wanted], axis=0) if coupling.size else np.zeros(wanted)
        closed = fresh.shape[1] < room
        if closed:  # breakdown: new random directions stand for the columns that gave nothing
            start = np.hstack([basis, fresh])
            more, _ = np.linalg.qr(orthogonal(random.standard_normal((dims, room - fresh.shape[1])), start))
            more, _ = np.linalg.qr(orthogonal(more, start))
            fresh = np.hstack([fresh, more])
        if not closed and basis.shape[1] >= wanted + block and residual.max() <= tolerance * scale:
            break
        new = fresh
    vectors, _ = np.linalg.qr(basis @ small[:, :wanted])
    image = multiply(vectors)
    small_image = vectors.T @ image
    values, turn = np.linalg.eigh((small_image + small_image.T) / 2)
    return values[::-1], vectors @ turn[:, ::-1]


def _deviations(whole: np.ndarray) -> np.ndarray:
    """The sums of squares of the rows of whole numbers, exact; beyond a long, an error."""
    peak = int(np.abs(whole).max(initial=0))
    if peak * peak * whole.shape[1] < 1 << 63:
        return (whole * whole).sum(axis=1)
    exact = [sum(int(v) * int(v) for v in row) for row in whole]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation does not fit into a long")
    return np.array(exact, np.int64)


def whiten(rows: DataFrame, components: int = 32, vector: str = "embedding", ident: str = "vec_id", block: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row a usable vector and component.

    Vectors with null or non-finite entries are dropped, as usable_vectors() says; other columns are not read,
    whatever their names. Rows that repeat an id are vectors of their own, and a null id stays null. Components are
    numbered from 1 by falling eigenvalue; there are at most as many as dimensions, and those whose eigenvalue is
    nothing (under 1e-12 of the largest) are left out, as nothing can be divided by its root. No usable vector, or
    none that differs from another, gives no rows. deviation is exact; `n` times an entry, and the sum of squares of a
    row, must fit into a long, else the job fails. The trace of the covariance is the sum of all deviations over n
    cubed. identity_error is measured on the whitened values, with their own mean taken off first.
    """
    table, dims = usable_vectors(rows, vector, ident)
    space = Centred(table, dims)
    n, sums = space.n, space.sums
    none = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = none.format(table.schema["vec_id"].dataType.simpleString())
    spark = rows.sparkSession
    if n == 0:
        return spark.createDataFrame([], schema)
    values, vectors = block_lanczos(space.gram, dims, components, block)
    if not values.size or values[0] <= 0:
        return spark.createDataFrame([], schema)
    keep = values > 1e-12 * values[0]
    values, vectors = values[keep], vectors[:, keep]
    k, centred = len(values), space.rows()
    scaled = vectors / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        """Exact deviations in halves of 32 bits, whose sums fit, and the sums of whitened values."""
        d = _deviations(n * x - sums)
        return np.concatenate([[float((d >> 32).sum()), float((d & 0xFFFFFFFF).sum())], (centred(x) @ scaled).sum(axis=0)])

    found = _sum_over(table, dims, spread, "double")
    trace = (found[0] * 2.0**32 + found[1]) / float(n) ** 3
    mean = found[2:] / n

    def second(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled - mean
        return w.T @ w

    error = float(np.abs(_sum_over(table, dims, second, "double").reshape(k, k) / n - np.eye(k)).max())
    explained = values / trace

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = _matrix(part, dims)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(_deviations(n * x - sums)[each]),
                    pa.array((centred(x) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.mapInArrow(write, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
