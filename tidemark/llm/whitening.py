"""Whitening of embeddings: leading components by matrix-free block Lanczos, never a covariance matrix.

A vector's entries c become the integers floor(64 * c) + 1000000.  The model is fitted on each different
integer vector once (``fit_list``, a written table).  A pass over it multiplies a block of vectors by the
covariance: each task centres its rows exactly (n * x - S in integers, then / n), adds up X'(X v) for its
rows, and Spark sums the tasks' blocks by position, so that dimension times block numbers reach the driver.

The driver holds the basis and what the passes made of it.  Each round orthogonalises the new block against
the whole basis twice; columns that vanish there (a breakdown) are replaced by random directions outside
the basis.  Ritz vectors count as converged when their residuals are at most ``TOLERANCE`` of the largest
eigenvalue; a full basis of ``MOST`` columns is folded to the best Ritz vectors and goes on from their
residuals.  Where the dimension is not above ``MOST``, the basis can grow to the whole space, which is exact.
The trace comes from the rows' deviations, so shares need no other eigenvalues; one last pass takes the
covariance of the whitened list.

Rows: a null vector, or one with null, NaN or infinite entries, is dropped, as is one with an entry whose
integer a long can't hold, and one whose length isn't the commonest (the longer of two as common).  Repeated
rows are fitted once and each get their rows.  Components whose eigenvalue is 0 (under ``FLAT`` of the
largest) have no whitened values and give no rows: none at all if no two vectors differ, or the table is
empty.  A deviation that a long can't hold is null.  Columns beside id and vector are left out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block beyond the components asked for, and of the basis before it is folded.
SPARE, MOST = 4, 1024
TOLERANCE, FLAT = 1e-13, 1e-10
ROUNDS = 200
#: Entries of this size and more aren't kept: their integer may leave a long.
FAR = float(1 << 62) / SCALE


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): rows with whole, finite vectors of the commonest length; x are the integers."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).alias("key"), entries.alias("c"))
    rows = rows.where(F.col("c").isNotNull() & F.forall("c", lambda c: F.coalesce(F.abs(c) < FAR, F.lit(False))))
    length = rows.groupBy(F.size("c").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    size = length[0] if length else 0
    return rows.where(F.size("c") == size).select("key", F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each different integer vector once, as a written table."""
    return C.materialise(rows.select("x").distinct(), "fit")


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of an array."""
    own = batch.column("x")
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 0), np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - S, exact: as longs where they hold all of it, else (``wide``) as Python integers."""
    return x.astype(object) * n - sums if wide else x * n - sums.astype(np.int64)


def summed(table: DataFrame, work, size: int) -> np.ndarray:
    """Sums over the tasks of the ``size`` numbers that ``work`` makes of each task's rows."""

    def by_position(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = work(integers(batch))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

    out = np.zeros(size)
    for at, value in C.mapped(table, by_position, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


class Moments:
    """Of the fit list: ``n`` rows, exact sums ``s`` by dimension, whether longs hold n * x - S (else ``wide``)."""

    def __init__(self, table: DataFrame):
        def work(batches):
            for batch in batches:
                if len(batch):
                    x = integers(batch)
                    low, high = x.min(axis=0), x.max(axis=0)
                    safe = max(-int(low.min(initial=0)), int(high.max(initial=0))) < (1 << 62) // len(x)
                    total = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
                    columns = [np.arange(x.shape[1], dtype=np.int32), np.full(x.shape[1], len(x)), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)), low, high]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "n", "s", "a", "b"])

        parts = C.mapped(table, work, "at int, n bigint, s decimal(38,0), a bigint, b bigint")
        found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("a").alias("a"), F.max("b").alias("b")).collect()  # a row for each dimension
        self.d, self.n = len(found), found[0]["n"] if found else 0
        self.s = np.zeros(self.d, object)
        reach = 0
        for r in found:
            self.s[r["at"]] = int(r["s"])
            reach = max(reach, self.n * max(abs(r["a"]), abs(r["b"])), self.n * (r["b"] - r["a"]))
        self.wide = reach >= 1 << 62
        self.far = self.wide or self.d * max((self.n * (r["b"] - r["a"]) for r in found), default=0) ** 2 >= 1 << 63

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of the squares of each row of n * x - S; None where a long doesn't hold it."""
        if not self.far:
            return (y * y).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]


def lanczos(multiply, d: int, k: int, seed: int = 42, most: int = MOST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` leading eigenpairs of a symmetric operator of dimension ``d``, values falling.

    ``multiply`` takes a block of columns to the operator's image of it: one pass over the data."""
    rng, width = np.random.default_rng(seed), min(d, k + SPARE)
    most = max(most, 3 * width)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))

    def fresh(block: np.ndarray) -> np.ndarray:
        """The block made orthonormal to the basis and in itself; what vanishes gives way to random directions."""
        out = np.zeros((d, 0))
        for column in block.T:
            size = np.linalg.norm(column)
            for again in range(8):
                for _ in range(2):
                    column = column - basis @ (basis.T @ column)
                    column = column - out @ (out.T @ column)
                if (left := np.linalg.norm(column)) > 1e-10 * size and left > 0:
                    column = column / left
                    column = column - basis @ (basis.T @ column) - out @ (out.T @ column)
                    out = np.column_stack([out, column / np.linalg.norm(column)])
                    break
                column, size = rng.standard_normal(d), np.sqrt(d)
            if basis.shape[1] + out.shape[1] >= d:
                break
        return out

    block = rng.standard_normal((d, width))
    for _ in range(rounds):
        block = fresh(block[:, : d - basis.shape[1]])
        basis, image = np.column_stack([basis, block]), np.column_stack([image, multiply(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1]
        vectors = basis @ turn[:, :k]
        gap = image @ turn[:, :width] - (basis @ turn[:, :width]) * np.linalg.eigvalsh((small + small.T) / 2)[::-1][: min(width, basis.shape[1])]
        if basis.shape[1] >= d or (np.linalg.norm(gap[:, :k], axis=0) <= TOLERANCE * max(values[0], 0.0)).all():
            return values, vectors / np.linalg.norm(vectors, axis=0)
        block = image[:, -block.shape[1] :]
        if basis.shape[1] + width > most:
            basis, image, block = basis @ turn[:, : 2 * width], image @ turn[:, : 2 * width], gap
    raise RuntimeError(f"block Lanczos did not converge in {rounds} passes")


def fit(table: DataFrame, components: int = COMPONENTS) -> dict:
    """Mean, components, eigenvalues, their shares, and the identity error of the whitened list."""
    m = Moments(table)
    if m.n < 2:
        return {"moments": m, "values": np.zeros(0), "vectors": np.zeros((m.d, 0)), "explained": np.zeros(0), "identity_error": 0.0}
    n, s, wide, k = m.n, m.s, m.wide, min(components, m.d)
    near = lambda x: centred(x, n, s, wide).astype(float) / n

    def multiply(block: np.ndarray) -> np.ndarray:
        shared = table.sparkSession.sparkContext.broadcast(block)

        def work(x):
            y = near(x)
            return y.T @ (y @ shared.value)

        return summed(table, work, block.size).reshape(block.shape) / n

    trace = float(summed(table, lambda x: np.array([(near(x) ** 2).sum()]), 1)[0]) / n
    values, vectors = lanczos(multiply, m.d, k)
    keep = values > FLAT * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[keep], vectors[:, keep]
    turn, k = vectors / np.sqrt(values), len(values)

    def whitened(x):
        z = near(x) @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    total = summed(table, whitened, k + k * k) / n
    error = np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max(initial=0.0)
    return {"moments": m, "values": values, "vectors": vectors, "explained": values / trace if trace else values, "identity_error": float(error)}


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each kept row and component."""
    rows = valid(vectors, key, vector)
    model = fit(fit_list(rows), components)
    m, turn = model["moments"], model["vectors"] / np.sqrt(model["values"])
    n, k, explained, error = m.n, turn.shape[1], model["explained"], model["identity_error"]
    shared = vectors.sparkSession.sparkContext.broadcast((m, turn))
    kind = vectors.schema[key].dataType.simpleString()

    def work(batches):
        m, turn = shared.value
        for batch in batches:
            if not len(batch) or not k:
                continue
            y = centred(integers(batch), m.n, m.s, m.wide)
            z, many = y.astype(float) / m.n @ turn, len(batch)
            dev = pa.array(m.deviations(y), pa.int64())
            of = pa.array(np.repeat(np.arange(many), k))
            columns = [batch.column("key").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), dev.take(of), pa.array(z.ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return C.mapped(rows, work, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op12_block_lanczos(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
