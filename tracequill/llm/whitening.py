"""PCA whitening by a tall-skinny QR: no covariance matrix is formed.

Vectors become integers (256 times the entry, rounded down), so sums and centring are exact: a row
enters as (n * x - S) / n, where n counts the distinct vectors and S is their sum. Every partition
reduces its rows to a triangle R by QR, a block of rows at a time; triangles are merged eight at a
time in a tree of Spark stages until one is left, whose singular values and right vectors are those
of all rows. R'R is n times the covariance, so the right vectors whiten. What one task or the driver
holds is a few matrices of dims x dims, whatever the number of rows.

The model is fitted on each distinct integer vector once, so a vector in a third of all rows weighs
nothing more; duplicates meet in an aggregation with partial sums. `identity_error` comes from a
second QR, of the whitened fit list.

Defined cases: rows whose vector is null or holds null, NaN or infinity are dropped, and so are
vectors of another length than most have (of equally frequent lengths the greatest holds); null and
repeated ids are rows as any other; components without variance (a singular value below rounding)
cannot be whitened and give no rows, so equal vectors, a single vector and an empty table give
none; a deviation beyond 63 bits is null; entries beyond 2^54 are an error, since 256 times them is
no long. Ties of eigenvalues leave the choice of axes open, but all rows share one. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, tidy

#: Steps of an entry in 1, components returned, triangles merged in a task.
SCALE, COMPONENTS, FAN = 256, 4, 8
#: Entries of a block of rows that a QR or a product takes at once.
BLOCK = 1 << 20
#: The greatest entry that stays exact as a 64-bit integer.
LARGEST = float(1 << 54)
TRIANGLE = "node int, cells binary"
WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitener:
    """n distinct vectors, their sums, components (dims x k), eigenvalues, their shares, and the measured error."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and holds finite entries only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def integers(vector: Column) -> Column:
    """The vector as 64-bit integers; an entry too large for one is an error."""
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) <= LARGEST, F.floor(c.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("an entry is beyond 2^54"))).cast("long"))


def with_integers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the usable rows of the most frequent length."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).filter(usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("v") == (width.width if width else 0)).select("vec_id", integers(F.col("v")).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column without nulls as a matrix."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _blocks(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, name)
            step = max(1, BLOCK // x.shape[1])
            for i in range(0, len(x), step):
                yield batch.slice(i, step), x[i : i + step]


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact: tasks sum their rows, Spark sums these per dimension."""

    def part(batches):
        total = None
        n = 0
        for _, x in _blocks(batches):
            # High and low halves: no sum of a task's rows leaves 64 bits.
            halves = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
            total, n = halves if total is None else total + halves, n + len(x)
        if n:
            lists = [pa.array([row.tolist()], pa.list_(pa.int64())) for row in total]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists], names=["n", "high", "low"])

    parts = fit.select("x").mapInArrow(tidy(part), "n long, high array<long>, low array<long>")
    whole = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "v"))
    sums = whole.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"v.{h}").cast("decimal(38,0)")).alias(h) for h in ("high", "low")))
    rows = sorted(sums.collect())  # a row per dimension
    return (rows[0].n if rows else 0), [(int(r.high) << 32) + int(r.low) for r in rows]


def scaled_deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where all fit, else Python's."""
    most = n * max(int(x.max()), -int(x.min()), 0) + max((abs(s) for s in sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (scaled_deviation(x, n, sums) / n).astype(np.float64)


def _triangle(stack: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(stack), mode="r")


def tall_r(fit: DataFrame, row_block, dims: int) -> np.ndarray:
    """R of the QR of all rows that row_block makes of the integer vectors; dims: its columns."""

    def cells(matrix):
        return pa.array([matrix.tobytes()], pa.binary())

    def leaf(batches):
        r = None
        for _, x in _blocks(batches):
            r = _triangle([row_block(x)] if r is None else [r, row_block(x)])
        if r is not None:
            yield pa.RecordBatch.from_arrays([cells(r)], names=["cells"])

    def merge(key, table):  # FAN triangles at most
        r = _triangle([np.frombuffer(c).reshape(-1, dims) for c in table.column("cells").to_pylist()])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), cells(r)], names=["node", "cells"])

    level = saved(fit.select("x").mapInArrow(tidy(leaf), "cells binary").withColumn("node", F.spark_partition_id()).select("node", "cells"))
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        parents = level.select(F.expr(f"node div {FAN}").cast("int").alias("node"), "cells")
        above = saved(parents.groupBy("node").applyInArrow(merge, TRIANGLE))
        forget(fit.sparkSession, level)
        level = above
    found = level.first()
    forget(fit.sparkSession, level)
    return np.frombuffer(found.cells).reshape(-1, dims) if found else np.zeros((0, dims))


def fit_whitener(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """A whitener of the distinct integer vectors of rows (vec_id, x)."""
    fit = saved(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    n, sums = exact_sums(fit)
    sums = tuple(sums)
    r = tall_r(fit, lambda x: centred(x, n, sums), len(sums)) if n else np.zeros((0, 0))
    _, s, vt = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), r)
    rank = int((s > (s[0] if len(s) else 0) * max(len(sums), 1) * 8 * np.finfo(float).eps).sum())
    k = min(components, rank)
    values = s**2 / max(n, 1)
    model = Whitener(n, sums, np.ascontiguousarray(vt[:k].T), values[:k], values[:k] / (values.sum() or 1.0))
    if k:
        white = tall_r(fit, lambda x: whiten(x, model), k)
        error = float(np.abs(white.T @ white / n - np.eye(k)).max())
        model = Whitener(n, sums, model.components, model.eigenvalues, model.explained, error)
    forget(rows.sparkSession, fit)
    return model


def whiten(x: np.ndarray, model: Whitener) -> np.ndarray:
    """Rows projected on the components, each of unit variance over the fit list."""
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.eigenvalues)


def transform(rows: DataFrame, model: Whitener) -> DataFrame:
    """A row per vector of rows (vec_id, x) and component."""
    k = len(model.eigenvalues)
    top = (1 << 63) - 1

    def square_sum(x):
        d = scaled_deviation(x, model.n, model.sums)
        most = max((abs(int(v)) for v in (d.max(), d.min())), default=0)
        if d.dtype == object or most * most * d.shape[1] > top:
            d = d.astype(object)
        return [v if v <= top else None for v in map(int, (d * d).sum(1))]

    def step(batches):
        for batch, x in _blocks(batches):
            m = len(x)
            fixed = (pa.array(np.full(m * k, model.n)), pa.array(np.repeat(np.array(square_sum(x), object), k), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), *fixed,
                 pa.array(whiten(x, model).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return (rows if k else rows.limit(0)).select("vec_id", "x").mapInArrow(tidy(step), WHITE)


def whiten_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector, fitted on the distinct ones."""
    vectors = with_integers(rows, id_col, vec_col)
    return transform(vectors, fit_whitener(vectors, components))
