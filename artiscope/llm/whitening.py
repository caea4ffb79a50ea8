"""Whitening of vectors by shifted CholeskyQR.

The centred vectors are the rows of a tall matrix A. A pass over them sums the Gram matrix of Q = A M, first with M = I;
its Cholesky factor R_k, of the Gram matrix shifted up where it isn't safely positive, makes Q nearer to orthonormal: M becomes
M R_k^-1 by a triangular solve, and the R factors are composed, so that A = Q R with R = R_k ... R_1. Passes end when
every direction of Q has length 1, or none (what A doesn't span). The singular values of the last Gram matrix's root times R
are those of A, without the squaring that an eigenvalue decomposition of the covariance suffers: a component's variance has
a relative error of about machine precision times the ratio of the largest deviation to its own.

Between passes the driver holds matrices of d x d numbers, d being the vectors' length, whatever their number; a
task holds one and a batch of rows. Sums, and so deviations, are exact whole numbers; rows are centred before anything is multiplied.

Odd input: rows without a vector, with a null or non-finite entry, or of another length than the commonest (of equally
common ones the longest) are dropped. Repeated rows count each. Entries beyond 2 ** 50 count as that. A deviation that a long can't
hold is null. Directions with less than 1e-10 of the largest deviation are no components, so few or equal vectors give
fewer components or none; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import table

#: Entries become whole numbers by this scale and offset.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 50)
#: Components at most.
COMPONENTS = 32
#: Passes at most; A is orthonormal after three unless it is nearly singular.
PASSES = 6
#: A direction whose deviation is a smaller part of the largest is none.
LEAST = 1e-10


def whole_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors of length ``dim``, and their entries as whole numbers."""
    long_enough = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    at = np.flatnonzero(long_enough.to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    ok = np.isfinite(values).all(axis=1)
    return at[ok], np.floor(SCALE * np.clip(values[ok], -LARGEST, LARGEST)).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Center:
    """n rows and their sums; a sum is n * q + r."""

    n: int
    q: np.ndarray
    r: np.ndarray

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean."""
        return (x - self.q) - self.r / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, exactly."""
        off = x - self.q
        if (float(np.abs(off).max(initial=0)) + 1) * self.n < np.sqrt(2.0**62 / max(1, x.shape[1])):
            return (np.square(off * self.n - self.r).sum(axis=1)).tolist()
        sums = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.r.tolist(), strict=True)) for row in off.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def center(vectors: DataFrame) -> Center | None:
    """Number and sums of the usable vectors of the commonest length; None if there are none. ``vectors``: id, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = defaultdict(int), {}
        for batch in batches:
            for dim in pc.unique(pc.list_value_length(batch.column(1))).drop_null().to_pylist():
                at, x = whole_rows(batch.column(1), dim)
                if dim and len(at):
                    n[dim] += len(at)
                    sums[dim] = sums.get(dim, 0) + x.sum(axis=0)
        for dim, s in sums.items():
            yield pa.record_batch([pa.array(np.full(dim + 1, dim)), pa.array(np.arange(-1, dim)), pa.array(np.concatenate([[n[dim]], s]))], names=["dim", "j", "s"])

    sums = vectors.mapInArrow(run, "dim long, j long, s long").groupBy("dim", "j").agg(F.sum("s").alias("s"))
    most = sums.where("j = -1").orderBy(F.desc("s"), F.desc("dim")).limit(1).collect()
    if not most:
        return None
    s = np.zeros(most[0].dim, np.int64)
    for row in sums.where((F.col("dim") == most[0].dim) & (F.col("j") >= 0)).collect():
        s[row.j] = row.s
    return Center(most[0].s, s // most[0].s, s % most[0].s)


def gram(vectors: DataFrame, mid: Center, m: np.ndarray) -> np.ndarray:
    """Gram matrix of the centred rows times ``m``: each task sums its own, the upper triangles are summed by place."""
    d, p = m.shape
    up = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            b = mid.apart(whole_rows(batch.column(1), d)[1]) @ m
            total += b.T @ b
        yield pa.record_batch([pa.array(up[0]), pa.array(up[1]), pa.array(total[up])], names=["i", "j", "v"])

    out = np.zeros((p, p))
    for row in vectors.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = out[row.j, row.i] = row.v
    return out


def cholesky(g: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper factor of ``g``; shifted if asked for, or if ``g`` isn't positive."""
    d = len(g)
    if not shift:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    by = min(0.01, 11 * (rows * d + d * (d + 1)) * np.finfo(float).eps / 2) * np.linalg.norm(g, 2)
    return np.linalg.cholesky(g + by * np.eye(d)).T


def right_solve(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``m`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.zeros_like(m)
    for j in range(r.shape[1]):
        out[:, j] = (m[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def factor(vectors: DataFrame, mid: Center) -> tuple[np.ndarray, float]:
    """A matrix with the singular values and right singular vectors of the centred rows, and the sum of their squares."""
    d = len(mid.q)
    m = r = np.eye(d)
    power = 0.0
    for k in range(PASSES):
        g = gram(vectors, mid, m)
        power = power or float(np.trace(g))
        values, axes = np.linalg.eigh(g)
        if not power or k == PASSES - 1 or k and np.all((np.abs(values - 1) < 1e-10) | (values < 1e-8)):
            break
        rk = cholesky(g, mid.n, shift=not k)
        m, r = right_solve(m, rk), rk @ r
    return (axes * np.sqrt(np.maximum(values, 0))) @ axes.T @ r, power


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained and identity_error."""
    kind = df.schema[id_col].dataType
    vectors = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, [kind, T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 3], strict=True)])
    mid = center(vectors)
    if mid is None:
        return df.sparkSession.createDataFrame([], schema)
    w, power = factor(vectors, mid)
    _, sigma, vt = np.linalg.svd(w)
    keep = min(components, int(np.sum(sigma > LEAST * sigma[0]))) if sigma[0] > 0 else 0
    if not keep:
        return df.sparkSession.createDataFrame([], schema)
    onto = vt[:keep].T * (np.sqrt(mid.n) / sigma[:keep])
    explained = sigma[:keep] ** 2 / power
    error = float(np.abs(gram(vectors, mid, onto) / mid.n - np.eye(keep)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_rows(batch.column(1), len(mid.q))
            n = len(at)
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, keep))),
                pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), n)),
                pa.array(np.full(n * keep, mid.n)),
                pa.array(mid.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), keep))),
                pa.array((mid.apart(x) @ onto).ravel()),
                pa.array(np.tile(explained, n)),
                pa.array(np.full(n * keep, error)),
            ]
            yield pa.record_batch(columns, names=names)

    return vectors.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op13_whitening": op13_whitening}
