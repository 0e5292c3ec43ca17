"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of the distinct vectors are found without V: a block Q of directions meets the data only in
passes V Q = Xc' (Xc Q) / n, in which every task centres its rows, multiplies, and adds up; Spark adds up the tasks' sums. A cycle of
passes applies a Chebyshev polynomial of V to the block. It is small on [0, cut], where cut is the block's least Ritz value, so that the
unwanted spectrum is damped, and grows quickly beyond. The block is made orthonormal (QR), and a Rayleigh-Ritz step gives values and
vectors. The cycles end when the residuals of all wanted pairs are at rounding level, or certified and falling no more.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import trim

ROWS = 4096


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def matrices(column: pa.Array, dim: int):
    """Whole-number vectors, `dim` long (shorter ones filled up with zeros), some rows at a time, with the first row's number."""
    for low in range(0, len(column), ROWS):
        part = column.slice(low, ROWS)
        sizes = np.diff(part.offsets.to_numpy())
        x = np.zeros((len(part), dim), np.int64)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if (sizes == dim).all():
            x[:] = flat.reshape(len(part), dim)
        else:
            x[np.repeat(np.arange(len(part)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        yield low, x


def sums(batches, dim: int):
    """x -> rows i, s: exact sums of each dimension, and at i = dim the number of rows."""
    low_bits, total = (1 << 26) - 1, [0] * (dim + 1)
    for batch in batches:
        for _, x in matrices(batch.column(0), dim):
            for i, (a, b) in enumerate(zip((x >> 26).sum(0).tolist(), (x & low_bits).sum(0).tolist())):  # neither half can overflow
                total[i] += (a << 26) + b
            total[dim] += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])


def products(batches, mean: np.ndarray, q: np.ndarray, gram: bool):
    """x -> rows i, y of Xc' (Xc q), or, for gram, of (Xc q)' (Xc q); and at i = -1 the sum of squares of Xc."""
    total, squares = np.zeros((q.shape[1] if gram else len(mean), q.shape[1])), 0.0
    for batch in batches:
        for _, x in matrices(batch.column(0), len(mean)):
            c = x - mean
            p = c @ q
            total += (p if gram else c).T @ p
            squares += float((c * c).sum())
    trim()
    rows = [[squares], *total.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "y"])


class Fitted:
    """The distinct vectors x as a table of the shared folder, their number, sums and means."""

    def __init__(self, x: DataFrame):
        self.x = cut(x.distinct())
        self.dim = int(self.x.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
        dim = self.dim
        found = self.x.mapInArrow(lambda it: sums(it, dim), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect() if dim else []  # dim + 1 rows
        s = {r["i"]: int(r["s"]) for r in found}
        self.n, self.sums = s.get(dim, 0), [s.get(i, 0) for i in range(dim)]
        self.mean = np.array([t / self.n for t in self.sums]) if self.n else np.zeros(dim)
        self.passes, self.trace = 0, 0.0

    def times(self, q: np.ndarray, gram: bool = False) -> np.ndarray:
        """V q, or q' V q: one pass."""
        box = self.x.sparkSession.sparkContext.broadcast((self.mean, q))  # dim * (block + 1) numbers
        n, columns = len(q[0]) if gram else self.dim, q.shape[1]
        width = [F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(columns)]
        rows = self.x.mapInArrow(lambda it: products(it, *box.value, gram), "i int, y array<double>").groupBy("i").agg(*width).collect()  # n + 1 rows
        out = np.zeros((n, columns))
        for r in rows:
            if r["i"] < 0:
                self.trace = r["y0"] / self.n
            else:
                out[r["i"]] = r[1:]
        self.passes += 1
        return out / self.n


def eigenvectors(data: Fitted, wanted: int, block: int, degree: int, cycles: int, tolerance: float = 2e-15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenvalues, their unit vectors (as columns) and the residuals' lengths relative to the first value. Directions without
    variance are left out."""
    b = min(block, data.dim)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((data.dim, b)))[0]
    k, best = min(wanted, b), None
    for _ in range(cycles):
        y = data.times(q)
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        if values[0] <= 0:
            return values[:0], q[:, :0], values[:0]
        residuals = np.linalg.norm(y[:, :k] - q[:, :k] * values[:k], axis=0) / values[0]
        worst = residuals.max()
        if best is None or worst < best[3]:
            last, best = (best[3] if best else np.inf), (values[:k].copy(), q[:, :k].copy(), residuals, worst)
        else:
            last = worst
        if worst <= tolerance or b == data.dim or (best[3] <= 1e-12 and worst > last / 4):  # at rounding level: it falls no more
            break
        cut_at = max(values[-1], 1e-3 * values[0])
        half = cut_at / 2
        sigma = first = half / (values[0] - half)
        before, now = q, (y - half * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now, sigma = now, (data.times(now) - half * now) * (2 * after / half) - sigma * after * before, after
        q = np.linalg.qr(now)[0]
    values, vectors, residuals, _ = best
    some = values > 1e-12 * values[0]
    return values[some], vectors[:, some], residuals[some]


def projected(batches, mean: np.ndarray, sums_: list[int], n: int, q: np.ndarray, share: np.ndarray, error: float):
    """vec_id, x -> the rows of all components of each vector. Deviations are whole numbers modulo 2**64, null where they are 2**63 or more."""
    k, wrapped = q.shape[1], np.array([s & (1 << 64) - 1 for s in sums_], np.uint64)
    for batch in batches:
        for low, x in matrices(batch.column(1), len(mean)):
            c = x - mean
            d = np.uint64(n & (1 << 64) - 1) * x.view(np.uint64) - wrapped
            size = ((c * n) ** 2).sum(1)
            deviation = pa.array(np.repeat((d * d).sum(1, dtype=np.uint64).view(np.int64), k), mask=np.repeat(size >= 2.0**63, k))
            ids = batch.column(0).slice(low, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n, np.int64)), deviation,
                    pa.array((c @ q).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(m, error))
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, block: int = 32, degree: int = 12, cycles: int = 40,
) -> DataFrame:
    """A row for each usable row of df and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out. An entry c counts as the whole number x = floor(scale c)
    (at the ends of 64 bits where it lies beyond), missing entries of shorter vectors as 0. Every distinct x is fitted once. deviation is
    exact, or null from 2**63 on. Components stand for the largest eigenvalues of the covariance of x, each with one sign for all rows;
    there are fewer where fewer directions have a variance, so that a table of equal vectors, like an empty one, gives no rows. Where
    eigenvalues are equal, any basis of their space may come. Null and repeated ids are rows like any other. Other columns are not read.
    """
    rows = df.filter(F.col(vector_col).isNotNull() & finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("x")
    )
    data = Fitted(rows.select("x"))
    values, vectors, _ = eigenvectors(data, components, block, degree, cycles) if data.n > 1 else (np.zeros(0), np.zeros((data.dim, 0)), None)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    q = vectors / np.sqrt(values)
    error = float(np.abs(data.times(q, gram=True) - np.eye(len(values))).max())
    mean, sums_, n, share = data.mean, data.sums, data.n, values / data.trace
    return rows.mapInArrow(lambda it: projected(it, mean, sums_, n, q, share, error), schema)
