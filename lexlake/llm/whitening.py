"""Whitening of embeddings: blockwise QR, a bidiagonal qd solver, twisted factorisations.

Vectors are put on an integer grid, so sums are exact. Over the distinct grid vectors, every task reduces its centred rows to a triangle
by QR of one block after the other, and triangles are put together in groups of FAN_IN until one is left: R, as large as the number of
dimensions, whatever the number of rows. On the driver Householder reflections make R bidiagonal, dqds finds its squared singular values to
high relative accuracy, and for each wanted one a twisted factorisation of the shifted LDL' form gives the singular vector without iteration.
Vectors of values that lie close together are made orthogonal to each other. What is applied to rows is a matrix of dimensions x components.

Defined results: a row is left out if its vector is null, has null, NaN or infinite entries, entries beyond +-2^34 (the grid's
range), or another number of entries than most vectors have (of several, the largest number); ids may be null or repeated, every row is returned; components
whose variance is zero to working precision don't exist, so equal vectors alone give none; equal variances leave the choice of directions
between them open; deviation is null beyond the range of a long; an empty table gives an empty result; very long vectors cost memory by the square
of their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
FAN_IN = 32
_BLOCK_ROWS = 4096
_LARGEST = float(1 << 34)
_EPS = float(np.finfo(float).eps)
#: Singular values closer than this part of their size share an orthogonal basis.
_CLOSE = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """d, e and V such that r = U B V' with B upper bidiagonal (diagonal d, above it e), by Householder reflections from both sides."""
    a, n = r.astype(float).copy(), r.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if size == 0 or not np.any(x[1:]):
            return None
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :]) if k + 2 < n else None
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform of the qd array by that shift, and the least value met; None if the shift is too large."""
    new_q, new_e = [0.0] * len(q), [0.0] * len(e)
    d = least = q[0] - shift
    for i, held in enumerate(e):
        if d < 0:
            return None
        new_q[i] = d + held
        part = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
        new_e[i] = held * part
        d = (d * part if new_q[i] > 0 else q[i + 1]) - shift
        least = min(least, d)
    new_q[-1] = d
    return (new_q, new_e, least) if d >= 0 else None


def squared_singular_values(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of an upper bidiagonal matrix, falling, by dqds with shifts that are withdrawn where they are too large."""
    q, e_ = (d * d).tolist(), (e * e).tolist()
    found: list[float] = []
    total = 0.0
    guess = 0.0
    tiny = _EPS * _EPS
    while q:
        if len(q) == 1 or e_[-1] <= tiny * (total + q[-1]) or e_[-1] < np.finfo(float).tiny:
            found.append(total + q.pop())
            if e_:
                e_.pop()
            guess = 0.0
            continue
        for shift in (guess, guess / 4, 0.0):
            made = _dqds(q, e_, shift)
            if made:
                break
        q, e_, least = made
        total += shift
        # the least value met bounds the least eigenvalue from above, and comes close to it as the last row separates
        guess = least * (1 - min(0.5, 4 * (e_[-1] / q[-2]) ** 0.5)) if q[-2] > 0 and q[-1] == least else 0.25 * least
    return np.sort(np.maximum(found, 0.0))[::-1]


class _Twisted:
    """Eigenvectors of B'B = LDL' by twisted factorisations of LDL' - value."""

    def __init__(self, d: np.ndarray, e: np.ndarray):
        floor = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0)) * 1e-30 or 1.0
        d = np.where(np.abs(d) < floor, floor, d)
        self.d, self.l = d * d, np.append(e / d[:-1], 0.0)
        self.small = float(np.finfo(float).tiny) ** 0.5

    def vectors(self, value: float) -> Iterator[np.ndarray]:
        """Unit vectors by twist index, from the one with the smallest twist on."""
        n, d, low, small = len(self.d), self.d.tolist(), self.l.tolist(), self.small
        down, s = [0.0] * n, [0.0] * n  # L of the factorisation from the top, and its auxiliary values
        up, p = [0.0] * n, [0.0] * n  # U of the one from the bottom
        s[0] = -value
        for i in range(n - 1):
            pivot = s[i] + d[i]
            pivot = pivot if abs(pivot) > small else small
            down[i] = d[i] * low[i] / pivot
            s[i + 1] = down[i] * low[i] * s[i] - value
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * low[i] * low[i] + p[i + 1]
            pivot = pivot if abs(pivot) > small else small
            part = d[i] / pivot
            up[i] = low[i] * part
            p[i] = p[i + 1] * part - value
        twist = np.abs(np.array(s) + np.array(p) + value)
        for r in np.argsort(np.where(np.isfinite(twist), twist, np.inf), kind="stable").tolist():
            z = np.zeros(n)
            z[r] = 1.0
            for i in range(r - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(r, n - 1):
                z[i + 1] = -up[i] * z[i]
            size = np.linalg.norm(z)
            if np.isfinite(size):
                yield z / size


def right_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Columns: right singular vectors of the bidiagonal matrix for the first `wanted` of its squared singular values, falling."""
    twisted, out = _Twisted(d, e), np.zeros((len(d), wanted))
    group = 0
    for k in range(wanted):
        if k and values[k - 1] - values[k] > _CLOSE * values[k - 1]:
            group = k
        close = out[:, group:k]
        best, left = None, 0.0
        for z in twisted.vectors(float(values[k])):  # within a group the first whose own part is large enough
            own = z - close @ (close.T @ z)
            size = np.linalg.norm(own)
            if size > left:
                best, left = own / size, size
            if left > 0.3:
                break
        best -= close @ (close.T @ best)
        out[:, k] = best / np.linalg.norm(best)
    return out


@dataclass
class Whitening:
    """n vectors with sums per dimension; directions (dimensions x components), their variances, and the sum of all variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def deltas(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the floor of the mean, exact, and what the mean has beyond that floor."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        return x - floor, np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        exact, rest = self.deltas(x)
        return (exact - rest) @ self.directions / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sum) squared over the dimensions of each row, exact; None beyond a long."""
        exact, _ = self.deltas(x)
        rest = [s % self.n for s in self.sums]
        if not len(x) or (float(np.abs(exact).max()) + 1) * self.n < (2**62 / max(1, x.shape[1])) ** 0.5:
            own = exact * self.n - np.array(rest, np.int64)
            return (own * own).sum(axis=1).tolist()
        every = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in exact]
        return [v if v < 1 << 63 else None for v in every]


def grid(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, the vector's grid points floor(scale * c) + offset, of the rows that have a whole vector."""
    entries = common.column(vector).cast("array<double>")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= _LARGEST))
    good = df.select(common.column(vec_id).cast("long").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & F.coalesce(whole, F.lit(False)))
    most = good.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kept = good.where(F.size("c") == (most["size"] if most else 0))
    return kept.select("vec_id", F.transform("c", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([_matrix(batch.column(0)).sum(axis=0)], pa.list_(pa.int64()))], ["n", "s"])

    parts = fit.select("x").mapInArrow(run, "n long, s array<long>")
    rows = parts.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _triangle(fit: DataFrame, centre: Whitening) -> np.ndarray:
    """R of the centred rows of fit: a triangle for each task, then for groups of FAN_IN triangles, until one is left."""

    def rows(r: np.ndarray) -> pa.Array:
        return pa.array(list(r), pa.list_(pa.float64()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                exact, rest = centre.deltas(_matrix(batch.column(0).slice(at, _BLOCK_ROWS)))
                block = exact - rest
                r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([rows(r)], ["r"])

    def merge(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(_matrix(table.column("r").combine_chunks(), float), mode="r")
        return pa.table({"part": pa.array(np.full(len(r), table.column("part")[0].as_py() // FAN_IN)), "r": rows(r)})

    parts = common.stored(fit.select("x").mapInArrow(first, "r array<double>").select(F.spark_partition_id().cast("long").alias("part"), "r"))
    while parts.where("part > 0").limit(1).count():
        parts = common.stored(parts.groupBy(F.expr(f"part div {FAN_IN}").alias("up")).applyInArrow(merge, "part long, r array<double>"))
    r = np.array([row["r"] for row in parts.collect()])
    r = np.linalg.qr(r, mode="r")
    return np.vstack((r, np.zeros((r.shape[1] - len(r), r.shape[1]))))


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first components of the grid vectors x of fit, each counted once for each of its rows; None without rows."""
    n, sums = _sums(fit)
    if not n:
        return None
    centre = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    d, e, right = bidiagonal(_triangle(fit, centre))
    values = squared_singular_values(d, e)
    wanted = int(np.sum(values[:components] > values[0] * (len(d) * _EPS) ** 2 * 16)) if len(values) and values[0] > 0 else 0
    directions = right @ right_vectors(d, e, values, wanted)
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(wanted)]) if wanted else np.ones(0)
    return Whitening(n, sums, directions * signs, values[:wanted] / n, float(values.sum()) / n)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column(0)))
                total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])

    rows = fit.select("x").mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    total = np.array([r["total"] for r in rows]) / model.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(points: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array of the components) of each row (vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                x = _matrix(batch.column(1).slice(at, _BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, _BLOCK_ROWS), pa.array(model.deviation(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "whitened"],
                )

    return points.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grid(common.read(spark, sf_dir, "embeddings"))
    fit = common.stored(points.select("x").distinct())
    model = fit_whitening(fit)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    rows = whiten(points, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(fit, model)).alias("identity_error"),
    )


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
#: Eigenvectors have no SQL counterpart; tests/llm compares with numpy.
SQL: dict[str, str] = {}
