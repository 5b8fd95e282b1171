"""Embedding whitening by a one-sided Jacobi SVD.

Entries become whole numbers x = floor(256 c); the fit list is each distinct x vector once. The first
pass adds up n and S, exactly. The second centres the rows, and every task compresses its own, block
by block, to the triangle R of a QR decomposition; triangles are stacked and compressed again, eight at
a time, until one is left (TSQR): the covariance is never formed, so small deviations keep their digits.
Plane rotations then make R's columns orthogonal (one-sided Jacobi, disjoint pairs of columns at a time);
the rotations, accumulated, are the components and the columns' lengths over sqrt(n) the deviations. A
third pass adds up the covariance of the whitened fit list, whose distance from the identity is returned.

A task holds one block, one triangle or eight of them: dim x dim doubles each. The driver gets a model
for each vector length: dim x (components + 1) numbers; lengths are few, and every length is fitted by
itself. Rows are projected in a plain map, without a shuffle; only the distinct vectors are shuffled,
with partial aggregation, so a vector that a third of the rows hold does no harm.

Rows whose vector is null or holds null or non-finite entries are dropped; empty vectors have no
component and so no row. Repeated rows and ids keep their rows. Entries beyond 2^63/256 count as that
bound. A component without variance (equal vectors, fewer vectors than dimensions) has explained 0 and
whitened null; identity_error is over the others, null if there are none. A deviation that no long can
hold is null. Components that tie in variance are one orthonormal choice. Only the columns named are
returned, so others can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

SCALE, COMPONENTS, FAN_IN, BLOCK_BYTES = 256, 4, 8, 8 << 20
#: Columns count as orthogonal at this cosine.
TOLERANCE, SWEEPS = 1e-15, 60


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and x of the sound rows of (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.coalesce(~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    # a long's range, less what a double can't tell from its end
    bound = 9223372036854774784.0
    return rows.where(sound).select("vec_id", F.transform("e", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))).cast("long")).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the column x of a batch, without empty vectors."""
    column = batch.column("x")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        if dim:
            at = np.flatnonzero(sizes == dim)
            some = column if len(at) == len(sizes) else column.take(pa.array(at))
            yield dim, at, some.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for b in batches:
        dim = max(1, len(b.column("x").flatten()) // max(b.num_rows, 1))
        for part in shared.slices([b], max(1, BLOCK_BYTES // (8 * dim))):
            for length, at, x in by_length(part):
                yield length, at, x, part


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as whole numbers of any size."""
    low = (x & 0xFFFFFFFF).sum(axis=0)
    high = (x >> 32).sum(axis=0)
    return [int(h) * (1 << 32) + int(l) for h, l in zip(high, low)]


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and S by length; one row a task and length is summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = {}, {}
        for dim, _, x, _ in blocks(batches):
            n[dim] = n.get(dim, 0) + len(x)
            s[dim] = [a + b for a, b in zip(s.get(dim, [0] * dim), exact_sums(x))]
        for dim in n:
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n[dim]], pa.int64()), pa.array([[str(v) for v in s[dim]]], pa.list_(pa.string()))], ["dim", "n", "s"])

    parts = fit.mapInArrow(run, "dim int, n long, s array<string>").select("dim", "n", F.posexplode("s").alias("at", "v"))
    sums = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "at").collect():  # one number a dimension
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def differences(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: longs where all fit, else Python's whole numbers."""
    top = max(map(abs, s), default=0) + n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top < 1 << 62:
        return x * n - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    return (differences(x, n, s) / n).astype(np.float64)


def squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null beyond a long."""
    if d.dtype != object and (len(d) == 0 or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62):
        return (d * d).sum(axis=1).tolist()
    return [v if (v := sum(int(y) ** 2 for y in row)) < 1 << 63 else None for row in d]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, each with its largest entry positive."""
    dim = r.shape[1]
    a, v = np.array(r, np.float64).T.copy(), np.eye(dim)  # rows here are columns there
    size = dim + dim % 2
    places = np.arange(size)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(size - 1):
            p, q = places[: size // 2], places[size // 2 :][::-1]
            real = (p < dim) & (q < dim)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            x, y = a[p], a[q]
            xx, yy, xy = (np.einsum("ij,ij->i", s, t) for s, t in ((x, x), (y, y), (x, y)))
            scale = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > TOLERANCE * scale
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / np.maximum(scale[turn], 1e-300)).max()))
                p, q, x, y = p[turn], q[turn], x[turn], y[turn]
                with np.errstate(over="ignore"):  # an endless zeta is no turn
                    zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
                x, y = v[p], v[q]
                v[p], v[q] = c * x - s * y, s * x + c * y
            places = np.concatenate([places[:1], np.roll(places[1:], 1)])
        if worst < 64 * TOLERANCE:
            break
    lengths = np.sqrt(np.einsum("ij,ij->i", a, a))
    order = np.argsort(-lengths, kind="stable")
    lengths, v = lengths[order], v[order]
    v *= np.where(v[np.arange(dim), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return lengths, v.T


def triangles(fit: DataFrame, known: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """(dim, part, r): one triangle a task and length, r its entries row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dim, _, x, _ in blocks(batches):
            rows = centred(x, *known[dim])
            held[dim] = triangle(np.concatenate([held[dim], rows]) if dim in held else rows)
        part = TaskContext.get().partitionId()
        for dim, r in held.items():
            yield _row(dim, part, r)

    return fit.mapInArrow(run, "dim int, part int, r binary")


def _row(dim: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(r, np.float64).tobytes()], pa.binary())], ["dim", "part", "r"])


def reduced(parts: DataFrame) -> DataFrame:
    """One triangle a length: FAN_IN at a time, so a group holds no more than so many."""
    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held = key[0].as_py(), None
        for b in batches:
            for x in b.column("r"):
                rows = np.frombuffer(x.as_py(), np.float64).reshape(-1, dim)
                held = triangle(rows if held is None else np.concatenate([held, rows]))
        yield _row(dim, key[1].as_py(), held)

    parts = shared.cut(parts)
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        grouped = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("dim", "part")
        parts = shared.cut(grouped.applyInArrow(one, "dim int, part int, r binary"))
    return parts


class Model:
    """Of one vector length: n, S, the first components as columns, their deviations (0: none), and each one's share of the variance."""

    def __init__(self, n: int, s: list[int], lengths: np.ndarray, v: np.ndarray, components: int = COMPONENTS):
        self.n, self.s, k = n, s, min(components, len(s))
        self.v, deviations = v[:, :k], lengths / np.sqrt(n)
        variance = deviations**2
        # less than rounding leaves of an exact zero
        self.sd = np.where(lengths[:k] > lengths[0] * len(s) * np.finfo(float).eps, deviations[:k], 0.0) if len(lengths) and lengths[0] > 0 else np.zeros(k)
        self.explained = np.where(self.sd > 0, variance[:k] / variance.sum(), 0.0) if variance.sum() > 0 else np.zeros(k)
        self.identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN where a component has no variance."""
        y = centred(x, self.n, self.s) @ self.v
        return np.divide(y, self.sd, out=np.full(y.shape, np.nan), where=np.broadcast_to(self.sd > 0, y.shape))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by length of distinct vectors x, which should be a stored table."""
    known = moments(fit)
    if not known:
        return {}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, r in zip(b.column("dim").to_pylist(), b.column("r").to_pylist()):
                lengths, v = jacobi(np.frombuffer(r, np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([lengths.tolist()]), pa.array([v[:, :components].ravel().tolist()])], ["dim", "lengths", "v"])

    models = {}
    for r in reduced(triangles(fit, known)).mapInArrow(solve, "dim int, lengths array<double>, v array<double>").collect():  # dim x components numbers a length
        dim = r["dim"]
        models[dim] = Model(*known[dim], np.array(r["lengths"]), np.array(r["v"]).reshape(dim, -1), components)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, _, x, _ in blocks(batches):
            y = np.nan_to_num(models[dim].whitened(x))
            y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
            sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, z in sums.items():
            k = len(z)
            yield pa.RecordBatch.from_arrays([pa.array([dim] * k * k, pa.int32()), pa.array(np.arange(k * k, dtype=np.int32)), pa.array(z.ravel())], ["dim", "at", "z"])

    found: dict[int, dict[int, float]] = {}
    for r in fit.mapInArrow(products, "dim int, at int, z double").groupBy("dim", "at").agg(F.sum("z").alias("z")).collect():  # (components + 1)^2 numbers a length
        found.setdefault(r["dim"], {})[r["at"]] = r["z"]
    for dim, z in found.items():
        m, k = models[dim], models[dim].v.shape[1]
        y = np.array([z[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
        mean = y[k, :k] / m.n  # zero but for rounding
        live = m.sd > 0
        error = np.abs(y[:k, :k] / m.n - np.outer(mean, mean) - np.eye(k))[live][:, live]
        m.identity_error = float(error.max()) if live.any() else None
    return models


def projected(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """From (vec_id, x): a row for each component of its length's model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, at, x, part in blocks(batches):
            m = models[dim]
            k, ids = m.v.shape[1], part.column("vec_id").take(pa.array(at))
            each = np.repeat(np.arange(len(x)), k)
            white = m.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)),
                pa.array(squares(differences(x, m.n, m.s)), pa.int64()).take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(m.explained, len(x))), pa.array([m.identity_error] * len(each), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """From (vec_id, embedding): vec_id, component, n, deviation, whitened, explained and identity_error, up to so many components of each sound row."""
    sound, spark = quantised(rows), rows.sparkSession
    shared.small_batches(spark)
    path = shared.fresh_path(spark, "whitening-fit")
    sound.select("x").distinct().write.parquet(path)
    return projected(sound, fitted(spark.read.parquet(path), components))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(shared.table(spark, sf_dir, "embeddings"))
