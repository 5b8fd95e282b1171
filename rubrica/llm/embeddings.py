"""Embedding near-duplicates with randomised-rotation binary codes.

Every unit vector is turned by fixed random rotations and kept as signs, one bit a dimension, with a
correction factor: the inner product of the turned vector and its own code. For a pair, the inner
product of one vector with the other's code over that factor is an unbiased estimate of their cosine,
and its error has a known bound. Pairs whose upper confidence bound is under the threshold are
dropped; the cosine of the rest is recomputed exactly, in double precision.

Bits of the codes also say which pairs meet: each of ``tables`` bands of them is a bucket key. A pair
at the threshold differs in one bit with probability angle/pi, from which the number of bands follows
for the wanted recall; closer pairs are found all the more surely. The number of bits in a band grows
with the logarithm of the rows, so buckets keep their size.

A pair is counted in the first band in which it meets and nowhere else. Buckets give counts and
spanning links, never their pairs. A bucket over ``BLOCK`` rows is cut into blocks, and every two of
them are a task of their own, so that no group is unbounded; what n_links asks for, all links of a
dense group, is quadratic work in it by its nature. Equal vectors are one vector with a count.

Vectors of different lengths never link; those of each length are compared among themselves, with
rotations and bands of their own. Vectors that are null, empty, zero, or that hold null or non-finite
components link with nothing. Rows that repeat an id are separate vectors, each with
its own links and row. Null ids keep their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

THRESHOLD, RECALL, BLOCK, SPREAD, SEED = 0.95, 0.999, 2048, 4.0, 7


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band, and bands."""
    bits = max(4, math.ceil(math.log2(max(rows, 2))) - 6)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


@lru_cache(16)
def rotations(dim: int, bits: int) -> np.ndarray:
    """(dim, whole rotations): enough orthogonal ones, side by side, for so many bits."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(-(-bits // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def band_keys(units: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables)."""
    signs = (units @ turn > 0)[:, : bits * tables].reshape(len(units), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def matches(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, table: int, turn: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b are linked and meet first in this table."""
    dim = a.shape[1]
    ta, tb = a @ turn[:, :dim], b @ turn[:, :dim]
    code = np.where(ta > 0, 1.0, -1.0) / math.sqrt(dim)
    factor = np.maximum((code * ta).sum(axis=1), 1e-9)
    estimate = (code @ tb.T) / factor[:, None]
    error = SPREAD * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    i, j = np.nonzero(estimate + error[:, None] >= threshold)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        near = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
        x, y = x[near], y[near]
        first = (ka[x, :table] != kb[y, :table]).all(axis=1)
        out[x[first], y[first]] = True
    return out


def _forest(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    up = list(range(n))
    for x, y in zip(pairs[0].tolist(), pairs[1].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            yield x, y


def links(vectors: DataFrame, rows: dict[int, int], threshold: float = THRESHOLD) -> DataFrame:
    """From (key long, n long, unit array<double>), keys distinct, and the number of vectors by length: (a, b, n): n links that a has in some bucket (b null), or a spanning link. Lengths that aren't in rows are left out."""
    plans = {dim: plan(m, threshold) for dim, m in rows.items()}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sizes = part.column("unit").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes).tolist():
                    some = part if (sizes == dim).all() else part.filter(pa.array(sizes == dim))
                    bits, tables = plans[dim]
                    units = some.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    keys = band_keys(units, rotations(dim, bits * tables), bits, tables)
                    raw = pa.array([u.tobytes() for u in units], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), dim, np.int32)), pa.array(np.full(len(units), t, np.int32)), pa.array(keys[:, t]), some.column("key"), some.column("n"), raw], ["dim", "t", "band", "key", "n", "unit"])

    posts = vectors.where(F.size("unit").isin(list(rows))).mapInArrow(post, "dim int, t int, band long, key long, n long, unit binary")
    at_ = ["dim", "t", "band"]
    sizes = posts.groupBy(*at_).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = posts.join(sizes.drop("m"), at_).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # block i meets blocks i, i + 1, ... : each two once
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*at_, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "unit")

    def meet(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        dim, t, _, i, j = (int(x) for x in key)
        bits, tables = plans[dim]
        turn = rotations(dim, bits * tables)
        units = np.frombuffer(b"".join(g["unit"]), np.float64).reshape(-1, dim)
        keys, own, n, names = band_keys(units, turn, bits, tables), g["own"].to_numpy(), g["n"].to_numpy(), g["key"].to_numpy()
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        out = []
        counts = np.zeros(len(g), np.int64)
        xs, ys = [], []
        for p in range(0, len(left), BLOCK):
            for q in range(0, len(right), BLOCK):
                l, r = left[p : p + BLOCK], right[q : q + BLOCK]
                hit = matches(units[l], units[r], keys[l], keys[r], t, turn, threshold)
                if i == j:
                    hit &= l[:, None] < r[None, :]
                x, y = np.nonzero(hit)
                xs.append(l[x])
                ys.append(r[y])
                np.add.at(counts, l[x], n[r[y]])
                np.add.at(counts, r[y], n[l[x]])
        out += ((int(names[k]), None, int(counts[k])) for k in np.flatnonzero(counts))
        if xs:
            out += ((int(names[x]), int(names[y]), 0) for x, y in _forest(len(g), (np.concatenate(xs), np.concatenate(ys))))
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return met.groupBy(*at_, "i", "j").applyInPandas(meet, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """From (vec_id, embedding): vec_id, n_links, component_id and kept of every row."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    # scaled by the largest component first, so that no square overflows or vanishes
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    is_sound = F.coalesce((largest > 0) & (largest < float("inf")) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    scaled = shared.let(largest, lambda m: F.transform("embedding", lambda x: x / m))
    unit = shared.let(scaled, lambda e: shared.let(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(e, lambda x: x / n + F.lit(0.0))))
    sound = rows.where(is_sound).select("vec_id", unit.alias("unit"))
    same = sound.groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    same = shared.cut(same.withColumn("key", F.monotonically_increasing_id()))
    shapes = {r["dim"]: r["m"] for r in same.groupBy(F.size("unit").alias("dim")).agg(F.count("*").alias("m")).collect()}
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not shapes:
        return none.withColumn("kept", F.lit(True))
    found = shared.cut(links(same.select("key", "n", "unit"), {d: m for d, m in shapes.items() if m > 1}, threshold))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("far")).withColumnRenamed("a", "key")
    roots = shared.components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    each = same.select("key", "unit", "least", "n").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    each = each.join(least, "root").select("unit", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = sound.join(each, "unit").select("vec_id", "n_links", "component_id")
    unsound = rows.where(~is_sound)
    out = linked.union(unsound.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))
