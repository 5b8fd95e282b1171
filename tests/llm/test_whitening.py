"""Whitening against plain linear algebra in exact or long arithmetic."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rubrica.llm import whitening

KIND = "vec_id long, embedding array<float>, component string"


def brute(vectors, components=4):
    """By length: n, S, deviation by vector, and components by the eigenvalues of the covariance."""
    out = {}
    for dim in {len(v) for v in vectors}:
        xs = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors if len(v) == dim})
        n, s = len(xs), [sum(c) for c in zip(*xs)]
        m = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in xs])
        e, v = np.linalg.eigh(m.T @ m / n)
        out[dim] = n, s, e[::-1], v[:, ::-1]
    return out


def check(rows, vectors, components=4):
    want = brute([v for _, v in vectors if v])
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, v in vectors:
        if not v:
            continue
        n, s, e, comps = want[len(v)]
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        for k in range(min(components, len(v))):
            r = by[i, k + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
            assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9, abs=1e-12) and r["identity_error"] < 1e-10
            if r["whitened"] is not None:
                score = sum((a - b / n) * c for a, b, c in zip(x, s, comps[:, k])) / math.sqrt(e[k])
                assert abs(r["whitened"]) == pytest.approx(abs(score), rel=1e-6, abs=1e-8)
    for dim in want:
        for k in range(1, min(components, dim) + 1):
            signs = {np.sign(r["whitened"]) * np.sign(sum((256 * float(np.float32(c)) // 1 - b / want[dim][0]) * w for c, b, w in zip(v, want[dim][1], want[dim][3][:, k - 1]))) for i, v in vectors if len(v) == dim for r in by[i, k] if r["whitened"] and abs(r["whitened"]) > 1e-6}
            assert len(signs) <= 1


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.arange(1, 13) * 0.1
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(1000 + i, base[0].tolist()) for i in range(150)]  # a third of all rows
    vectors += [(2000 + i, rng.standard_normal(3).tolist()) for i in range(40)]
    vectors += [(3000, [])]
    odd = [(4000, None), (4001, [1.0, None] * 6), (4002, [math.nan] * 12), (4003, [math.inf] * 12)]
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], KIND).repartition(13)
    got = whitening.whitened(rows).collect()
    assert len(got) == 4 * 450 + 3 * 40
    check(got, vectors)
    assert {r["n"] for r in got if r["vec_id"] < 2000} == {300}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = whitening.op12_whitening(spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), [(r["vec_id"], list(r["embedding"])) for r in table])


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [0.5, -0.25, 1.0], "x") for i in range(5)] + [(None, [0.5, -0.25, 1.0], "x")], KIND)
    got = whitening.whitened(same).collect()
    assert len(got) == 18 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), float(2 * i)], "x") for i in range(7)], KIND)
    got = whitening.whitened(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and {r["explained"] for r in got if r["component"] == 1} == {1.0}
    assert whitening.whitened(same.where("false")).count() == 0
    wide = spark.createDataFrame([(i, [float(i == j) for j in range(9)], "x") for i in range(3)], KIND)
    assert sum(r["whitened"] is not None for r in whitening.whitened(wide).collect()) == 3 * 2  # three vectors span two dimensions
    huge = spark.createDataFrame([(1, [3e38, 1.0], "x"), (2, [-3e38, 0.0], "x"), (3, [0.0, 5.0], "x")], KIND)
    assert all(r["deviation"] is None for r in whitening.whitened(huge).where("vec_id < 3").collect())


@given(st.integers(1, 9), st.integers(1, 30), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_jacobi(dim, rows, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((rows, dim)) * 10.0 ** rng.integers(-6, 6, dim)
    r = whitening.triangle(a[: rows // 2]) if rows > 1 else a[:0]
    r = whitening.triangle(np.concatenate([r, a[rows // 2 :]]))  # in blocks
    lengths, v = whitening.jacobi(r)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(dim), atol=1e-13) and np.allclose(lengths[: len(want)], want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.allclose(a @ v / max(want[0], 1e-300), (a @ v) / max(want[0], 1e-300)) and all(np.abs((a @ v)[:, i] @ (a @ v)[:, j]) <= 1e-10 * want[0] ** 2 for i in range(dim) for j in range(i))


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(0)
    a = np.linalg.qr(rng.standard_normal((50, 4)))[0] * [1e8, 1, 1e-4, 1e-8]  # a covariance would lose the last two
    assert np.allclose(whitening.jacobi(whitening.triangle(a))[0], [1e8, 1, 1e-4, 1e-8], rtol=1e-12)


def test_exact_arithmetic():
    x = np.array([[2**62, -5], [2**62, 3], [7, 2**61]], np.int64)
    assert whitening.exact_sums(x) == [2 * 2**62 + 7, 2**61 - 2]
    s = whitening.exact_sums(x)
    assert whitening.squares(whitening.differences(x, 3, s)) == [None] * 3
    small = np.array([[1, 2], [3, 5]], np.int64)
    assert whitening.squares(whitening.differences(small, 2, [4, 7])) == [4 + 9, 4 + 9]
