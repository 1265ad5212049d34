import math

import numpy as np
import pytest

from lexlake.llm import whitening as W

TYPE = "vec_id long, embedding array<double>, x string, at string, whitened string"


def brute(vectors):
    """n, sums, all variances (falling) and their directions of the distinct grid vectors."""
    x = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], directions[:, ::-1]


def check(rows, table, components=16, rtol=1e-6):
    """rows against brute force over table, (vec_id, vector)."""
    n, sums, values, directions = brute([v for _, v in table])
    wanted = min(components, int(np.sum(values > values[0] * 1e-12)))
    assert len(rows) == len(table) * wanted
    by = {}
    for r in rows:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert set(by) == set(range(1, wanted + 1))
    for k, own in by.items():
        proj = {i: sum((math.floor(64 * c) + 1_000_000 - s / n) * d for c, s, d in zip(v, sums, directions[:, k - 1], strict=True)) / math.sqrt(values[k - 1]) for i, v in table}
        some = max(proj, key=lambda i: abs(proj[i]))
        sign = np.sign(proj[some] * own[some]["whitened"])
        for i, v in table:
            r = own[i]
            assert r["n"] == n and r["deviation"] == sum((n * (math.floor(64 * c) + 1_000_000) - s) ** 2 for c, s in zip(v, sums, strict=True))
            assert abs(r["whitened"] - sign * proj[i]) < rtol * 10
            assert abs(r["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-8 and r["identity_error"] < 1e-8


def run(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op13_embedding_whitening(spark, str(tmp_path)).collect()


def test_query_against_brute_force(spark, sf_dir):
    rows = W.op13_embedding_whitening(spark, sf_dir)
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows.collect(), table)


def test_edges(spark, tmp_path):
    draw = np.random.default_rng(3)
    good = [(k, [float(c) for c in v]) for k, v in enumerate(draw.normal(size=(40, 3)) * [3, 1, 0.2])]
    good.append((100, good[0][1]))  # the same vector again
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, math.nan, 2.0]), (203, [math.inf, 0.0, 0.0]), (204, [1.0, 2.0]), (205, []), (206, [1e300, 0.0, 0.0])]
    rows = run(spark, tmp_path / "a", spark.createDataFrame([(i, v, "a", "b", "c") for i, v in good + bad], TYPE).repartition(7))
    check(rows, good)
    assert run(spark, tmp_path / "none", spark.createDataFrame([], TYPE)) == []
    assert run(spark, tmp_path / "same", spark.createDataFrame([(k, [1.0, 2.0], "a", "b", "c") for k in range(5)], TYPE)) == []
    assert run(spark, tmp_path / "lost", spark.createDataFrame([(1, None, "a", "b", "c")], TYPE)) == []
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]  # one direction only
    check(run(spark, tmp_path / "flat", spark.createDataFrame([(i, v, "a", "b", "c") for i, v in flat], TYPE)), flat)
    few = [(k, [float(c) for c in v]) for k, v in enumerate(draw.normal(size=(4, 10)))]  # fewer rows than dimensions
    check(run(spark, tmp_path / "few", spark.createDataFrame([(i, v, "a", "b", "c") for i, v in few], TYPE)), few)
    nameless = spark.createDataFrame([(None, [float(k), k * k / 3.0], "a", "b", "c") for k in range(5)], TYPE)
    assert len(run(spark, tmp_path / "null", nameless)) == 10


def test_deviation_beyond_a_long():
    model = W.Whitening(3, [3, 5], np.zeros((2, 0)), np.zeros(0), 0.0)
    assert model.deviation(np.array([[2, 1], [1 << 40, 0]])) == [(6 - 3) ** 2 + (3 - 5) ** 2, None]
    assert model.deviation(np.array([[1 << 29, 0]])) == [(3 * (1 << 29) - 3) ** 2 + 25]


@pytest.mark.parametrize("seed", range(6))
def test_solver(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(1, 40))
    r = np.triu(draw.normal(size=(n, n))) * np.exp(draw.normal(size=n) * seed)
    d, e, right = W.bidiagonal(r)
    assert np.allclose(right.T @ right, np.eye(n), atol=1e-12)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(right @ b.T @ b @ right.T, r.T @ r, atol=1e-10 * np.abs(r).max() ** 2)
    values = W.squared_singular_values(d, e)
    exact = np.linalg.svd(b, compute_uv=False)
    assert np.allclose(np.sqrt(values), exact, rtol=1e-9, atol=1e-13 * exact[0])
    z = W.right_vectors(d, e, values, n)
    assert np.abs(z.T @ z - np.eye(n)).max() < 1e-7
    assert np.abs(b.T @ b @ z - z * values).max() < 1e-9 * values[0]


def test_values_are_accurate_to_their_own_size():
    # a graded matrix whose least singular value follows from the determinant: the product of the diagonal
    d, e = 10.0 ** -np.arange(0, 40, 4), 10.0 ** -np.arange(1, 37, 4)
    values = W.squared_singular_values(d, e)
    assert abs(np.prod(np.sqrt(values)) / np.prod(d) - 1) < 1e-13


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1], [3.0] * 8, [4, 4 + 1e-13, 4 - 1e-12, 1, 1, 0.5]])
def test_equal_values(values):
    draw = np.random.default_rng(1)
    q, _ = np.linalg.qr(draw.normal(size=(len(values),) * 2))
    r = np.linalg.qr(np.diag(np.sqrt(values)) @ q.T, mode="r")
    d, e, right = W.bidiagonal(r)
    found = W.squared_singular_values(d, e)
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-12)
    z = right @ W.right_vectors(d, e, found, len(values))
    assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-10 and np.abs(r.T @ r @ z - z * found).max() < 1e-10
