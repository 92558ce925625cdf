"""Block matrices and tall factors against numpy."""

import numpy as np
import pytest

from loomline.operators import blocks

S = 4


def entries(spark, a):
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(a)] + [(0, 0, None)], "i long, j long, value double")


def dense(df, shape):
    out = np.zeros((-(-shape[0] // S) * S, -(-shape[1] // S) * S))
    for r in df.collect():
        out[r.i * S : r.i * S + S, r.j * S : r.j * S + S] = np.array(r.block).reshape(S, S)
    assert not out[shape[0] :].any() and not out[:, shape[1] :].any()
    return out[: shape[0], : shape[1]]


def test_products(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(9, 22)), rnd.normal(size=(22, 6))
    left, right = (blocks.to_blocks(entries(spark, m), S) for m in (a, b))
    assert np.allclose(dense(blocks.product(left, right, S), (9, 6)), a @ b, atol=1e-12)
    back = np.zeros_like(a)
    for r in blocks.to_entries(left, S).collect():
        back[r.i, r.j] = r.value
    assert np.array_equal(back, a)


def test_inverse_root_and_exponential(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(20, 6))
    g = x.T @ x
    root = dense(blocks.inverse_root(blocks.to_blocks(entries(spark, g), S), 6, size=S), (6, 6))
    assert np.abs(root @ g @ root - np.eye(6)).max() < 1e-9
    a = rnd.normal(size=(5, 5))
    values, vectors = np.linalg.eig(a)
    want = (vectors * np.exp(values) @ np.linalg.inv(vectors)).real
    assert np.allclose(dense(blocks.exponential(blocks.to_blocks(entries(spark, a), S), 5, size=S), (5, 5)), want, atol=1e-9)


def test_tall(spark):
    rnd = np.random.default_rng(3)
    x, w = rnd.normal(size=(300, 5)), np.array([1.0, -2.0, 0.5, 0.0, 3.0])
    y = x @ w + rnd.normal(size=300) * 0.1
    rows = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))] + [(900, None, 1.0), (901, [1.0] * 5, None), (902, [1.0, None, 1.0, 1.0, 1.0], 2.0)], "id long, v array<double>, y double").repartition(20)
    known = rows.where("id < 300")
    assert np.allclose(blocks.singular_values(known, "v"), np.linalg.svd(x, compute_uv=False), atol=1e-9)
    got, error = blocks.least_squares(rows, "v", "y")
    want, residual, _, _ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(got, want, atol=1e-9) and abs(error - residual[0]) < 1e-9
    q = blocks.orthonormal(known, "v").collect()
    m = np.array([r.v for r in q])
    assert np.abs(m.T @ m - np.eye(5)).max() < 1e-10
    assert np.abs(m @ (m.T @ x[[r.id for r in q]]) - x[[r.id for r in q]]).max() < 1e-9
    with pytest.raises(ValueError):
        blocks.orthonormal(spark.createDataFrame([([1.0, 1.0],), ([2.0, 2.0],), ([3.0, 3.0],)], "v array<double>"), "v").collect()
    assert len(blocks.singular_values(known.limit(0), "v")) == 0
