"""Whitening against a plain decomposition, and its eigenvectors where eigenvalues cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import whitening as W


def columns(spark, rows):
    out = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for c in ("v", "d", "n", "component", "parts", "a.b"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def plain(vectors):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = [[n * int(v) - int(t) for v, t in zip(r, s, strict=True)] for r in x]
    about = np.array(y, dtype=float) / n
    cov = about.T @ about / n
    values, turn = np.linalg.eigh(cov)
    return about, cov, values[::-1], turn[:, ::-1], [sum(v * v for v in r) for r in y]


@pytest.mark.parametrize("d", [4, 40])
def test_against_plain(spark, d):
    rng = np.random.default_rng(d)
    good = (rng.normal(size=(300, d)) * np.linspace(0.2, 3, d)).astype(np.float32)
    good[7] = good[8]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(good)]
    bad = [(900, None), (901, [None] + [0.0] * (d - 1)), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, [1.0] * (d - 1)), (905, [])]
    got = W.whiten(columns(spark, [*rows, *bad])).orderBy("vec_id", "component").toPandas()
    kept = min(d, 32)
    assert len(got) == len(rows) * kept and set(got.n) == {300} and list(got.columns) == W.ORDER
    about, cov, values, turn, deviation = plain(good)
    z = about @ turn[:, :kept] / np.sqrt(values[:kept])
    mine = got.whitened.to_numpy().reshape(-1, kept)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9
    assert got.deviation.tolist()[::kept] == deviation
    assert np.allclose(got.explained.to_numpy()[:kept], values[:kept] / np.trace(cov), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_odd_tables(spark):
    assert W.whiten(columns(spark, [(1, None), (2, [])])).collect() == []
    lone = W.whiten(columns(spark, [(None, [0.5, 1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in lone] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    flat = W.whiten(columns(spark, [(1, [0.0, 5.0]), (1, [0.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert len(flat) == 6 and sorted({abs(round(r.whitened, 9)) for r in flat}) == [0.0, 0.707106781, 1.414213562] and flat[0].identity_error < 1e-12
    huge = W.whiten(columns(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert [r.deviation for r in huge if r.vec_id != 3] == [None, None]


@pytest.mark.parametrize("values", [[5] * 10 + [1] * 10 + [1 + 1e-9 * i for i in range(10)], [1 + 1e-12 * i for i in range(30)], [2] * 30, list(range(1, 31)), [0] * 25 + [1] * 5])
def test_eigenvectors_of_clusters(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(30, 30)))
    values = np.array(values, dtype=np.longdouble)
    a = (q.astype(np.longdouble) * values) @ q.T
    got, x = W.eigen((a + a.T) / 2)
    assert np.abs(x.T @ x - np.eye(30)).max() < 5e-15
    x = x.astype(np.longdouble)
    seen = x.T @ a @ x
    assert np.abs(seen - np.diag(np.diag(seen))).max() < 1e-14
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14 * float(values.max())


def test_iteration_beats_its_start():
    """The float32 vectors are off by 1e-6 or more; corrected ones agree with extended precision to double's last digits."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(50, 50))
    a = (a @ a.T).astype(np.longdouble)
    _, start = np.linalg.eigh(a.astype(np.float32))
    _, x = W.eigen(a)
    rest = lambda v: float(np.abs(a @ v - v * np.einsum("ij,ij->j", v, a @ v)).max())
    assert rest(start.astype(np.longdouble)) > 1e-6 and rest(x.astype(np.longdouble)) < 1e-13
