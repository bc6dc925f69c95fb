"""Whitening against a dense eigendecomposition in numpy."""

import numpy as np
import pytest

from corpusmill.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)


def dense(vectors, k):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    return n, deviation, y @ vecs / np.sqrt(values), values / (y**2).sum() * n


def compare(got, ids, vectors, k=8, close=1e-7):
    n, deviation, white, explained = dense(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == len(ids) * k
    own = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((own * white).sum(axis=0))
    assert np.abs(own * sign - white).max() < close
    assert [by[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in got} == {n}
    assert np.allclose([by[ids[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    w = own - own.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


def test_flat_spectrum_is_expanded(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((700, 40)).astype(np.float32).tolist()
    rows = list(enumerate(v))
    model = whitening.fit(whitening._usable(frame(spark, rows)))
    assert model.expanded and model.passes < whitening.POWER_PASSES
    compare(whitening.whiten(frame(spark, rows).repartition(5)).collect(), range(700), v)


def test_falling_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((600, 60)) * 0.55 ** np.arange(60) * 50 @ np.linalg.qr(rng.standard_normal((60, 60)))[0]).astype(np.float32).tolist()
    model = whitening.fit(whitening._usable(frame(spark, list(enumerate(v)))))
    assert not model.expanded and model.passes > 1
    compare(whitening.whiten(frame(spark, list(enumerate(v)))).collect(), range(600), v)


def test_odd_rows_have_no_part(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    v[7] = v[8]
    v[9] = [300.0] * 12
    bad = [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (1005, [1.0] * 9)]
    compare(whitening.whiten(frame(spark, [*enumerate(v), *bad])).collect(), range(300), v)


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 4])
def test_no_variance(spark, vectors):
    got = whitening.whiten(frame(spark, list(enumerate(vectors)))).collect()
    assert len(got) == 3 * len(vectors)
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)


def test_fewer_rows_than_components(spark):
    got = whitening.whiten(frame(spark, [(1, [0.0] * 20), (2, [1.0] * 20), (None, [2.0] + [1.0] * 19)])).collect()
    assert len(got) == 24 and {r["component"] for r in got if r["whitened"] is not None} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [(1, [1e30]), (2, [0.0]), (3, [0.0])])).collect()
    assert [r["deviation"] is None for r in sorted(got, key=lambda r: r["vec_id"])] == [True, True, True]
    assert all(abs(r["whitened"]) < 2 for r in got)


def test_empty_table(spark):
    out = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_op13(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op13_whitening"](spark, d).collect(), [i for i, _ in rows], [v for _, v in rows])
