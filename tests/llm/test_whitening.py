"""Operator 13 against numpy's dense eigenvalues and exact integers."""

import math

import numpy as np
import pytest

from newsquant.llm import whitening

TESTDATA = "/root/testdata"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 130])
def test_components_of_random_matrices(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    _check(a @ a.T)


@pytest.mark.parametrize("a", [np.eye(9), np.zeros((4, 4)), np.diag([3.0, 3, 3, 1, 1, 0]), np.ones((6, 6)), np.array([[1024.0, -1024], [-1024, 1024]]), np.diag([1.0, 1 + 1e-13, 1 - 1e-13, 1e-9])])
def test_components_of_clustered_values(a):
    _check(np.array(a))


def _check(a):
    values, vectors = whitening.leading_components(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    top = max(want[0], 1e-30)
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * top)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * top


def check_rows(rows, vectors):
    """``rows`` of the operator against the definition over ``vectors``, lists of finite numbers of one length."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=np.float64) / n
    matrix = centred.T @ centred / n
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    real = values > 1e-9 * values[0]
    values, basis = values[real], basis[:, real]
    assert len(rows) == len(vectors) * len(values)
    own = {}
    for row in rows:
        own.setdefault(row[0], {})[row["component"]] = row
    for (key, _), v in zip(vectors, x):
        off = [n * c - s for c, s in zip(v, sums)]
        want = np.array(off, dtype=np.float64) / n @ basis / np.sqrt(values)
        got = own[key]
        assert sorted(got) == list(range(1, len(values) + 1))
        for k, row in got.items():
            assert row["n"] == n and row["deviation"] == sum(o * o for o in off)
            assert abs(abs(row["whitened"]) - abs(want[k - 1])) < 1e-7
            assert abs(row["explained"] - values[k - 1] / np.trace(matrix)) < 1e-10
            assert row["identity_error"] < 1e-8


def test_query_against_definition(spark):
    sf = f"{TESTDATA}/sf0.01"
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    usable = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = whitening.op13_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_rows(out.collect(), usable)


def test_nulls_repeats_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    copies = [(100 + i, good[0][1]) for i in range(50)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    short = [(300 + i, rng.standard_normal(2).tolist()) for i in range(9)]
    rows = [(k, v, 1, "s") for k, v in good + copies + bad + short]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, key string")).collect()
    check_rows([r for r in out if r["vec_id"] < 200], good + copies)
    check_rows([r for r in out if r["vec_id"] >= 300], short)
    assert not [r for r in out if 200 <= r["vec_id"] < 300]


def test_null_ids_one_vector_and_empty_table(spark):
    kind = "vec_id long, embedding array<float>"
    two = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [1.0, 0.0])], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in two) == [(0, 1), (0, 1), (1, 1)]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []


def test_limits_raise(spark):
    kind = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], kind))
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], kind), most_dims=2)


def test_deviation_beyond_64_bits_is_exact():
    x, sums = np.array([[2**52 + 5, 7], [1, 2]], dtype=np.int64), np.array([10**16, 5], dtype=object)
    want = [sum((10**4 * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert [int(d) for d in whitening._deviation(x, 10**4, sums)] == want
