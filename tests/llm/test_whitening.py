import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, length int, n long, x string"


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors):
    """Integers, centred integer products and doubles from them."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64).astype(object) + 1_000_000
    n = len(x)
    s = x.sum(axis=0)
    c = n * x - s
    v = np.array([[a / n**3 for a in r] for r in (c.T @ c).tolist()], float)
    e, u = np.linalg.eigh(v)
    return (c * c).sum(axis=1), (c / n).astype(float), e[::-1], u[:, ::-1], np.trace(v)


def check(got, vectors, first=0, k=32):
    deviation, centred, e, u, trace = brute(vectors)
    k = min(k, len(e))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == list(range(first, first + len(vectors)))
    w = np.array([[by[first + i][c + 1]["whitened"] for c in range(k)] for i in range(len(vectors))])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w * signs - want).max() < 1e-7
    for i in range(len(vectors)):
        assert sorted(by[first + i]) == list(range(1, k + 1))
        r = by[first + i][1]
        assert r["deviation"] == deviation[i] and r["n"] == len(vectors)
        assert abs(r["explained"] - e[0] / trace) < 1e-9 and r["identity_error"] < 1e-8


def test_against_brute_force(spark):
    vectors = np.random.default_rng(1).normal(0, 0.2, (700, 40)).astype(np.float32)
    check(whitening.whiten(table(spark, vectors.tolist())).collect(), vectors)


def test_cross_products_are_exact():
    rng = np.random.default_rng(2)
    for low, high, n in [(-5, 6, 1000), (-(2**20), 2**20, 130), (2**40, 2**43, 65), (7, 8, 64), (-3, -2, 1)]:
        x = rng.integers(low, high, (n, 5))
        o = x.astype(object)
        assert (whitening.cross_products(x) == o.T @ o).all()


def test_odd_rows_and_lengths(spark):
    good = np.random.default_rng(3).normal(0, 1, (60, 3)).round(3)
    short = np.random.default_rng(4).normal(0, 1, (20, 2)).round(3)
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1, 1], [float("inf"), 0, 0]]
    rows = table(spark, good.tolist()).union(table(spark, short.tolist(), 100)).union(table(spark, odd, 200))
    got = whitening.whiten(rows).collect()
    check([r for r in got if r["vec_id"] < 100], good)
    check([r for r in got if r["vec_id"] >= 100], short, 100)


def test_repeated_and_null_keys(spark):
    rows = table(spark, [[1, 2], [1, 2], [3, 5], [0, 1]]).withColumn("vec_id", F.when(F.col("vec_id") > 1, F.col("vec_id")))
    got = whitening.whiten(rows).collect()
    assert len(got) == 8 and sum(r["vec_id"] is None for r in got) == 4 and {r["n"] for r in got} == {4}


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_without_variance(spark, vectors):
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == 2 * len(vectors)
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in got} == {(0.0, 0.0, 0, 1.0)}


def test_huge_entries(spark):
    got = whitening.whiten(table(spark, [[3e38, 1], [-3e38, 2], [0, 4]])).collect()
    assert len(got) == 6 and all(np.isfinite(r["whitened"]) for r in got) and {r["deviation"] for r in got if r["vec_id"] != 2} == {None}


def test_empty(spark, none):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [None])).collect() == []
