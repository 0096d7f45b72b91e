"""Operator 11: the eigensolver and the whole result against numpy."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from vitalframe.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def matrices():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    yield rng.standard_normal((60, 30)).T @ rng.standard_normal((60, 30))  # symmetrised below
    yield q @ np.diag(np.r_[[9.0] * 5, [3.0] * 10, np.linspace(1, 0, 25)]) @ q.T  # equal values
    yield q @ np.diag(np.r_[1 + 1e-9 * np.arange(20), np.zeros(20)]) @ q.T        # close values
    yield np.diag(np.arange(20.0))
    yield np.eye(7)
    yield np.zeros((5, 5))
    yield np.array([[4.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    yield q[:, :3] @ q[:, :3].T * 1e-200
    yield q @ np.diag(10.0 ** -np.arange(40.0)) @ q.T


@pytest.mark.parametrize("i", range(10))
def test_leading_eigen(i):
    a = list(matrices())[i]
    a = (a + a.T) / 2
    k = min(16, len(a))
    values, vectors = whitening.leading_eigen(a, 16)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / scale, np.linalg.eigvalsh(a / scale)[::-1][:k], atol=1e-13 * len(a), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() / scale < 2e-13 * len(a)


def test_sturm_counts():
    d, e = np.array([1.0, -2.0, 3.0, 0.0]), np.array([0.5, 0.0, 2.0])
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    x = np.linspace(-4, 6, 77)
    assert (whitening.sturm_count(d, e, x) == [(np.linalg.eigvalsh(t) < v).sum() for v in x]).all()


def brute(rows, components=16):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for i, v in rows if v]
    dims = max(sorted(set(sizes), reverse=True), key=sizes.count)
    x = [(i, [math.floor(Fraction(c) * 64) + 1000000 for c in v]) for i, v in usable if len(v) == dims]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    dev = [(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))) for i, v in x]
    k = min(components, dims)
    y = {}
    for i, v in x:
        y.setdefault(i, []).append((n * np.array(v) - s) / n @ vectors[:, :k] / np.sqrt(values[:k]))
    return n, dev, values, y, k


def check(got, rows):
    n, dev, values, y, k = brute(rows)
    assert {r["n"] for r in got} == {n}
    for c in range(1, k + 1):
        mine = [r for r in got if r["component"] == c]
        assert sorted((r["vec_id"], r["deviation"]) for r in mine) == sorted(dev)
        assert all(abs(r["explained"] - values[c - 1] / values.sum()) < 1e-10 for r in mine)
        gap = min(abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1) / values[0]
        if gap > 1e-6:  # else the component isn't unique
            a = np.array([r["whitened"] for r in sorted(mine, key=lambda r: (r["vec_id"], r["deviation"]))])
            b = np.array([v for _, v in sorted(((i, j), v[j][c - 1]) for i, v in y.items() for j in range(len(v)))])
            if len(set(i for i, _ in dev)) == len(dev):
                assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_whitening(spark, SF).collect()
    check(got, rows)
    assert len(got) == 16 * len(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((80, 6)) * 3)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (103, [1.0] * 5 + [float("nan")]),
             (104, [1.0] * 5 + [float("inf")]), (105, [1.0, 2.0]), (106, rows[3][1]), (107, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    got = whitening.whiten(df).collect()
    check(got, rows)
    assert len(got) == 82 * 6
    twice = whitening.whiten(df.unionByName(df.limit(3))).collect()
    assert len(twice) > len(got) and twice[0]["n"] == got[0]["n"]
    nulls = spark.createDataFrame([(None, rows[0][1], 1, "x", "y")], SCHEMA)
    assert len([r for r in whitening.whiten(df.unionByName(nulls)).collect() if r["vec_id"] is None]) == 6


def test_few_vectors_and_none(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in got)
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(two).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert got[0]["identity_error"] < 1e-12
    none = two.where("vec_id < 0")
    assert whitening.whiten(none).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [None, None])], "vec_id long, embedding array<float>")).collect() == []


def test_huge_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [4e7, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 3)


def test_exact_helpers():
    x = np.array([[2**52, -2**52, 5], [2**52 - 1, 3, -5]], np.int64)
    assert whitening._exact_sums(x) == [2**53 - 1, 3 - 2**52, 0]
    n, sums = 3, [3000010, 2999990]
    y = np.array([[1000003, 999990], [1000000, 1000000]], np.int64)
    assert whitening._deviation(y, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in y]
    want = [[float(Decimal(n * int(a) - s) / n) for a, s in zip(r, sums, strict=True)] for r in y]
    assert np.allclose(whitening._centred(y, n, sums), want, rtol=1e-15)
