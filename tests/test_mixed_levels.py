"""Mixed models as sums over levels, against the dense solver on the same cells and brute-force likelihoods."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import mixed


def single_rows(seed, levels, by=(0,)):
    rng = np.random.default_rng(seed)
    return [(k, g, float(x), float(1 + k + 2 * x + u + rng.normal(0, 0.5)))
            for k in by for g in range(levels) for u in [rng.normal(0, 0.3 + 0.4 * k)]
            for x in rng.normal(size=int(rng.integers(1, 9)))]


@pytest.mark.parametrize("reml", [True, False])
def test_single_factor_is_the_dense_fit(spark, reml):
    df = spark.createDataFrame(single_rows(4, 60, (0, 1, 2)), "k int, g int, x double, y double")
    got = mixed.mixed_model(df, "y", ["x"], ["g"], ["k"], reml).toPandas()
    cells = mixed.cell_stats(df, "y", ["x"], ["g"], ["k"]).toPandas()
    for k in (0, 1, 2):
        beta, vcov, s2, sig, blups, _ = mixed.fit_cells(cells[cells["k"] == k], 2, ["g"], reml, dense=True)
        mine = got[got["k"] == k].set_index(["kind", "term"]).sort_index()
        assert np.allclose([mine.loc[("fixed", t), "estimate"].iloc[0] for t in ("intercept", "x")], beta, atol=1e-6)
        assert np.allclose(np.array([mine.loc[("fixed", t), "vcov"].iloc[0] for t in ("intercept", "x")]), vcov, rtol=1e-5)
        assert mine.loc[("sigma2", "residual"), "estimate"].iloc[0] == pytest.approx(s2, rel=1e-5)
        assert mine.loc[("sigma2", "g"), "estimate"].iloc[0] == pytest.approx(sig["g"], rel=1e-4, abs=1e-7)
        u = mine.loc[[("blup", "g")]].set_index("level")["estimate"]
        assert len(u) == 60 and all(u[str(g)] == pytest.approx(v, abs=1e-5) for g, v in blups["g"].items())


def crossed_rows(seed, na, nb, share=0.6, a_names=str):
    rng = np.random.default_rng(seed)
    ua, ub = rng.normal(0, 1.0, na), rng.normal(0, 0.6, nb)
    return [(a_names(i), j, float(x), float(3 + 0.7 * x + ua[i] + ub[j] + rng.normal(0, 0.4)))
            for i in range(na) for j in range(nb) if rng.random() < share for x in rng.normal(size=int(rng.integers(1, 4)))]


def dense_ml(rows, reml):
    pdf = pd.DataFrame(rows, columns=["a", "b", "x", "y"])
    X = np.column_stack([np.ones(len(pdf)), pdf.x])
    Z = [(pdf[c].to_numpy()[:, None] == np.unique(pdf[c])[None]).astype(float) for c in ("a", "b")]
    y, N = pdf.y.to_numpy(), len(pdf)

    def crit(t):
        V = np.eye(N) + math.exp(t[0]) * Z[0] @ Z[0].T + math.exp(t[1]) * Z[1] @ Z[1].T
        Vi = np.linalg.inv(V)
        A = X.T @ Vi @ X
        b = np.linalg.solve(A, X.T @ Vi @ y)
        r = y - X @ b
        n = N - 2 if reml else N
        s2 = r @ Vi @ r / n
        value = n * math.log(s2) + np.linalg.slogdet(V)[1] + (np.linalg.slogdet(A)[1] if reml else 0)
        return value, b, s2, Vi, r
    return crit, Z, pdf


@pytest.mark.parametrize("reml,na,nb", [(False, 25, 6), (True, 6, 20)])
def test_crossed_factors_reach_the_dense_optimum(spark, reml, na, nb):
    rows = crossed_rows(7 + na, na, nb)
    df = spark.createDataFrame(rows, "a string, b int, x double, y double").repartition(5)
    got = mixed.mixed_model(df, "y", ["x"], ["a", "b"], reml=reml).toPandas().set_index(["kind", "term"]).sort_index()
    crit, Z, pdf = dense_ml(rows, reml)
    s2 = got.loc[("sigma2", "residual"), "estimate"].iloc[0]
    t = [math.log(got.loc[("sigma2", g), "estimate"].iloc[0] / s2) for g in ("a", "b")]
    here, beta, s2_dense, Vi, r = crit(t)
    assert s2 == pytest.approx(s2_dense, rel=1e-6)
    assert np.allclose([got.loc[("fixed", k), "estimate"].iloc[0] for k in ("intercept", "x")], beta, atol=1e-6)
    for step in (0.02, -0.02):  # no neighbour is better: the optimum of the dense likelihood
        assert crit([t[0] + step, t[1]])[0] >= here - 1e-9 and crit([t[0], t[1] + step])[0] >= here - 1e-9
    assert abs(crit([t[0] + 1e-3, t[1]])[0] - crit([t[0] - 1e-3, t[1]])[0]) < 1e-4
    for k, g in enumerate(("a", "b")):
        want = dict(zip(map(str, np.unique(pdf[g])), math.exp(t[k]) * Z[k].T @ Vi @ r, strict=True))
        mine = got.loc[[("blup", g)]].set_index("level")["estimate"]
        assert set(mine.index) == set(want) and all(mine[i] == pytest.approx(v, abs=1e-6) for i, v in want.items())


def test_many_levels_of_one_factor(spark):
    n = 20_000
    df = spark.range(n * 3).select((F.col("id") % n).alias("g"), F.rand(3).alias("x"), F.randn(4).alias("e"))
    u = spark.range(n).select(F.col("id").alias("g"), (F.randn(9) * 0.5).alias("u"))
    d = df.join(u, "g").select("g", "x", (1 + 2 * F.col("x") + F.col("u") + 0.3 * F.col("e")).alias("y"))
    fit = mixed.mixed_model(d, "y", ["x"], ["g"])
    got = {(r["kind"], r["term"]): r["estimate"] for r in fit.where("kind <> 'blup'").collect()}
    assert got["fixed", "x"] == pytest.approx(2.0, abs=0.03) and got["sigma2", "g"] == pytest.approx(0.25, rel=0.05)
    assert got["sigma2", "residual"] == pytest.approx(0.09, rel=0.03)
    assert fit.where("kind = 'blup'").count() == n
