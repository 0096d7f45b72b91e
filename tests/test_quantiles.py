"""Exact quantiles against numpy, with buffers far smaller than the groups."""

import math

import numpy as np
import pytest

from vitalframe.operators import aggs, quantiles

PROBS = (0.0, 0.025, 0.5, 0.9, 0.975, 1.0)
NAMES = ["q0", "q1", "q2", "q3", "q4", "q5"]


def shapes():
    rng = np.random.default_rng(2)
    yield "uniform", rng.random(3000)
    yield "tails", np.exp(rng.standard_normal(3000) * 60)              # 1e-90 .. 1e90
    yield "ties", np.round(rng.random(3000) * 4) / 4
    yield "cluster", np.r_[1.0 + rng.random(2500) * 1e-9, rng.random(500) * 1e6]
    yield "signs", np.r_[rng.standard_normal(1500) * 1e300, rng.standard_normal(1500) * 1e-300]
    yield "extremes", np.r_[[math.inf, -math.inf, 1.7e308, -1.7e308], rng.random(200)]
    yield "constant", np.full(900, 3.5)
    yield "few", np.array([4.0, 1.0])


def close(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-12)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(name, i, float(v)) for name, vs in shapes() for i, v in enumerate(vs)]
    rows += [(None, i, float(i)) for i in range(700)] + [("few", 9, None), ("few", 10, float("nan")), ("none", 0, None)]
    return spark.createDataFrame(rows, "shape string, i long, v double").repartition(6)


def want(vs):
    top = np.finfo(float).max
    return np.quantile(np.clip(np.longdouble(vs), -top, top), PROBS)


@pytest.mark.parametrize("fit,limit", [(50, 10**6), (50, 0), (10**6, 10**6)])
def test_by_group(table, monkeypatch, fit, limit):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", limit)
    got = {r["shape"]: r for r in quantiles.exact_quantiles(table, "v", PROBS, ["shape"], NAMES, fit=fit, bins=64).collect()}
    assert set(got) == {name for name, _ in shapes()} | {None}
    for name, vs in [*shapes(), (None, np.arange(700.0))]:
        assert got[name]["n"] == len(vs)
        for c, w in zip(NAMES, want(vs), strict=True):
            assert close(got[name][c], float(w)), (name, c)


def test_global_and_empty(table):
    every = np.concatenate([vs for _, vs in shapes()] + [np.arange(700.0)])
    row = quantiles.exact_quantiles(table, "v", PROBS, names=NAMES, fit=100).collect()
    assert len(row) == 1 and row[0]["n"] == len(every)
    assert all(close(row[0][c], float(w)) for c, w in zip(NAMES, want(every), strict=True))
    none = quantiles.exact_quantiles(table.where("false"), "v", (0.5,), names=["m"]).collect()
    assert [tuple(r) for r in none] == [(0, None)]
    assert quantiles.exact_quantiles(table.where("false"), "v", (0.5,), ["shape"]).collect() == []


def test_operators_use_it(table):
    row = aggs.column_quantiles(table.where("shape = 'uniform'"), "v", (0.5,)).first()
    assert close(row["p500"], float(np.median(dict(shapes())["uniform"])))
    box = {r["shape"]: r for r in aggs.box_stats(table, "shape", "v").collect()}
    assert close(box["ties"]["median"], float(np.median(dict(shapes())["ties"])))
    both = [aggs.draw_summary(table.where("shape in ('uniform', 'ties', 'few')"), ["shape"], "v", bounded=b)
            .orderBy("shape").collect() for b in (True, False)]
    assert [r["shape"] for r in both[0]] == [r["shape"] for r in both[1]] == ["few", "ties", "uniform"]
    assert all(close(a["lower"], b["lower"]) and close(a["upper"], b["upper"]) for a, b in zip(*both, strict=True)
               if a["shape"] != "few")  # percentile takes NaN as the largest value
