"""Mini-batch training against a literal loop, and random Fourier features against the exact kernel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import learn, sgd


@pytest.fixture(scope="module")
def moons(spark):
    m = learn.two_moons(spark, 900, noise=0.2, seed=3)
    return m.select("id", F.array("x0", "x1").alias("x"), "label").cache()


def literal(spark, df, epochs, batch_size, rate, workers, seed):
    """The same batches, one after the other, in plain numpy."""
    rows = {r["id"]: r for r in df.select(F.col("id").cast("string").alias("id"), "x", "label").collect()}
    ids = spark.createDataFrame([(i,) for i in rows], "id string")
    worker = {r["id"]: r["k"] for r in ids.select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(workers)).alias("k")).collect()}
    size = {k: sum(v == k for v in worker.values()) for k in set(worker.values())}
    w = np.append(np.random.default_rng(seed).standard_normal(2), 0.0)
    losses = []
    for epoch in range(epochs):
        h = {r["id"]: r["h"] for r in ids.select("id", F.xxhash64(F.lit(seed), F.lit(epoch), "id").alias("h")).collect()}
        ends, loss, taken = [], 0.0, 0
        for k in sorted(size):
            mine = w.copy()
            n_batches = -(-size[k] // batch_size)
            batches = {}
            for i in sorted(rows):
                if worker[i] == k:
                    batches.setdefault(h[i] % n_batches, []).append(i)
            for b in sorted(batches):
                x = np.array([rows[i]["x"] for i in batches[b]])
                y = np.array([rows[i]["label"] for i in batches[b]], float)
                p = 1 / (1 + np.exp(-(x @ mine[:2] + mine[2])))
                loss += -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
                g = p - y
                mine = mine - rate * np.append((x * g[:, None]).mean(axis=0), g.mean())
                taken += 1
            ends.append((mine, len(batches)))
        w = sum(a * n for a, n in ends) / taken
        losses.append(loss / taken)
    return w, losses


@pytest.mark.parametrize("workers", [1, 3])
def test_is_the_literal_loop(spark, moons, workers):
    w, losses = sgd.minibatch_logistic(moons, "x", "label", "id", epochs=4, batch_size=50, rate=0.05, workers=workers, seed=5)
    want, lost = literal(spark, moons, 4, 50, 0.05, workers, 5)
    assert np.allclose(w, want, atol=1e-9) and np.allclose(losses, lost, atol=1e-9)
    again, _ = sgd.minibatch_logistic(moons.repartition(7), "x", "label", "id", epochs=4, rate=0.05, workers=workers, seed=5)
    assert np.allclose(w, again, atol=1e-12)


def test_goes_on_where_it_was_interrupted(moons, tmp_path):
    path = str(tmp_path / "state")
    whole, losses = sgd.minibatch_logistic(moons, "x", "label", "id", epochs=5, workers=2)
    sgd.minibatch_logistic(moons, "x", "label", "id", epochs=5, workers=2, state_path=path, save_every=2, stop_after=4)
    w, more = sgd.minibatch_logistic(moons, "x", "label", "id", epochs=5, workers=2, state_path=path, save_every=2)
    assert np.allclose(w, whole, atol=1e-12) and np.allclose(more, losses, atol=1e-12)


def test_learns_and_scores(spark, moons):
    w, losses = sgd.minibatch_logistic(moons, "x", "label", "id", epochs=12, rate=0.5, workers=4)
    assert losses[-1] < losses[0] and losses[-1] < 0.4
    got = moons.select("x", "label", sgd.logistic_score(w, "x").alias("p")).collect()
    assert all(math.isclose(r["p"], 1 / (1 + math.exp(-(np.dot(r["x"], w[:2]) + w[2]))), rel_tol=1e-9) for r in got)
    assert np.mean([(r["p"] >= 0.5) == r["label"] for r in got]) > 0.8
    odd = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, None, 0), (3, [0.0, 1.0], None)], "id long, x array<double>, label int")
    w, losses = sgd.minibatch_logistic(odd, "x", "label", "id", epochs=1)
    assert np.isfinite(w).all() and len(losses) == 1
    with pytest.raises(ValueError):
        sgd.minibatch_logistic(odd.where("false"), "x", "label", "id")


def test_fourier_features_near_the_exact_kernel(spark, moons):
    some = moons.limit(60)
    gamma = sgd.scale_gamma(moons, "x")
    x = np.array([r["x"] for r in moons.collect()])
    assert gamma == pytest.approx(1 / (2 * x.var()), rel=1e-9)
    rows = sgd.fourier_features(some, "x", gamma, 4096, seed=2).collect()
    z, a = np.array([r["fourier"] for r in rows]), np.array([r["x"] for r in rows])
    exact = np.exp(-gamma * ((a[:, None] - a[None]) ** 2).sum(axis=2))
    err = z @ z.T - exact
    assert np.abs(err).max() < 6 / math.sqrt(4096) and np.sqrt((err ** 2).mean()) < 1 / math.sqrt(4096)


def test_kernel_member_beats_the_line_on_moons(spark):
    m = learn.two_moons(spark, 1200, noise=0.2, seed=5)
    f = learn.assemble(m, ["x0", "x1"])
    train, test = learn.hash_split(f, ["id"], 0.7)
    got = {r["model"]: r["a"] for r in learn.classifiers(train, test, models=("svm", "rbf_svm")).groupBy("model").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).collect()}
    assert got["rbf_svm"] > 0.93 and got["rbf_svm"] > got["svm"] + 0.05
