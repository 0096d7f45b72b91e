"""Mini-batch training in epochs (M22) and random Fourier features.

A logistic model is trained with batches of a fixed expected size, dealt anew in every
epoch by a hash of (epoch, row).  Rows belong to ``workers`` by a hash of their key;
in an epoch each worker starts from the common weights and takes its batches one
after the other, in one task that streams its rows (a batch is all it holds); then
the weights are averaged by the batches taken.  With one worker that is the plain
sequential loop.  The driver holds the weights and one row per worker and epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.sinks import stored

_STATE = "epoch int, weights array<double>, losses array<double>"


def _loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def sgd_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """One batch: the weights (bias last) after it, and the mean loss before it."""
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    g = (p - y) / len(y)
    return w - rate * np.append(x.T @ g, g.sum()), float(_loss(p, y).mean())


def minibatch_logistic(df: DataFrame, features: str, label: str, row_key: str, epochs: int = 60, batch_size: int = 50,
                       rate: float = 0.01, workers: int = 8, seed: int = 0, state_path: str | None = None,
                       save_every: int = 10, stop_after: int | None = None) -> tuple[np.ndarray, list]:
    """(weights with the bias last, mean batch loss per epoch) of a logistic model on an array column.

    ``state_path`` (a shared folder) gets the weights every ``save_every`` epochs, and a later call goes on
    from there; ``stop_after`` ends early, as an interrupted run would.  Labels are 0 or 1; rows whose label or
    features are null are left out; an empty table raises.
    """
    spark = df.sparkSession
    body = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(row_key).cast("string").alias("id"), F.col(features).cast("array<double>").alias("x"),
        F.col(label).cast("double").alias("y"))
    body = cut_lineage(body.withColumn("worker", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(workers)).cast("int")), "sgd-rows")
    sizes = {r["worker"]: (r["n"], r["d"]) for r in
             body.groupBy("worker").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()}
    if not sizes:
        raise ValueError("no rows to train on")
    dims = max(d for _, d in sizes.values())
    batches = {k: -(-n // batch_size) for k, (n, _) in sizes.items()}
    per_worker = F.element_at(F.array(*[F.lit(batches.get(k, 1)) for k in range(workers)]), F.col("worker") + 1)
    w, losses, first = np.append(np.random.default_rng(seed).standard_normal(dims), 0.0), [], 0
    state = stored(spark, state_path, spark.createDataFrame([], _STATE).schema) if state_path else None
    if state is not None:
        last = state.orderBy(F.desc("epoch")).first()
        if last is not None:
            w, losses, first = np.array(last["weights"]), list(last["losses"]), last["epoch"] + 1

    for epoch in range(first, epochs if stop_after is None else min(epochs, stop_after)):
        h = F.xxhash64(F.lit(seed), F.lit(epoch), "id")
        dealt = (body.withColumn("b", F.pmod(h, per_worker).cast("long")).repartition(len(sizes), "worker")
                 .sortWithinPartitions("worker", "b", "id").select("worker", "b", "x", "y"))
        found = {r["worker"]: r for r in dealt.mapInArrow(_trainer(w, rate), "worker int, w array<double>, loss double, n long").collect()}
        total = sum(r["n"] for r in found.values())
        w = sum(np.array(found[k]["w"]) * found[k]["n"] for k in sorted(found)) / total
        losses.append(sum(found[k]["loss"] for k in sorted(found)) / total)
        if state_path and epoch % save_every == 0:
            spark.createDataFrame([(epoch, w.tolist(), losses)], _STATE).coalesce(1).write.mode("append").parquet(state_path)
    return w, losses


def _trainer(start: np.ndarray, rate: float):
    """For mapInArrow over rows (worker, batch, x, y) in order: each worker's weights, summed loss and batches."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict = {}
        name, xs, ys = None, [], []

        def close():
            if name is not None:
                w, loss, n = done.get(name[0], (start, 0.0, 0))
                w, mine = sgd_step(w, np.concatenate(xs), np.concatenate(ys), rate)
                done[name[0]] = (w, loss + mine, n + 1)

        for b in parts:
            if not b.num_rows:
                continue
            worker, batch = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = b.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((worker[1:] != worker[:-1]) | (batch[1:] != batch[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(y)], strict=True):
                key = (int(worker[lo]), int(batch[lo]))
                if key != name:
                    close()
                    name, xs, ys = key, [], []
                xs.append(x[lo:hi])
                ys.append(y[lo:hi])
        close()
        if done:
            keys = sorted(done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([done[k][0].tolist() for k in keys], pa.list_(pa.float64())),
                 pa.array([done[k][1] for k in keys], pa.float64()), pa.array([done[k][2] for k in keys], pa.int64())],
                names=["worker", "w", "loss", "n"])
    return run


def logistic_score(weights: np.ndarray, features: str):
    """Probability of label 1 as a column expression on the feature array."""
    dot = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(v)) for v in weights[:-1]]),
                                 lambda a, b: a * b), F.lit(float(weights[-1])), lambda s, v: s + v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-dot))


def scale_gamma(df: DataFrame, features: str) -> float:
    """1 / (dimensions x variance of all entries), the usual width of a radial kernel."""
    x = F.col(features).cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    r = df.agg(F.sum(total).alias("s"), F.sum(squares).alias("q"), F.sum(F.size(features)).alias("n"),
               F.max(F.size(features)).alias("d")).first()
    if not r["n"]:
        return 1.0
    var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return 1.0 / (r["d"] * var) if var > 0 else 1.0


def fourier_weights(dims: int, gamma: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dims, n)) * np.sqrt(2 * gamma), rng.random(n) * 2 * np.pi


def fourier_features(df: DataFrame, features: str, gamma: float, n: int = 512, seed: int = 0, out: str = "fourier") -> DataFrame:
    """Seeded random Fourier features of an array column, whose inner products approach exp(-gamma |a - b|^2).

    The error of one product has a standard deviation of at most 1 / sqrt(n).  The directions follow from
    (dimensions, gamma, n, seed), so every task draws the same ones and none are shipped.
    """
    @F.pandas_udf("array<double>")
    def work(x: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(x), 4096):
            m = np.stack(x.iloc[at:at + 4096].to_list()).astype(float)
            w, b = fourier_weights(m.shape[1], gamma, n, seed)
            found += list(np.cos(m @ w + b) * np.sqrt(2.0 / n))
        return pd.Series(found)

    return df.withColumn(out, work(F.col(features).cast("array<double>")))
