"""Leaf-wise trees against a literal best-first grower, and exact bags."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.functions import randoms
from vitalframe.operators import trees


def literal(x, y, max_leaves):
    """Best-first growth by trying every cut of every leaf, with exact fractions."""
    def purity(rows):
        c = Counter(y[i] for i in rows)
        return Fraction(sum(v * v for v in c.values()), len(rows))

    leaves, made = {0: list(range(len(y)))}, []
    while len(leaves) < max_leaves:
        best = None
        for leaf, rows in leaves.items():
            if len({y[i] for i in rows}) < 2:
                continue
            for f in range(len(x[0])):
                values = sorted({x[i][f] for i in rows})
                for a, b in zip(values, values[1:], strict=False):
                    cut = a + (b - a) / 2
                    left = [i for i in rows if x[i][f] <= cut]
                    right = [i for i in rows if x[i][f] > cut]
                    gain = purity(left) + purity(right) - purity(rows)
                    order = (-gain, leaf, f, cut)
                    if best is None or order < best[0]:
                        best = (order, leaf, f, cut, left, right)
        if best is None:
            break
        _, leaf, f, cut, left, right = best
        n = 2 * len(made) + 1
        made.append((leaf, f, cut, n, n + 1))
        del leaves[leaf]
        leaves[n], leaves[n + 1] = left, right
    return made, leaves


def sample(n=150, seed=1, values=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, 3)) / 2.0
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(int) + (rng.random(n) < 0.15)
    return x, y.astype(int)


def predict(made, leaves, y, row):
    node = 0
    for leaf, f, cut, a, b in made:
        if node == leaf:
            node = a if row[f] <= cut else b
    c = Counter(y[i] for i in leaves[node])
    return min(c, key=lambda k: (-c[k], k))


@pytest.mark.parametrize("seed", range(4))
def test_grow_rows_is_literal(seed):
    x, y = sample(seed=seed)
    made, leaves = literal(x.tolist(), y.tolist(), 7)
    tree = trees.grow_rows(x, y, 7, 3)
    assert tree.splits == made
    assert tree.predict(x).tolist() == [predict(made, leaves, y.tolist(), r) for r in x.tolist()]


def frame(spark, x, y, parts=4):
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(parts)


def test_grow_table_is_literal_and_nested(spark):
    x, y = sample(200, seed=9)
    df = frame(spark, x, y)
    tree = trees.grow_table(df, "x", "y", 7, 3)[-1]
    # few values: all midpoints of the table are cuts, so rows fall as in the literal tree
    for k in range(2, 8):
        made, leaves = literal(x.tolist(), y.tolist(), k)
        want = [predict(made, leaves, y.tolist(), r) for r in x.tolist()]
        got = {r["id"]: r["p"] for r in df.select("id", trees.predicted(tree, "x", k).alias("p")).collect()}
        assert [got[i] for i in range(len(x))] == want == tree.predict(x, k).tolist()


def test_leaf_grid_is_literal(spark):
    x, y = sample(180, seed=5)
    df = frame(spark, x, y)
    fold = {r["id"]: r["f"] for r in df.select("id", F.floor(randoms.hash_uniform("id", seed=3) * 3).alias("f")).collect()}
    got = trees.leaf_grid(df, "x", "y", "id", range(2, 8), 3, seed=3).collect()
    for r in got:
        scores = []
        for f in range(3):
            rows = [i for i in fold if fold[i] != f]
            made, leaves = literal([x[i].tolist() for i in rows], [int(y[i]) for i in rows], r["max_leaves"])
            ys = [int(y[i]) for i in rows]
            test = [i for i in fold if fold[i] == f]
            scores.append(np.mean([predict(made, leaves, ys, x[i].tolist()) == y[i] for i in test]))
        assert r["cv_accuracy"] == pytest.approx(np.mean(scores), abs=1e-9)
    assert [r["max_leaves"] for r in got] == list(range(2, 8)) and sum(r["best"] for r in got) == 1


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 2)) * [1, 1e6]
    y = (x[:, 1] > 3e5).astype(int)
    tree = trees.grow_table(frame(spark, x, y), "x", "y", 3, 2)[-1]
    assert (tree.predict(x) == y).mean() > 0.98
    assert all(len(e) <= 2 * trees.CUTS for e in trees.cut_points(frame(spark, x, y), "x", 2))


def test_subsets_are_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") * 2).alias("v"))
    runs = []
    for parts, slack in ((3, 2.0), (11, 0.4), (1, 50.0)):  # a low threshold: most trees are dealt again
        got = trees.exact_subsets(df.repartition(parts), 40, 100, "id", seed=6, slack=slack).collect()
        by = {}
        for r in got:
            by.setdefault(r["tree"], []).append(r["id"])
        assert set(by) == set(range(40)) and all(len(v) == len(set(v)) == 100 for v in by.values())
        runs.append({t: sorted(v) for t, v in by.items()})
    assert runs[0] == runs[1] == runs[2]
    share = np.bincount([i for v in runs[0].values() for i in v], minlength=5000)
    assert share.max() <= 8 and abs(share.mean() - 0.8) < 1e-9
    few = trees.exact_subsets(df.limit(30), 3, 100, "id").groupBy("tree").count().collect()
    assert [r["count"] for r in few] == [30] * 3
    assert trees.exact_subsets(df.where("false"), 3, 100, "id").collect() == []


def test_bag_votes_row_by_row(spark):
    x, y = sample(400, seed=2, values=40)
    y = y % 2
    df = frame(spark, x, y)
    grown = trees.bag(df, 25, 100, 4, 2, "id", "x", "y", seed=1)
    sets = {}
    for r in trees.exact_subsets(df.select("id"), 25, 100, "id", seed=1).collect():
        sets.setdefault(r["tree"], []).append(r["id"])
    want = np.zeros((400, 2), int)
    for t in range(25):
        rows = sorted(sets[t])
        made, leaves = literal([x[i].tolist() for i in rows], [int(y[i]) for i in rows], 4)
        assert grown[t].splits == made and len(leaves) == 4
        for i in range(400):
            want[i, predict(made, leaves, [int(y[j]) for j in rows], x[i].tolist())] += 1
    got = {r["id"]: r["votes"] for r in trees.bag_votes(grown, df, "x", 2).collect()}
    assert [got[i] for i in range(400)] == want.tolist()
