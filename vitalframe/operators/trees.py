"""Decision trees grown leaf by leaf, best split first.

A tree limited by its number of leaves splits, of all its leaves, the one whose best
cut lowers the Gini impurity most (weighted by rows), until there are enough.  The
splits come in an order, so one growth to the largest number of leaves holds every
smaller tree: the first k - 1 splits make the tree of k leaves.

Over a table, features are cut at quantiles once (a place among the cuts per feature
and row, as bytes); each step counts (tree, leaf, feature, place, class) of the new
leaves per task and sums the counts in Spark.  What the driver gets is bounded by
trees x features x cuts, not by rows.  All folds of a cross-validation grow in the
same passes.  A subset of ``rows_per_tree`` rows is grown whole in one task, with
every midpoint between two values as a cut.

Ties: the cut with the smallest (feature, threshold), the leaf made first, the
smallest class.  A leaf of one class is not split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import randoms
from ..session import cut_lineage

CUTS = 63             # cuts of a feature at most
_KEEP = 12            # digits by which two scores are told apart


@dataclass
class Tree:
    """Splits in the order made: (leaf, feature, threshold, left, right); leaves are numbered as they appear,
    0 is the root.  ``counts`` holds rows by class of every leaf and inner node."""
    splits: list = field(default_factory=list)
    counts: dict = field(default_factory=dict)

    def label(self, node: int) -> int:
        return int(np.argmax(self.counts[node]))  # the first of equal ones

    def leaves(self, k: int) -> list:
        live = [0]
        for leaf, _, _, left, right in self.splits[:k - 1]:
            live.remove(leaf)
            live += [left, right]
        return live

    def assign(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        """Leaf of every row of x in the tree of at most k leaves."""
        at = np.zeros(len(x), np.int64)
        for leaf, feature, cut, left, right in self.splits if k is None else self.splits[:k - 1]:
            here = at == leaf
            at[here] = np.where(x[here, feature] <= cut, left, right)
        return at

    def predict(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        names = np.zeros(1 + max(self.counts), np.int64)
        for node in self.counts:
            names[node] = self.label(node)
        return names[self.assign(x, k)]


def _purity(counts: np.ndarray) -> np.ndarray:
    """Rows times (1 - Gini impurity), along the last axis: the sum of squares over the sum."""
    total = counts.sum(axis=-1)
    return (counts.astype(float) ** 2).sum(axis=-1) / np.where(total > 0, total, 1)


def best_cut(counts: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, place) of the best cut, from counts by feature, place and class: rows up to the place
    go left.  None when nothing can be cut."""
    left = counts.cumsum(axis=1)[:, :-1]
    total = counts.sum(axis=1, keepdims=True)
    right = total - left
    able = (left.sum(axis=2) > 0) & (right.sum(axis=2) > 0)
    if not able.any() or (total[0, 0] > 0).sum() < 2:
        return None
    gain = np.round(_purity(left) + _purity(right) - _purity(total), _KEEP - 3)
    gain = np.where(able, gain, -np.inf)
    at = int(np.argmax(gain))  # the first of equal ones: feature, then place
    f, place = divmod(at, gain.shape[1])
    return float(gain[f, place]), f, place


def grow_rows(x: np.ndarray, y: np.ndarray, max_leaves: int, classes: int) -> Tree:
    """Grow a tree on rows that one task holds, with all midpoints as cuts."""
    tree = Tree(counts={0: np.bincount(y, minlength=classes)})

    def look(rows):
        best = None
        if len(set(y[rows].tolist())) < 2:
            return None
        for f in range(x.shape[1]):
            values, place = np.unique(x[rows, f], return_inverse=True)
            if len(values) < 2:
                continue
            counts = np.zeros((1, len(values), classes), np.int64)
            np.add.at(counts[0], (place, y[rows]), 1)
            found = best_cut(counts)
            if found and (best is None or found[0] > best[0]):
                best = (found[0], f, values[found[2]] + (values[found[2] + 1] - values[found[2]]) / 2)
        return best

    held = {0: np.arange(len(y))}
    able = {0: look(held[0])}
    while len(tree.splits) < max_leaves - 1:
        live = [(-b[0], leaf) for leaf, b in able.items() if b]
        if not live:
            break
        leaf = min(live)[1]
        _, f, cut = able.pop(leaf)
        left, right = 2 * len(tree.splits) + 1, 2 * len(tree.splits) + 2
        goes = x[held[leaf], f] <= cut
        tree.splits.append((leaf, f, float(cut), left, right))
        for node, rows in ((left, held[leaf][goes]), (right, held[leaf][~goes])):
            held[node] = rows
            tree.counts[node] = np.bincount(y[rows], minlength=classes)
            able[node] = look(rows)
    return tree


# ---- growth over a table ---------------------------------------------------------------------------

def cut_points(df: DataFrame, features: str, dims: int, cuts: int = CUTS) -> list:
    """Per feature, midpoints between neighbouring quantiles of its values (all midpoints if few values)."""
    cols = [F.get(features, F.lit(f)) for f in range(dims)]
    few = df.agg(*[F.approx_count_distinct(c).alias(f"d{f}") for f, c in enumerate(cols)]).first() if dims else ()
    probs = [i / (cuts + 1) for i in range(cuts + 2)]
    asks = [F.sort_array(F.collect_set(c)) if few[f] <= 2 * cuts else
            F.percentile_approx(c, F.array(*[F.lit(p) for p in probs]), 10 * cuts) for f, c in enumerate(cols)]
    out = []
    for f in range(0, dims, 64):
        row = df.agg(*[a.cast("array<double>").alias(f"a{i}") for i, a in enumerate(asks[f:f + 64])]).first()
        for values in row:
            v = np.unique(np.array(values or [], float))
            mid = v[:-1] + (v[1:] - v[:-1]) / 2
            out.append(mid if len(mid) <= 2 * cuts else mid[np.linspace(0, len(mid) - 1, 2 * cuts).astype(int)])
    return out


def _places(df: DataFrame, features: str, label: str, fold, edges: list) -> DataFrame:
    """(fold, y, x): each feature's place among its cuts, as bytes (a value equal to a cut lies below it)."""
    dims = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            place = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(dims)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in place], pa.binary())],
                                             names=["fold", "y", "x"])

    body = df.select(fold.cast("int").alias("fold"), F.col(label).cast("int").alias("y"),
                     F.col(features).cast("array<double>").alias("x"))
    return body.mapInArrow(run, "fold int, y int, x binary")


def _counts(places: DataFrame, trees: dict, new: dict, dims: int, wide: int, classes: int) -> dict:
    """Counts by (feature, place, class) of the new leaves of each fold's tree; a tree counts the rows of other folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(k, leaf): np.zeros((dims, wide, classes), np.int64) for k in new for leaf in new[k]}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, dims)
            fold, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in new:
                at = trees[k].assign(x)
                for leaf in new[k]:
                    rows = np.flatnonzero((at == leaf) & (fold != k))
                    code = x[rows].astype(np.int64) * classes + y[rows, None] + np.arange(dims) * (wide * classes)
                    held[k, leaf] += np.bincount(code.ravel(), minlength=dims * wide * classes).reshape(dims, wide, classes)
        for (k, leaf), m in held.items():
            at = np.flatnonzero(m.ravel())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k), pa.int32()), pa.array(np.full(len(at), leaf), pa.int32()),
                     pa.array(at, pa.int32()), pa.array(m.ravel()[at], pa.int64())], names=["k", "leaf", "at", "c"])

    out = {(k, leaf): np.zeros(dims * wide * classes, np.int64) for k in new for leaf in new[k]}
    summed = places.mapInArrow(run, "k int, leaf int, at int, c long").groupBy("k", "leaf", "at").agg(F.sum("c").alias("c"))
    for r in summed.collect():  # at most folds x new leaves x features x cuts x classes
        out[r["k"], r["leaf"]][r["at"]] = r["c"]
    return {key: m.reshape(dims, wide, classes) for key, m in out.items()}


def grow_table(df: DataFrame, features: str, label: str, max_leaves: int, classes: int, fold=None, folds: int = 0,
               cuts: int = CUTS) -> dict:
    """Trees of up to ``max_leaves`` leaves over a whole table, by fold: fold k's tree is grown on the other
    folds' rows, ``-1`` (without folds) on all.  Thresholds are values of the features."""
    first = df.select(F.max(F.size(features))).first()[0]
    if first is None:
        raise ValueError("no rows to grow a tree on")
    edges = cut_points(df, features, first, cuts)
    wide = 1 + max((len(e) for e in edges), default=0)
    places = cut_lineage(_places(df, features, label, fold if fold is not None else F.lit(0), edges), "tree-places")
    keys = list(range(folds)) if fold is not None else [-1]
    trees = {k: Tree() for k in keys}
    able: dict = {k: {} for k in keys}
    new = {k: [0] for k in keys}
    for step in range(max_leaves):
        for (k, leaf), m in _counts(places, trees, new, first, wide, classes).items():
            trees[k].counts[leaf] = m[0].sum(axis=0) if first else np.zeros(classes, np.int64)
            able[k][leaf] = best_cut(m)
        new = {}
        if step == max_leaves - 1:
            break
        for k in keys:
            live = [(-b[0], leaf) for leaf, b in able[k].items() if b]
            if not live:
                continue
            leaf = min(live)[1]
            _, f, place = able[k].pop(leaf)
            left, right = 2 * len(trees[k].splits) + 1, 2 * len(trees[k].splits) + 2
            trees[k].splits.append((leaf, f, place, left, right))
            new[k] = [left, right]
        if not new:
            break
    for tree in trees.values():  # places become values
        tree.splits = [(leaf, f, float(edges[f][place]), a, b) for leaf, f, place, a, b in tree.splits]
    return trees


def predicted(tree: Tree, features: str, k: int):
    """The class that the tree of at most k leaves gives a row, as an expression on the feature array."""
    inner = {leaf: (f, cut, a, b) for leaf, f, cut, a, b in tree.splits[:k - 1]}

    def at(node):
        if node not in inner:
            return F.lit(tree.label(node))
        f, cut, a, b = inner[node]
        return F.when(F.get(features, F.lit(f)).cast("double") <= cut, at(a)).otherwise(at(b))

    return at(0)


def leaf_grid(df: DataFrame, features: str, label: str, row_key: str, leaves=range(2, 8), folds: int = 5, seed: int = 0,
              cuts: int = CUTS) -> DataFrame:
    """Cross-validated accuracy by number of leaves: max_leaves, cv_accuracy (mean over the folds), best
    (of equal ones the smallest).  Folds are dealt by a hash of the row's key."""
    leaves = list(leaves)
    fold = F.floor(randoms.hash_uniform(row_key, seed=seed) * folds).cast("int")
    d = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), fold.alias("fold"))
    classes = 1 + (d.agg(F.max("y")).first()[0] or 0)
    trees = grow_table(d, "x", "y", max(leaves), classes, F.col("fold"), folds, cuts)
    hits = []
    for k in leaves:
        own = F.lit(None).cast("int")
        for f, tree in trees.items():
            own = F.when(F.col("fold") == f, predicted(tree, "x", k)).otherwise(own)
        hits.append(F.avg((own == F.col("y")).cast("double")).alias(f"a{k}"))
    means = d.groupBy("fold").agg(*hits).agg(*[F.round(F.avg(f"a{k}"), 12).alias(f"a{k}") for k in leaves])
    every = F.array(*[f"a{k}" for k in leaves])
    first = F.array_position(every, F.array_max(every)) - 1
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("max_leaves"), F.col(f"a{k}").alias("cv_accuracy"), (first == i).alias("best"))
        for i, k in enumerate(leaves)])).alias("z")).select("z.*")


# ---- many trees on small exact subsets --------------------------------------------------------------

def exact_subsets(df: DataFrame, n_trees: int, rows_per_tree: int, row_key: str, seed: int = 0, slack: float = 2.0) -> DataFrame:
    """``df`` with a column ``tree``: for each tree exactly ``rows_per_tree`` rows without replacement (all, if
    there are fewer), those with the smallest hashes of (tree, row).

    Only hashes below a threshold leave the scan, ``slack`` times as many as wanted on average; a tree that
    gets too few is dealt again with a threshold twice as high, so the subsets are exact at any size.
    """
    n = df.count()
    if not n:
        return df.withColumn("tree", F.lit(0)).where("false")
    chosen, todo, share = [], list(range(n_trees)), min(1.0, slack * rows_per_tree / n)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "tree", F.col(row_key)), 1)
    w = Window.partitionBy("tree").orderBy("__h", row_key)
    while todo:
        trees = F.explode(F.array(*[F.lit(t) for t in todo])) if len(todo) < n_trees else F.explode(
            F.sequence(F.lit(0), F.lit(n_trees - 1)))
        some = df.withColumn("tree", trees).withColumn("__h", hashed)
        if share < 1.0:
            some = some.where(F.col("__h") < F.lit(int(share * 2**63)))
        some = cut_lineage(some, "tree-subsets")
        got = {r["tree"]: r["count"] for r in some.groupBy("tree").count().collect()}
        full = [t for t in todo if got.get(t, 0) >= min(rows_per_tree, n)]
        if full:
            part = some if len(full) == len(todo) else some.where(F.col("tree").isin(full))
            chosen.append(part.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows_per_tree).drop("__r", "__h"))
        todo = [t for t in todo if got.get(t, 0) < min(rows_per_tree, n)]
        share = min(1.0, 2 * share)
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def bag(train: DataFrame, n_trees: int, rows_per_tree: int, max_leaves: int, classes: int, row_key: str, features: str,
        label: str, seed: int = 0) -> list:
    """Trees of ``max_leaves`` leaves, each on exactly ``rows_per_tree`` rows (n_trees x few nodes to the driver)."""
    rows = exact_subsets(train.select(F.col(row_key).alias("id"), F.col(features).cast("array<double>").alias("x"),
                                      F.col(label).cast("int").alias("y")), n_trees, rows_per_tree, "id", seed)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        tree = grow_rows(np.stack(part["x"].to_list()), part["y"].to_numpy(), max_leaves, classes)
        splits = [list(map(float, s)) for s in tree.splits]
        return pd.DataFrame({"tree": [int(part["tree"].iloc[0])], "rows": [len(part)], "splits": [splits],
                             "nodes": [[[float(k), *map(float, c)] for k, c in tree.counts.items()]]})

    found = rows.groupBy("tree").applyInPandas(one, "tree int, rows int, splits array<array<double>>, nodes array<array<double>>")
    out = []
    for r in sorted(found.collect(), key=lambda r: r["tree"]):
        out.append(Tree([(int(a), int(f), cut, int(b), int(c)) for a, f, cut, b, c in r["splits"]],
                        {int(v[0]): np.array(v[1:], np.int64) for v in r["nodes"]}))
    return out


def bag_votes(trees: list, test: DataFrame, features: str, classes: int, out: str = "votes") -> DataFrame:
    """Per row, how many of the trees vote for each class, in one pass without a shuffle."""
    @F.pandas_udf("array<int>")
    def votes(x: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(x), 4096):
            m = np.stack(x.iloc[at:at + 4096].to_list()).astype(float)
            count = np.zeros((len(m), classes), np.int32)
            for tree in trees:
                count[np.arange(len(m)), tree.predict(m)] += 1
            found += list(count)
        return pd.Series(found)

    return test.withColumn(out, votes(F.col(features).cast("array<double>")))
