"""MLlib-backed models.

Training is MLlib's distributed implementations; evaluation is plain
aggregates over the prediction table (accuracy, precision, recall, votes),
so nothing is collected except the fitted model parameters.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import RFormula, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import randoms
from ..session import cut_lineage, run_folder
from . import sgd


def array_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """ARRAY<FLOAT|DOUBLE> column -> ML vector column."""
    return df.withColumn(out, array_to_vector(F.transform(array_col, lambda x: x.cast("double"))))


def assemble(df: DataFrame, columns, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out,
                           handleInvalid="error").transform(df)


def hash_split(df: DataFrame, keys, train_fraction: float = 0.7, seed: int = 0):
    """Repeatable train/test split by a hash of the row key (does not
    depend on partitioning, unlike ``randomSplit``)."""
    u = randoms.hash_uniform(*keys, seed=seed)
    d = df.withColumn("__u", u)
    return (d.where(F.col("__u") < train_fraction).drop("__u"),
            d.where(F.col("__u") >= train_fraction).drop("__u"))


def logistic_formula(df: DataFrame, formula: str, reg: float = 0.0):
    """M7: logistic regression on an R-style formula (``C(a)`` is written
    as a string column; RFormula one-hot encodes it).  Returns (model,
    predictions with ``p`` = P(label = 1))."""
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label",
                  handleInvalid="error")  # drop incomplete rows first (P5): none goes in silence
    lr = LogisticRegression(regParam=reg, featuresCol="features", labelCol="label")
    model = Pipeline(stages=[rf, lr]).fit(df)
    pred = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return model, pred.drop("features", "rawPrediction", "probability")


def lasso(df: DataFrame, label: str, features: str = "features", alpha: float = 0.1):
    """L1-penalised least squares with the (1/2n) RSS + alpha |w|_1
    objective, no standardisation (same as scikit-learn's Lasso)."""
    lr = LinearRegression(featuresCol=features, labelCol=label, regParam=alpha,
                          elasticNetParam=1.0, standardization=False, maxIter=200)
    return lr.fit(df)


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                    F.count("*").alias("n"))


def classifiers(train: DataFrame, test: DataFrame, features: str = "features",
                label: str = "label", C: float = 1.0, seed: int = 0,
                row_key: str = "id", models=("logistic", "forest", "svm"), n_fourier: int = 512) -> DataFrame:
    """Logistic, random forest, linear SVM and (``rbf_svm``) an SVM with a radial kernel; predictions of
    each on the test rows, tagged by model (label must be 0/1 for the SVMs).

    The kernel is the linear SVM on ``n_fourier`` random Fourier features (:mod:`.sgd`), with the usual width
    1 / (dimensions x variance); both tables are written once, as every fit reads them.
    """
    train, test = cut_lineage(train, "train"), cut_lineage(test, "test")
    n = train.count()
    svm = {"labelCol": label, "regParam": 1.0 / (C * max(n, 1))}
    kinds = {
        "logistic": lambda: LogisticRegression(featuresCol=features, labelCol=label),
        "forest": lambda: RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed,
                                                 numTrees=50),
        "svm": lambda: LinearSVC(featuresCol=features, **svm),
        "rbf_svm": lambda: LinearSVC(featuresCol="__rbf", standardization=False, **svm),
    }
    out = []
    for name in models:
        a, b = train, test
        if name == "rbf_svm":
            gamma = sgd.scale_gamma(train.select(vector_to_array(features).alias("__x")), "__x")
            a, b = (radial(d, features, gamma, n_fourier, seed) for d in (train, test))
        p = kinds[name]().fit(a).transform(b).select(row_key, label, "prediction")
        out.append(p.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def radial(df: DataFrame, features: str, gamma: float, n: int = 512, seed: int = 0, out: str = "__rbf") -> DataFrame:
    """``df`` with a vector of random Fourier features, written once."""
    d = sgd.fourier_features(df.withColumn("__x", vector_to_array(features)), "__x", gamma, n, seed, out)
    return cut_lineage(d.withColumn(out, array_to_vector(out)).drop("__x"), "fourier")


def hard_vote(preds: DataFrame, row_key: str = "id", prediction: str = "prediction",
              label: str = "label") -> DataFrame:
    """Majority label per row over models; a tie goes to the smallest
    label.  Grouped count per (row, label) then a per-row ranking (a row's
    candidates are at most the number of labels)."""
    c = preds.groupBy(row_key, label, prediction).agg(F.count("*").alias("__votes"))
    w = Window.partitionBy(row_key).orderBy(F.col("__votes").desc(), F.col(prediction).asc())
    return (c.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
             .drop("__r", "__votes"))


def grid_search_tree(df: DataFrame, depths=(1, 2, 3), features: str = "features",
                     label: str = "label", folds: int = 3, seed: int = 0, row_key: str = "id"):
    """Cross-validated depth search of a decision tree (MLlib trees are
    limited by depth, not leaf count)."""
    # folds by a hash of the row, so that they don't depend on partitioning
    u = randoms.hash_uniform(row_key, seed=seed)
    df = df.withColumn("__fold", F.floor(u * folds).cast("int")).persist()
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(dt.maxDepth, list(depths)).build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cv = CrossValidator(estimator=dt, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        seed=seed, parallelism=len(depths), foldCol="__fold")
    found = cv.fit(df)
    df.unpersist()
    return found


def grid_search_vote(df: DataFrame, n_trees=(50, 100), svm_c=(0.4, 0.5, 0.6), logistic_c=(0.5, 0.8, 1.0),
                     features: str = "features", label: str = "label", folds: int = 5, seed: int = 0,
                     row_key: str = "id", parallelism: int = 8, kernel: str = "linear", n_fourier: int = 512) -> DataFrame:
    """Cross-validated accuracy of the hard vote of a logistic model, a forest and an
    SVM (``kernel`` linear or rbf, as in :func:`classifiers`, label 0/1) for every combination of the number of
    trees and the two C: n_trees, svm_c, logistic_c, cv_accuracy (mean over the folds), best.

    Each member is fitted once per hashed fold, and all members predict a fold's rows in one
    pass; the combinations are aggregates over these predictions.  Of equal combinations the
    first by logistic_c, n_trees, svm_c is the best.
    """
    u = randoms.hash_uniform(row_key, seed=seed)
    d = df.select(label, features, F.floor(u * folds).cast("int").alias("__fold"))
    svm_features = features
    if kernel == "rbf":  # the kernel's width doesn't see labels: one for all folds
        gamma = sgd.scale_gamma(d.select(vector_to_array(features).alias("__x")), "__x")
        d, svm_features = radial(d, features, gamma, n_fourier, seed), "__rbf"
    elif kernel != "linear":
        raise ValueError(f"kernel must be linear or rbf, got {kernel!r}")
    d = d.persist()
    sizes = {r["__fold"]: r["count"] for r in d.groupBy("__fold").count().collect()}
    if len(sizes) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")
    members = [*(("forest", t) for t in n_trees), *(("svm", c) for c in svm_c), *(("logistic", c) for c in logistic_c)]
    name = {m: f"__{m[0]}_{k}" for k, m in enumerate(members)}

    def fit(task):
        fold, (kind, value) = task
        out = name[kind, value]
        n = sum(sizes.values()) - sizes[fold]
        columns = {"featuresCol": features, "labelCol": label, "predictionCol": out, "rawPredictionCol": f"{out}_raw"}
        if kind == "forest":
            est = RandomForestClassifier(numTrees=value, seed=seed, probabilityCol=f"{out}_p", **columns)
        elif kind == "svm":  # C weighs the sum of losses, regParam their mean
            est = LinearSVC(regParam=1.0 / (value * n), standardization=False, **{**columns, "featuresCol": svm_features})
        else:
            est = LogisticRegression(regParam=1.0 / (value * n), standardization=False, probabilityCol=f"{out}_p", **columns)
        return est.fit(d.where(F.col("__fold") != fold))

    tasks = list(product(sorted(sizes), members))
    with ThreadPool(parallelism) as pool:
        models = dict(zip(tasks, pool.map(fit, tasks), strict=True))
    d.unpersist()

    def predicted(fold):
        rows = reduce(lambda x, m: models[fold, m].transform(x), members, d.where(F.col("__fold") == fold))
        return rows.select("__fold", label, *name.values())

    grid = list(product(logistic_c, n_trees, svm_c))
    hit = [(F.col(name["logistic", c]) + F.col(name["forest", t]) + F.col(name["svm", v]) >= 2).cast("int") == F.col(label)
           for c, t, v in grid]
    per_fold = reduce(DataFrame.unionByName, map(predicted, sorted(sizes))).groupBy("__fold").agg(
        *[F.avg(h.cast("double")).alias(f"__a{k}") for k, h in enumerate(hit)])
    means = per_fold.agg(*[F.round(F.avg(f"__a{k}"), 12).alias(f"__a{k}") for k in range(len(grid))])
    means = means.withColumn("__all", F.array(*[f"__a{k}" for k in range(len(grid))]))
    first = F.array_position("__all", F.array_max("__all")) - 1
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(int(t)).alias("n_trees"), F.lit(float(v)).alias("svm_c"), F.lit(float(c)).alias("logistic_c"),
                 F.col(f"__a{k}").alias("cv_accuracy"), (first == k).alias("best"))
        for k, (c, t, v) in enumerate(grid)])).alias("x")).select("x.*")


def forest_votes(model, test: DataFrame, features: str = "features", out: str = "votes") -> DataFrame:
    """Per row, how many of a forest's trees vote for each class (array by class).

    The trees' nodes come from the model's saved form (``n_trees`` x at most
    2^(depth + 1) rows, a size that the model's parameters bound); every row walks
    all trees at once in numpy, in one pass over ``test`` without a shuffle.
    """
    spark = test.sparkSession
    path = run_folder(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.numCategories").alias("cats"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).collect()
    if any(n["feature"] >= 0 and n["cats"] >= 0 for n in nodes):
        raise ValueError("categorical splits are not supported")
    trees, size = model.getNumTrees, 1 + max(n["id"] for n in nodes)
    feature, left, right = (np.zeros((trees, size), np.int64) for _ in range(3))
    cut, leaf = np.zeros((trees, size)), np.zeros((trees, size), np.int64)
    for n in nodes:
        t, i, inner = n["treeID"], n["id"], n["feature"] >= 0
        leaf[t, i] = int(n["prediction"])
        feature[t, i], cut[t, i] = (n["feature"], n["cut"]) if inner else (0, 0.0)
        left[t, i], right[t, i] = (n["leftChild"], n["rightChild"]) if inner else (i, i)
    classes, depth = model.numClasses, model.getMaxDepth()

    @F.pandas_udf("array<int>")
    def votes(x: pd.Series) -> pd.Series:
        every, found = np.arange(trees), []
        for at in range(0, len(x), 256):
            m = np.stack(x.iloc[at:at + 256].to_list()).astype(float)
            node = np.zeros((len(m), trees), np.int64)
            for _ in range(depth):
                goes = m[np.arange(len(m))[:, None], feature[every, node]] <= cut[every, node]
                node = np.where(goes, left[every, node], right[every, node])
            vote = leaf[every, node]
            found += list(np.stack([(vote == c).sum(axis=1) for c in range(classes)], axis=1).astype(np.int32))
        return pd.Series(found)

    return test.withColumn(out, votes(vector_to_array(features)))


def vote_winner(votes: str = "votes"):
    """The class with the most votes; a tie goes to the smallest."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("double")


def bagged_trees(train: DataFrame, test: DataFrame, n_trees: int, rows_per_tree: int,
                 features: str = "features", label: str = "label", seed: int = 0) -> DataFrame:
    """Many depth-2 trees on small row subsets (no replacement), all
    features; the test rows with ``votes`` (see :func:`forest_votes`), from which the
    single trees' mean score and the hard vote are plain aggregates."""
    n = max(train.count(), 1)
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_trees,
                                maxDepth=2, featureSubsetStrategy="all", bootstrap=False,
                                subsamplingRate=min(1.0, rows_per_tree / n), seed=seed)
    return forest_votes(rf.fit(train), test, features)


def precision_recall(pred: DataFrame, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Precision and recall of the positive class in one aggregate."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    agg = pred.agg(F.sum((y & p).cast("long")).alias("tp"),
                   F.sum((~y & p).cast("long")).alias("fp"),
                   F.sum((y & ~p).cast("long")).alias("fn"),
                   F.count("*").alias("n"))
    return agg.select("tp", "fp", "fn", "n",
                      F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def binary_subset(df: DataFrame, label: str, classes=(0, 1), features: str = "features",
                  indices=(0, 1), out: str = "features2") -> DataFrame:
    """Rows of two classes and two chosen feature columns."""
    d = df.where(F.col(label).isin(list(classes)))
    return VectorSlicer(inputCol=features, outputCol=out, indices=list(indices)).transform(d)


def two_moons(spark, n: int, noise: float = 0.4, seed: int = 0) -> DataFrame:
    """Two interleaving half circles with Gaussian noise (hash normals),
    generated with ``range`` on the executors."""
    d = spark.range(n)
    half = F.col("id") % 2
    t = randoms.hash_uniform("id", seed=seed, stream=0) * F.lit(math.pi)
    x0 = F.when(half == 0, F.cos(t)).otherwise(F.lit(1.0) - F.cos(t))
    x1 = F.when(half == 0, F.sin(t)).otherwise(F.lit(0.5) - F.sin(t))
    return d.select("id",
                    (x0 + noise * randoms.hash_normal("id", seed=seed, stream=1)).alias("x0"),
                    (x1 + noise * randoms.hash_normal("id", seed=seed, stream=2)).alias("x1"),
                    half.cast("int").alias("label"))
