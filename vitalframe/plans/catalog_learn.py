"""Registered queries of the models that are grown or trained step by step on Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn, sgd, trees
from .catalog import _two_class_frame, register, rounded, tbl


@register("tree_leaf_grid")
def q_tree_leaf_grid(spark, sf):
    """5-fold cross-validated accuracy of trees of 2 to 7 leaves, grown best split first, on all labels."""
    return rounded(trees.leaf_grid(tbl(spark, sf, "embeddings"), "embedding", "label", "vec_id", range(2, 8), 5, seed=2), 4)


@register("bagged_leaf_trees")
def q_bagged_leaf_trees(spark, sf):
    """M21 + M19: 1000 trees of 4 leaves, each on exactly 100 rows without replacement; the single trees' mean
    accuracy and that of their vote (ties: the smallest class), on all labels as two classes."""
    e = _two_class_frame(spark, sf).select("id", "embedding", "label")
    train, test = learn.hash_split(e, ["id"], 0.7, seed=4)
    grown = trees.bag(train, 1000, 100, 4, 2, "id", "embedding", "label", seed=4)
    got = trees.bag_votes(grown, test, "embedding", 2)
    out = got.agg(F.avg(F.get("votes", F.col("label")) / 1000.0).alias("mean_single_accuracy"),
                  F.avg((learn.vote_winner() == F.col("label")).cast("double")).alias("vote_accuracy"))
    return rounded(out.unpivot([], ["mean_single_accuracy", "vote_accuracy"], "metric", "value"), 4)


@register("minibatch_logistic")
def q_minibatch_logistic(spark, sf):
    """60 epochs of mini-batches of 50 at rate 0.01, local updates averaged per epoch, on 80 % of all labels as
    two classes: the loss of every epoch, then precision and recall at 0.5 on the rest."""
    e = _two_class_frame(spark, sf).select("id", "embedding", "label")
    train, test = learn.hash_split(e, ["id"], 0.8, seed=28)
    w, losses = sgd.minibatch_logistic(train, "embedding", "label", "id", seed=28)
    told = spark.createDataFrame([("loss", i, float(v)) for i, v in enumerate(losses)], "metric string, epoch int, value double")
    scored = test.withColumn("prediction", (sgd.logistic_score(w, "embedding") >= 0.5).cast("double"))
    found = learn.precision_recall(scored).select(
        F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    found = found.unpivot([], ["precision", "recall"], "metric", "value").withColumn("epoch", F.lit(len(losses) - 1))
    return rounded(told.unionByName(found), 4)
