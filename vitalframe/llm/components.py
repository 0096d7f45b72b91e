"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, root) for every node of the edges except the roots; root is the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest one, then every
    node's smaller neighbours to the smallest of them, until the edges no longer
    change: all are then (node, root).  Rounds are written as tables in the shared
    checkpoint folder, the last one in place of the one before; nothing is collected but
    a count and a hash.
    """
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .where(F.col("u") != F.col("v")).distinct())
    now = cut_lineage(now, name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select("v", "m").toDF("u", "v").unionByName(low.toDF("u", "v")).distinct())
        now = cut_lineage(small, name, replaces=now)
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]
