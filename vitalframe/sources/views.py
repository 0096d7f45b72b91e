"""Demography-shaped views derived from the given TPC-H-like tables.

The registered queries run the library's operators on these views; the
same projections are written as SQL in ``plans/catalog_sql.py`` so an
independent engine can check every result.  Mapping:

* location_id = supplier nation, age_group_id = p_size % 20 + 2,
  sex_id = l_linenumber % 2 + 1, year_id = year(l_shipdate),
  scenario = l_orderkey % 3 - 1, draw = l_linenumber
* risk = o_orderpriority, acause = p_type
* sev = 10 * l_discount (0..1), rr = 0.5 + 50 * l_tax (0.5..4.5)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table


def demography(spark: SparkSession, sf_dir: str, with_risk: bool = False,
               with_cause: bool = True) -> DataFrame:
    """lineitem x part x supplier (x orders): one row per line item."""
    l = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount",
        "l_tax", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    df = (l.join(p, l.l_partkey == p.p_partkey)
           .join(s, l.l_suppkey == s.s_suppkey))
    if with_risk:
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        df = df.join(o, df.l_orderkey == o.o_orderkey)
    cols = [
        F.col("s_nationkey").cast("int").alias("location_id"),
        (F.col("p_size") % 20 + 2).cast("int").alias("age_group_id"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("sex_id"),
        F.year("l_shipdate").cast("int").alias("year_id"),
        (F.col("l_orderkey") % 3 - 1).cast("int").alias("scenario"),
        F.col("l_linenumber").cast("int").alias("draw"),
        (F.col("l_discount") * 10).alias("sev"),
        (F.lit(0.5) + F.col("l_tax") * 50).alias("rr"),
        "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag",
    ]
    if with_cause:
        cols.append(F.col("p_type").alias("acause"))
    if with_risk:
        cols.append(F.col("o_orderpriority").alias("risk"))
    return df.select(*cols)


def _base(spark, sf_dir, d):
    return d if d is not None else demography(spark, sf_dir, with_risk=True)


def sev_by_risk(spark, sf_dir, d: DataFrame | None = None) -> DataFrame:
    """SEV draws per (risk, location, year, draw): mean of 10 * discount.

    Pass the same ``d`` (from :func:`demography` with risks) to every view
    of one query so the join is planned once and its exchanges are reused.
    """
    d = _base(spark, sf_dir, d)
    return d.groupBy("risk", "location_id", "year_id", "draw").agg(F.avg("sev").alias("sev"))


def rr_by_cause(spark, sf_dir, d: DataFrame | None = None) -> DataFrame:
    """RR draws per (cause, risk, draw): max of 0.5 + 50 * tax (no location
    or year key, so the PAF join uses the keys RR has)."""
    d = _base(spark, sf_dir, d)
    return d.groupBy("acause", "risk", "draw").agg(F.max("rr").alias("rr"))


def mediation(spark, sf_dir, d: DataFrame | None = None) -> DataFrame:
    """Mediation rows (acause, risk, mediator, mean)."""
    d = _base(spark, sf_dir, d)
    med = (F.when(F.col("l_returnflag") == "A", F.lit("1-URGENT"))
            .when(F.col("l_returnflag") == "N", F.lit("3-MEDIUM"))
            .otherwise(F.lit("5-LOW")))
    return (d.withColumn("mediator", med)
             .groupBy("acause", "risk", "mediator")
             .agg((F.avg("sev") / 10).alias("mean")))


def risk_hierarchy(spark, sf_dir) -> DataFrame:
    """Risk tree from region/nation: root 0, regions 100+k (level 1),
    nations 200+k (level 2); path_to_top_parent is the id path."""
    r = read_table(spark, sf_dir, "region")
    n = read_table(spark, sf_dir, "nation")
    regions = r.select((F.col("r_regionkey") + 100).alias("rei_id"),
                       F.col("r_name").alias("rei"),
                       F.concat_ws(",", F.lit("0"), (F.col("r_regionkey") + 100).cast("string"))
                       .alias("path_to_top_parent"), F.lit(1).alias("level"))
    nations = n.select((F.col("n_nationkey") + 200).alias("rei_id"),
                       F.col("n_name").alias("rei"),
                       F.concat_ws(",", F.lit("0"), (F.col("n_regionkey") + 100).cast("string"),
                                   (F.col("n_nationkey") + 200).cast("string"))
                       .alias("path_to_top_parent"), F.lit(2).alias("level"))
    return regions.unionByName(nations)


def cause_risk_pairs(spark, sf_dir) -> DataFrame:
    """(acause, risk) = (market segment, nation name) of customers."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .select(F.col("c_mktsegment").alias("acause"), F.col("n_name").alias("risk"))
             .distinct())


def _grouping_id(all_cols, subset):
    """Spark's grouping_id for ``subset`` of ``all_cols`` (bit set = absent,
    first column most significant)."""
    gid = 0
    for c in all_cols:
        gid = (gid << 1) | (0 if c in subset else 1)
    return gid


def paf_inputs(spark, sf_dir, materialize: bool = True):
    """SEV, RR and mediation tables from ONE pass over the demography join.

    The three inputs group the same rows by different keys; GROUPING SETS
    computes them in a single scan (Expand + one partial/final aggregate)
    instead of three scans of the four-way join.  The aggregate is small
    (bounded by its key space) and is checkpointed to the shared checkpoint
    folder, so every later consumer reads it instead of re-running the join.
    """
    from ..session import cut_lineage
    d = demography(spark, sf_dir, with_risk=True)
    med = (F.when(F.col("l_returnflag") == "A", F.lit("1-URGENT"))
            .when(F.col("l_returnflag") == "N", F.lit("3-MEDIUM"))
            .otherwise(F.lit("5-LOW")))
    d = d.withColumn("mediator", med)
    cols = ["risk", "location_id", "year_id", "draw", "acause", "mediator"]
    sets = [["risk", "location_id", "year_id", "draw"], ["acause", "risk", "draw"],
            ["acause", "risk", "mediator"]]
    agg = (d.groupingSets(sets, *cols)
             .agg(F.avg("sev").alias("sev"), F.max("rr").alias("rr"),
                  F.grouping_id().alias("__gid")))
    if materialize:
        agg = cut_lineage(agg)
    gid = [_grouping_id(cols, s_) for s_ in sets]
    sev = agg.where(F.col("__gid") == gid[0]).select(*sets[0], "sev")
    rr = agg.where(F.col("__gid") == gid[1]).select(*sets[1], "rr")
    mediation_ = agg.where(F.col("__gid") == gid[2]).select(
        *sets[2], (F.col("sev") / 10).alias("mean"))
    return sev, rr, mediation_


def priority_hierarchy(spark, sf_dir) -> DataFrame:
    """Risk tree over order priorities: root 0; level-1 groups 'urgent'
    (id 1: priorities 1-2) and 'routine' (id 2: 3-5); each priority p is a
    level-2 risk with id 10 + p and path '0,<group>,<id>'."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rei")).distinct()
    digit = F.substring("rei", 1, 1).cast("int")
    grp = F.when(digit <= 2, F.lit(1)).otherwise(F.lit(2))
    leaves = o.select((digit + 10).alias("rei_id"), "rei",
                      F.concat_ws(",", F.lit("0"), grp.cast("string"),
                                  (digit + 10).cast("string")).alias("path_to_top_parent"),
                      F.lit(2).alias("level"))
    groups = spark.createDataFrame([(1, "urgent", "0,1", 1), (2, "routine", "0,2", 1)],
                                   "rei_id int, rei string, path_to_top_parent string, level int")
    return groups.unionByName(leaves)
