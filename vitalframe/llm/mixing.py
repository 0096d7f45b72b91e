"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a fixed hash of its id (60 bits of an md5, so another
engine can check it).  A source with target t and size s takes every document
floor(t / s) times and, once more, those whose hash lies below the source's
threshold.  The threshold comes from a histogram: word counts summed by source
and hash bucket, of which only the bucket that holds the boundary is refined, by
the next ``BITS`` bits, until it holds one hash; nothing is sorted.  Thresholds are
nested: a larger budget takes a superset.

Defined cases: a null text has size 0; a null source is a source, last in order; a
null id has a hash of its own; rows that repeat an id share their fate; a source
of size 0 has target 0; an empty table gives an empty result; columns beside the
named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (5, 2, 1)      # by order of the source, repeating
MOST = 3                 # times that a document may be taken
BITS, HASH_BITS = 10, 60
WORDS = r"[^\x20\x09-\x0D]+"


def place(doc_id: Column) -> Column:
    """A document's fixed place: 60 bits of the md5 of its id."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source: str = "source") -> DataFrame:
    """(doc_id, _s, size, _h): the few numbers of a document that mixing needs."""
    return documents.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("_s"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        place(F.col(id_col)).alias("_h"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_s, source_size, target): shares by weight, capped at ``most`` times the size, the
    excess reshared by weight.  One row per source from here on, so one window orders them."""
    order = Window.orderBy(F.col("_s").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])[place]
    per = (sizes.groupBy("_s").agg(F.sum("size").alias("source_size")).withColumn("_w", w)
           .withColumn("_cap", (F.col("source_size") * most).cast("double")))
    # In order of cap / weight the capped sources are a prefix: a source is capped if what the
    # earlier ones leave, shared by weight, gives it more than its cap.
    by = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_s").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = (F.sum(F.col("source_size").cast("double")).over(everything)
            - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    marked = (per.withColumns({"_left": left, "_wl": weight_left})
              .withColumn("_capped", F.col("_left") / F.col("_wl") * F.col("_w") >= F.col("_cap")))
    free = ~F.col("_capped")
    level = (F.max(F.when(free, F.col("_left"))).over(everything)
             / F.max(F.when(free, F.col("_wl"))).over(everything))
    return marked.select("_s", "source_size", F.when(F.col("_capped"), F.col("_cap"))
                         .otherwise(F.col("_w") * level).alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals with ``_whole`` (times that all is taken) and ``_below`` (hash threshold of one more)."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    state = cut_lineage(goals.withColumn("_whole", whole.cast("long")).withColumn(
        "_part", F.col("target") - (F.col("_whole") * size).cast("double")).withColumns(
        {"_lo": F.lit(0).cast("long"), "_acc": F.lit(0).cast("long"), "_in": size.cast("long")}), "mix-state")
    left = HASH_BITS
    while left > 0:
        left -= BITS
        step = 1 << left
        narrow = state.select(F.col("_s").alias("_s2"), "_lo", "_acc", "_part")
        inside = (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_lo") + F.lit(step << BITS))
        hist = (docs.join(narrow, F.col("_s").eqNullSafe(F.col("_s2")))
                .where(inside & (F.col("size") > 0))
                .groupBy("_s", "_lo", "_acc", "_part", F.expr(f"(_h - _lo) div {step}").alias("_b"))
                .agg(F.sum("size").alias("_n"), F.min("_h").alias("_first"), F.max("_h").alias("_last")))
        run = F.sum("_n").over(Window.partitionBy("_s").orderBy("_b"))
        hit = (hist.withColumn("_run", run).where(F.col("_run") > F.col("_part") - F.col("_acc"))
               .groupBy(F.col("_s").alias("_s2"))
               .agg(F.min_by(F.struct("_lo", "_b", "_acc", "_run", "_n", "_first", "_last"), "_b").alias("_x")))
        keep = [c for c in state.columns if c not in ("_lo", "_acc", "_in")]
        state = cut_lineage(
            state.join(hit, F.col("_s").eqNullSafe(F.col("_s2")), "left").select(
                *keep,
                F.coalesce(F.expr(f"_x._lo + _x._b * {step}"), F.col("_lo")).alias("_lo"),
                F.coalesce(F.expr("_x._acc + _x._run - _x._n"), F.col("_acc")).alias("_acc"),
                F.coalesce(F.expr("_x._n"), F.lit(0)).alias("_in"),
                F.coalesce(F.expr("_x._last - _x._first"), F.lit(0)).alias("_wide")), "mix-state")
        # A boundary bucket that holds a single hash needs no refining.
        if not state.where(F.col("_wide") > 0).take(1):
            break
        state = state.drop("_wide")
    # The boundary hash is taken if that comes nearer to the budget.
    nearer = (F.col("_acc") + F.col("_in") - F.col("_part")) < (F.col("_part") - F.col("_acc"))
    return state.select("_s", "source_size", "target", "_whole",
                        (F.col("_lo") + F.when(nearer, F.lit(1 << left)).otherwise(0)).alias("_below"))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id",
        text_col: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    docs = cut_lineage(sized(documents, id_col, text_col, source), "mix-sizes")
    plan = thresholds(docs, targets(docs, weights, most)).withColumnRenamed("_s", "_s2")
    copies = F.col("_whole") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)
    return (docs.join(plan, F.col("_s").eqNullSafe(F.col("_s2")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                    copies.alias("copies")))
