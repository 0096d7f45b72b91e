"""Exact quantiles of a continuous column as distributed order statistics.

``percentile`` keeps every distinct value of a group in one task's buffer.  Here only
groups of at most ``FIT`` values do.  In a larger one every wanted rank has an
interval of values, at first the whole range.  A round counts the interval's values
in ``BINS`` bins (partial counts per task, no sort), finds the bin that holds the rank
and goes on with the least and the largest value of that bin.  Bins are of equal
width in one round and of growing width in the next, so neither clusters nor long
tails stop the narrowing; counts are exact, so the kind of bin never touches the
result.  An interval ends when its values fit a task or are all the same; then the
rank's value is read off, and two neighbours give the linear interpolation.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FIT = 1 << 14              # values of a group that one task holds
BINS = 1024
BROADCAST_ROWS = 100_000   # intervals that are broadcast; more are joined by salted shuffles
_SALTS = 32
_TAIL = 1e15               # how fine the first bins of growing width are, against the interval
_TOP = sys.float_info.max


def _beside(rows: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """Rows with the interval (``lo``, ``hi``) of their group that they lie in, if any."""
    inside = (F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi"))
    if n_cells <= BROADCAST_ROWS:
        return rows.join(F.broadcast(cells), "__k").where(inside)
    salted = cells.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (rows.withColumn("__s", F.pmod(F.xxhash64("__x"), F.lit(_SALTS)).cast("int"))
            .join(salted, ["__k", "__s"]).where(inside).drop("__s"))


def _bin(growing: bool, bins: int):
    part = (F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    if growing:
        part = F.log1p(part * F.lit(_TAIL)) / F.log1p(F.lit(_TAIL))
    return F.least(F.floor(part * bins), F.lit(bins - 1)).cast("int")


def _narrow(rows: DataFrame, wanted: DataFrame, n_cells: int, growing: bool, bins: int) -> DataFrame:
    """Intervals (__k, r, lo, hi, base, c) narrowed to the bin that holds rank r."""
    cells = wanted.select("__k", "lo", "hi").distinct()
    counted = (_beside(rows, cells, n_cells).groupBy("__k", "lo", "hi", _bin(growing, bins).alias("__b"))
               .agg(F.count("*").alias("c"), F.min("__x").alias("m"), F.max("__x").alias("mm")))
    # at most ``bins`` rows of an interval
    w = Window.partitionBy("__k", "lo", "hi").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("u", F.coalesce(F.sum("c").over(w), F.lit(0)))
    at = F.col("r") - F.col("base")
    return (wanted.drop("c").join(before, ["__k", "lo", "hi"]).where((F.col("u") <= at) & (at < F.col("u") + F.col("c")))
            .select("__k", "r", F.col("m").alias("lo"), F.col("mm").alias("hi"), (F.col("base") + F.col("u")).alias("base"), "c"))


def exact_quantiles(df: DataFrame, value: str, probs, by=(), names=None, fit: int = FIT, bins: int = BINS) -> DataFrame:
    """Quantiles with linear interpolation: ``by`` columns, ``n`` (values) and one column per probability.

    Null and NaN are left out; infinite values count as the largest doubles.  A group
    without values has no row (without ``by``: one row of nulls).  Null keys are a group.
    """
    by, probs = list(by), [float(p) for p in probs]
    names = names or [f"p{int(round(p * 1000)):03d}" for p in probs]
    x = F.greatest(F.least(F.col(value).cast("double"), F.lit(_TOP)), F.lit(-_TOP))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("k0"))
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = cut_lineage(some.select(key.alias("__k"), x.alias("__x")), "quantile-values")

    large = rows.groupBy("__k").agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    large = cut_lineage(large.where(F.col("n") > fit), "quantile-groups")
    n_large = large.count()
    arr = F.array(*[F.lit(p) for p in probs])
    small = rows
    if n_large:
        side = large.select("__k")
        small = rows.join(F.broadcast(side) if n_large <= BROADCAST_ROWS else side, "__k", "left_anti")
    whole = F.percentile("__x", arr)
    if by or n_large:
        out = small.groupBy("__k").agg(F.count("*").alias("n"), whole.alias("__q"))
    else:
        out = small.agg(F.lit(None).alias("__k"), F.count("*").alias("n"), whole.alias("__q"))
    parts = [out.select("__k", "n", *[F.col("__q")[i].alias(c) for i, c in enumerate(names)])]
    if n_large:
        parts.append(_large(rows, large, probs, names, fit, bins))
    found = reduce(DataFrame.unionByName, [p.select(*[F.col(f"__k.k{i}").alias(c) for i, c in enumerate(by)],
                                                    "n", *names) for p in parts])
    return found


def _large(rows: DataFrame, large: DataFrame, probs, names, fit: int, bins: int) -> DataFrame:
    def spot(p):
        return F.lit(p) * (F.col("n") - 1)

    ranks = F.array_distinct(F.array(*[f(spot(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    wanted = large.select("__k", F.explode(ranks).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("base"),
                          F.col("n").alias("c"))
    rows = rows.join(F.broadcast(large.select("__k")) if large.count() <= BROADCAST_ROWS else large.select("__k"),
                     "__k", "left_semi")
    done, turn = [], 0
    while True:
        wanted = cut_lineage(wanted, "quantile-intervals")
        fits = (F.col("c") <= fit) | (F.col("lo") == F.col("hi"))
        done.append(wanted.where(fits))
        wanted = wanted.where(~fits)
        n_cells = wanted.count()
        if not n_cells:
            break
        wanted = _narrow(rows, wanted, n_cells, turn % 2 == 1, bins)
        turn += 1
    ends = reduce(DataFrame.unionByName, done)
    same = ends.where(F.col("lo") == F.col("hi")).select("__k", "r", F.col("lo").alias("v"))
    open_ = ends.where(F.col("lo") < F.col("hi"))
    cells = open_.select("__k", "lo", "hi").distinct()
    held = (_beside(rows, cells, open_.count()).groupBy("__k", "lo", "hi")
            .agg(F.sort_array(F.collect_list("__x")).alias("__all")))  # at most ``fit`` values
    read = open_.join(held, ["__k", "lo", "hi"]).select(
        "__k", "r", F.element_at("__all", (F.col("r") - F.col("base") + 1).cast("int")).alias("v"))
    values = same.unionByName(read).groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("__at"))

    def value(p):
        pos = spot(p)
        low, high = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - pos) * a + (pos - low) * b)

    return values.join(large.select("__k", "n"), "__k").select("__k", "n", *[value(p).alias(c) for p, c in zip(probs, names)])
