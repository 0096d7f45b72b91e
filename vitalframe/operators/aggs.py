"""Aggregation operators.

Aggregates are written so Spark can combine map-side (partial aggregation)
before the shuffle: a hot key then costs one partial row per map task, not
one row per input row.  Group statistics are attached back by joining the
small aggregated side (AQE measures it and broadcasts it when it is small),
never by a window over a possibly huge partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def group_mean(df: DataFrame, keys, value: str, out: str = "mean",
               plus: float | None = None, plus_col: str = "limit") -> DataFrame:
    """A1: group mean, renamed, plus an optional constant column."""
    res = df.groupBy(*keys).agg(F.avg(value).alias(out))
    if plus is not None:
        res = res.withColumn(plus_col, F.col(out) + F.lit(plus))
    return res


def element_frequency(df: DataFrame, array_col: str, out: str = "item",
                      ascending: bool = False) -> DataFrame:
    """A2: count per array element, sorted by count then element (tie-break).

    ``explode`` + ``groupBy.count`` combines map-side; a hot element is one
    partial count per task.
    """
    res = (df.select(F.explode(F.col(array_col)).alias(out))
             .groupBy(out).agg(F.count("*").alias("n")))
    order = F.col("n").asc() if ascending else F.col("n").desc()
    return res.orderBy(order, F.col(out).asc())


def group_sums(df: DataFrame, keys, values) -> DataFrame:
    """Group sums of several value columns (names kept)."""
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def product_of_complements(factors: DataFrame, keys, value: str = "mean",
                           out: str = "mediation") -> DataFrame:
    """A4: ``prod(1 - value)`` per key (one row per key present)."""
    return factors.groupBy(*keys).agg(
        F.product(F.lit(1.0) - F.col(value)).alias(out))


def attach_product(df: DataFrame, products: DataFrame, keys,
                   out: str = "mediation", default: float = 1.0) -> DataFrame:
    """A4: left join of the products with default 1.0 for keys without rows."""
    return (df.join(products, list(keys), "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(default))))


def combine_risks(paf: DataFrame, group_keys, cell_keys, risk: str = "risk",
                  value: str = "paf", weight: str | None = "mediation",
                  out: str = "paf", materialize: bool = False) -> DataFrame:
    """A5: ``1 - prod_r (1 - paf_r * m_r)`` per cell, over all usable risks.

    ``group_keys`` (e.g. acause, version) define which risks are usable: a
    cell is kept only if it has a row for *every* risk present anywhere in
    its group (the successive inner merges of the original).  One pass over
    the PAF rows: per (group, cell) the product and the set of risks seen
    (bounded by the number of risks); the group's usable set is the union of
    its cells' sets, computed on the already-aggregated cell table.
    ``materialize`` checkpoints the cell table, which has two consumers.
    """
    group_keys, cell_keys = list(group_keys), list(cell_keys)
    term = F.lit(1.0) - F.col(value) * (F.col(weight) if weight else F.lit(1.0))
    cells = (paf.groupBy(*group_keys, *cell_keys)
                .agg(F.product(term).alias("__prod"),
                     F.collect_set(F.col(risk)).alias("__risks")))
    if materialize:
        from ..session import cut_lineage
        cells = cut_lineage(cells)
    usable = (cells.select(*group_keys, F.explode("__risks").alias("__r")).distinct()
                   .groupBy(*group_keys).agg(F.count("*").alias("__n_usable")))
    return (cells.join(usable, group_keys, "inner")
                 .where(F.size("__risks") == F.col("__n_usable"))
                 .select(*group_keys, *cell_keys,
                         (F.lit(1.0) - F.col("__prod")).alias(out)))


def rescale_by_group_max(df: DataFrame, group_keys, value: str = "paf",
                         threshold: float = 0.95) -> DataFrame:
    """If the group max (over all keys and draws) exceeds ``threshold``,
    multiply the group's values by ``threshold / max``.

    The max is a grouped aggregate (partial max per task) joined back; the
    aggregate has one row per group.
    """
    mx = df.groupBy(*group_keys).agg(F.max(value).alias("__max"))
    scale = F.when(F.col("__max") > threshold,
                   F.lit(threshold) / F.col("__max")).otherwise(F.lit(1.0))
    return (df.join(mx, list(group_keys), "inner")
              .withColumn(value, F.col(value) * scale).drop("__max"))


def draw_summary(df: DataFrame, keys, value: str = "value",
                 lower: float = 0.025, upper: float = 0.975, bounded: bool = True) -> DataFrame:
    """Mean and exact linear-interpolated percentiles over draws.

    ``bounded`` groups are the draws of one cell, so the value->count map that an
    exact percentile keeps per group is small; groups of any size take
    ``bounded=False`` (:func:`~.quantiles.exact_quantiles`, NaN left out).
    """
    if not bounded:
        q = exact_quantiles(df, value, (lower, upper), keys, ["lower", "upper"]).drop("n")
        q = q.select(*[F.col(k).alias(f"__{k}") for k in keys], "lower", "upper")
        mean = df.where(~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.avg(value).alias("mean"))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return mean.join(q, on).select(*keys, "mean", "lower", "upper")
    q = F.percentile(F.col(value), F.array(F.lit(lower), F.lit(upper)))
    return (df.groupBy(*keys)
              .agg(F.avg(value).alias("mean"), q.alias("__q"))
              .select(*keys, "mean", F.col("__q")[0].alias("lower"),
                      F.col("__q")[1].alias("upper")))


def mean_over_draws(df: DataFrame, keys, value: str = "value",
                    out: str | None = None) -> DataFrame:
    """Mean over the draw dimension."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out or value))


def column_quantiles(df: DataFrame, value: str, probs=(0.5,), exact: bool = True,
                     accuracy: int = 100000, names=None, by=()) -> DataFrame:
    """Median / percentiles of one column, per group if ``by``.

    ``exact=True`` narrows intervals of values by counting until they fit a task
    (:func:`~.quantiles.exact_quantiles`), for any size and any column;
    ``exact=False`` is ``percentile_approx`` with bounded memory in one pass.
    """
    names = names or [f"p{int(round(p * 1000)):03d}" for p in probs]
    if exact:
        return exact_quantiles(df, value, probs, by, names).drop("n")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*by).agg(F.percentile_approx(F.col(value), arr, accuracy).alias("__q")).select(
        *by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def top_n(df: DataFrame, value: str, n: int = 10, tie_break=()) -> DataFrame:
    """The ``n`` largest rows (TakeOrderedAndProject: per-task top-n,
    then a merge of n rows per task)."""
    return df.orderBy(F.col(value).desc(), *[F.col(t).asc() for t in tie_break]).limit(n)


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """A10: distinct values (as rows; the sort is for presentation only)."""
    return df.select(column).distinct().orderBy(column)


def hierarchy_clusters(cause_risks: DataFrame, risk_table: DataFrame,
                       levels=(1, 2, 3), risk: str = "risk") -> DataFrame:
    """(cluster, risk) rows: each risk under its ancestors at ``levels``.

    The ancestor at level L is element L of ``path_to_top_parent`` (comma
    list, position 0 = root); it must itself be a risk of level 1-3, else the
    pair is skipped (the original swallowed these lookups in try/except).
    A cluster whose only member is the ancestor itself is skipped.
    Output is long; ``collect_list`` per cluster is left to the caller since
    the per-cluster lists are bounded by the number of risks.
    """
    levels = list(levels)
    paths = risk_table.select(F.col("rei").alias(risk), "path_to_top_parent")
    pos = (cause_risks.join(paths, risk, "inner")
           .select("*", F.posexplode(F.split("path_to_top_parent", ","))
                   .alias("__lvl", "__anc"))
           .where(F.col("__lvl").isin(levels))
           .withColumn("__anc_id", F.trim(F.col("__anc")).try_cast("int")))
    ids = (risk_table.where(F.col("level").isin(levels))
           .select(F.col("rei_id").alias("__anc_id"), F.col("rei").alias("cluster")))
    pairs = (pos.join(ids, "__anc_id", "inner")
                .drop("__lvl", "__anc", "__anc_id", "path_to_top_parent")
                .distinct())
    other_keys = [c for c in cause_risks.columns if c != risk]
    sizes = pairs.groupBy(*other_keys, "cluster").agg(
        F.count("*").alias("__size"), F.max(F.col(risk) == F.col("cluster"))
        .alias("__self"))
    keep = sizes.where(~((F.col("__size") == 1) & F.col("__self")))
    return pairs.join(keep.select(*other_keys, "cluster"), other_keys + ["cluster"],
                      "left_semi")


def related_set(pairs: DataFrame, key_col: str, key_value, value_col: str,
                unavailable: DataFrame | None = None, extra=None) -> DataFrame:
    """Distinct values related to one key, plus special-case additions,
    minus an unavailable list (anti-join)."""
    res = pairs.where(F.col(key_col) == F.lit(key_value)).select(value_col).distinct()
    if extra:
        add = pairs.sparkSession.createDataFrame([(v,) for v in extra], [value_col])
        res = res.unionByName(add).distinct()
    if unavailable is not None:
        res = res.join(unavailable.select(value_col), value_col, "left_anti")
    return res


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pairwise-complete Pearson correlations, all pairs in one ``agg``
    (``corr`` skips rows where either value is null, like pandas)."""
    columns = list(columns)
    aggs = []
    for i, a in enumerate(columns):
        for b in columns:
            aggs.append(F.corr(a, b).alias(f"{a}__{b}"))
    wide = df.agg(*aggs)
    stack = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                               F.col(f"{a}__{b}").alias("corr"))
                      for a in columns for b in columns])
    return wide.select(F.inline(stack))


def key_of_max(df: DataFrame, key: str, value: str, by=()) -> DataFrame:
    """Key with the highest value (``max_by``), per group if ``by``; a tie
    goes to the largest key, whatever the row order."""
    return df.groupBy(*by).agg(F.max_by(key, F.struct(value, key)).alias(key),
                               F.max(value).alias(value))


def histogram(df: DataFrame, value: str, bins: int = 10, by=()) -> DataFrame:
    """Fixed-width histogram over [min, max] (width = range / bins).

    Min/max is a tiny aggregate: per group it is joined back (AQE sizes the
    join); without groups its two numbers become literals.  The top edge
    falls into the last bin.
    """
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    if by:
        j = df.join(rng, by, "inner")
    else:  # one row of two numbers: literals, no join
        r = rng.first()
        j = df.withColumns({"__lo": F.lit(r["__lo"]), "__hi": F.lit(r["__hi"])})
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1)))
    return (j.where(F.col(value).isNotNull())
             .withColumn("bin", b.cast("int"))
             .groupBy(*by, "bin")
             .agg(F.count("*").alias("n"),
                  F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
             .withColumn("bin_lo", F.col("__lo") + F.col("bin") *
                         (F.col("__hi") - F.col("__lo")) / F.lit(float(bins)))
             .drop("__lo", "__hi"))


def group_share(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """``value / (rows in group)`` via a grouped count joined back."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return (df.join(counts, list(keys), "inner")
              .withColumn(out, F.col(value) / F.col("__n")).drop("__n"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Global min and max of a column (one row)."""
    return df.agg(F.min(column).alias(f"min_{column}"),
                  F.max(column).alias(f"max_{column}"))


def box_stats(df: DataFrame, level: str, value: str, exact: bool = True,
              accuracy: int = 100000) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 IQR) per level.

    Quartiles as in :func:`column_quantiles`: exact for a level of any size, or
    approximate in one pass.
    """
    q = column_quantiles(df, value, (0.25, 0.5, 0.75), exact, accuracy, ["q1", "median", "q3"], [level])
    iqr = F.col("q3") - F.col("q1")
    inside = (df.join(q, level, "inner")
                .where((F.col(value) >= F.col("q1") - 1.5 * iqr) &
                       (F.col(value) <= F.col("q3") + 1.5 * iqr))
                .groupBy(level).agg(F.min(value).alias("whisker_lo"),
                                    F.max(value).alias("whisker_hi")))
    return q.join(inside, level, "left")
