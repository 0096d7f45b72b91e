"""Window and ordered operators.

Every window is partitioned by a key whose groups are bounded by
construction (ages of one location, 52 weeks of one cohort, the duplicates
of one key) and ordered by an explicit column; row position without an
order key has no meaning in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shift(df: DataFrame, partition_by, order_by, column: str, offset: int = -1,
          out: str | None = None) -> DataFrame:
    """Pandas ``shift(offset)`` within groups: -1 = next row (lead),
    +1 = previous row (lag).  Partition by every key except the ordered one
    (e.g. location, year, draw when ordering by age) so each window group
    stays bounded; for consecutive integer orders a self-join on
    ``order + 1`` (as in ``fertility.cohort_lag``) avoids the sort."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    e = F.lead(column, -offset).over(w) if offset < 0 else F.lag(column, offset).over(w)
    return df.withColumn(out or f"{column}_shift{offset}", e)


def cohort_survivors(df: DataFrame, cohort_keys, week: str = "age_wks",
                     q: str = "q", births: str = "new_borns",
                     out: str = "pop") -> DataFrame:
    """Population by week of age after one year of weekly steps.

    The literal recurrence (52 steps: newborns enter week 1 after surviving
    q_1; every cohort moves up one week after surviving its week's q) leaves
    none of the initial population after 52 steps, so the result is the
    closed form ``c_k = N (1 - q_1) prod_{j<k} (1 - q_j)`` — a running
    product over the preceding rows of a 52-row window per cohort key.
    """
    w = (Window.partitionBy(*cohort_keys).orderBy(week)
               .rowsBetween(Window.unboundedPreceding, -1))
    w_first = Window.partitionBy(*cohort_keys).orderBy(week)
    survive_prev = F.coalesce(F.product(F.lit(1.0) - F.col(q)).over(w), F.lit(1.0))
    first_q = F.first(F.col(q)).over(w_first)
    return df.withColumn(out, F.col(births) * (F.lit(1.0) - first_q) * survive_prev)


def lag_pairs(df: DataFrame, order_by: str, value: str, partition_by=()) -> DataFrame:
    """(value_i, value_{i+1}) pairs for a lag-1 autocorrelation fit.

    Without ``partition_by`` the whole table is one series, in range partitions that
    exchange only their edge rows; ``partition_by`` (e.g. a series id) is for many
    series of bounded length."""
    if not partition_by:
        from .ordered import global_lag_pairs
        return global_lag_pairs(df, [order_by] if isinstance(order_by, str) else list(order_by), value)
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    return (df.withColumn("next_" + value, F.lead(value, 1).over(w))
              .where(F.col("next_" + value).isNotNull()))


_ORDERABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
              T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _sort_key(df: DataFrame, order_by):
    """An ascending-comparable struct equivalent to ``order_by`` (column
    names, or ``F.col(c).desc()``-style given as (name, descending)), or
    None when a column cannot be negated (strings sorted descending)."""
    parts = []
    for i, spec in enumerate(order_by):
        name, desc = spec if isinstance(spec, tuple) else (spec, False)
        dt = df.schema[name].dataType
        c = F.col(name)
        if desc:
            if not isinstance(dt, _ORDERABLE):
                return None
            if isinstance(dt, (T.DateType,)):
                c = F.unix_date(c)
            elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
                c = F.unix_micros(c.cast("timestamp"))
            c = -c
        parts += [F.col(name).isNull().alias(f"n{i}"), c.alias(f"k{i}")]  # nulls last
    return F.struct(*parts)


def _specs(order_by) -> list:
    """Sort columns with nulls last; a given Column keeps its own order."""
    out = []
    for o in order_by:
        name, desc = o if isinstance(o, tuple) else (o, False)
        out.append((F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last())
                   if isinstance(name, str) else name)
    return out


def dedupe_first(df: DataFrame, keys, order_by) -> DataFrame:
    """One row per key, the first after sorting by ``order_by``.

    ``order_by`` items are column names or ``(name, descending)`` pairs;
    pass a full tie-break for a deterministic pick (``dropDuplicates`` keeps
    an arbitrary row).  When every descending column is numeric or temporal
    this is a ``min_by`` aggregate: map-side partial aggregation keeps one
    candidate per key per task, so a key holding a third of the rows never
    lands whole in one task.  Otherwise a ``row_number`` window is used.
    Nulls in an order column sort last in either direction and on either path.
    """
    keys = list(keys)
    order_by = [o if isinstance(o, (str, tuple)) else o for o in order_by]
    if all(isinstance(o, (str, tuple)) for o in order_by):
        key = _sort_key(df, order_by)
        if key is not None:
            rest = [c for c in df.columns if c not in keys]
            row = F.struct(*[F.col(c) for c in rest])
            agg = df.groupBy(*keys).agg(F.min_by(row, key).alias("__row"))
            return agg.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]) \
                      .select(*df.columns)
    specs = _specs(order_by)
    w = Window.partitionBy(*keys).orderBy(*specs)
    return (df.withColumn("__rn", F.row_number().over(w))
              .where(F.col("__rn") == 1).drop("__rn"))


def repeated_rows(df: DataFrame, keys, order_by) -> DataFrame:
    """Rows that repeat a key (all but the first in ``order_by``).

    ``order_by`` must be a full tie-break within a key (it identifies the
    first row).  The first row per key comes from :func:`dedupe_first`'s
    aggregate path and is removed by a null-safe anti-join, so a hot key is
    never sorted inside one task; strings sorted descending fall back to a
    ``row_number`` window.
    """
    keys = list(keys)
    names = [o[0] if isinstance(o, tuple) else o for o in order_by]
    if all(isinstance(o, (str, tuple)) for o in order_by) and _sort_key(df, order_by) is not None:
        first = dedupe_first(df.select(*keys, *names), keys, order_by)
        first = first.select(*[F.col(c).alias(f"__f_{c}") for c in keys + names])
        cond = None
        for c in keys + names:
            e = df[c].eqNullSafe(first[f"__f_{c}"])
            cond = e if cond is None else cond & e
        return df.join(first, cond, "left_anti")
    specs = _specs(order_by)
    w = Window.partitionBy(*keys).orderBy(*specs)
    return (df.withColumn("__rn", F.row_number().over(w))
              .where(F.col("__rn") > 1).drop("__rn"))
