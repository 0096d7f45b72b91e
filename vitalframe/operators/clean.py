"""Projection, filter and clean-up operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, paf as pafx, text


def filter_all(df: DataFrame, *predicates) -> DataFrame:
    """AND of column predicates or SQL text; pushed to the scan."""
    preds = [F.expr(p) if isinstance(p, str) else p for p in predicates]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def null_rows(df: DataFrame, column: str, is_null: bool = True) -> DataFrame:
    """Rows where ``column`` is (not) null."""
    c = F.col(column)
    return df.where(c.isNull() if is_null else c.isNotNull())


def columns_by_prefix(df: DataFrame, prefix: str, keys=()) -> DataFrame:
    """Keys plus every column named ``prefix<number>``."""
    pat = re.compile(re.escape(prefix) + r"\d+$")
    return df.select(*keys, *[c for c in df.columns if pat.match(c)])


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """P5: drop rows with any null (or NaN) in ``subset``."""
    return df.dropna(how="any", subset=subset)


def fill_groups(df: DataFrame, groups: dict) -> DataFrame:
    """Fill nulls per column group: ``{0.0: sev_cols, 1.0: rr_cols}``."""
    fills = {}
    for value, cols in groups.items():
        for c in cols:
            fills[c] = value
    return df.fillna(fills)


def recode(df: DataFrame, column: str, values, label, out: str | None = None) -> DataFrame:
    """Values in ``values`` become ``label``; others unchanged."""
    c = F.col(column)
    return df.withColumn(out or column,
                         F.when(c.isin(list(values)), F.lit(label)).otherwise(c))


def numeric_or_drop(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Text to double; rows that do not parse are dropped."""
    out = out or column
    return df.withColumn(out, text.to_number(column)).where(F.col(out).isNotNull())


def add_age(df: DataFrame, birth: str, order: str, out: str = "age",
            max_age: int = 100, pivot: int = 17) -> DataFrame:
    """Age from two 'm/d/yy hh:mm' strings (order years below ``pivot`` are
    in the next century); keep age < ``max_age``."""
    return (df.withColumn(out, text.age_from_two_digit_years(birth, order, pivot))
              .where(F.col(out) < max_age))


def normalize_names(df: DataFrame, pattern: str = r"\.", repl: str = "_",
                    lower: bool = True) -> DataFrame:
    """P10: lower-case column names and regex-edit them."""
    names = [re.sub(pattern, repl, c.lower() if lower else c) for c in df.columns]
    return df.toDF(*names)


def replace_values(df: DataFrame, column: str, pattern: str, repl: str) -> DataFrame:
    """P10: regex edit of a string column's values."""
    return df.withColumn(column, F.regexp_replace(column, pattern, repl))


def drop_position(df: DataFrame, position: int, order_by, partition_by=()) -> DataFrame:
    """Drop the row at 1-based ``position`` of an explicit order.

    With ``partition_by`` the window is per group (of bounded size); a global
    position comes from range partitions and their prefix counts, for any size.
    """
    from pyspark.sql import Window
    if not partition_by:
        from .ordered import drop_global_position
        return drop_global_position(df, position, order_by)
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return (df.withColumn("__pos", F.row_number().over(w))
              .where(F.col("__pos") != position).drop("__pos"))


def log_columns(df: DataFrame, columns, prefix: str = "log_") -> DataFrame:
    """``ln`` of several columns (null for <= 0)."""
    return df.withColumns({f"{prefix}{c}": numeric.safe_ln(c) for c in columns})


def clamp_columns(df: DataFrame, columns, lo=None, hi=None) -> DataFrame:
    """Clamp several columns; nulls stay null."""
    out = {}
    for c in columns:
        e = F.col(c)
        if lo is not None:
            e = F.when(e < lo, F.lit(lo)).otherwise(e)
        if hi is not None:
            e = F.when(e > hi, F.lit(hi)).otherwise(e)
        out[c] = e
    return df.withColumns(out)


# ASFR lower and upper bounds for age groups 8..14 (15-19 ... 45-49),
# as used by the fertility model preparation (code values, not the comment's).
ASFR_AGE_GROUPS = [8, 9, 10, 11, 12, 13, 14]
ASFR_LOWER = [0.0005, 0.01, 0.01, 0.02, 0.007, 0.0005, 0.00001]
ASFR_UPPER = [0.22, 0.35, 0.4, 0.35, 0.3, 0.18, 0.10]


def asfr_bounds(spark):
    """The 7-row bounds table (fixed size, safe to broadcast)."""
    rows = list(zip(ASFR_AGE_GROUPS, ASFR_LOWER, ASFR_UPPER))
    return spark.createDataFrame(rows, "age_group_id int, lb double, ub double")


def scale_logit(df: DataFrame, value: str = "asfr", group: str = "age_group_id",
                bounds: DataFrame | None = None, lo: float = 0.001,
                hi: float = 0.999) -> DataFrame:
    """``(x - lb[g]) / (ub[g] - lb[g])``, clamp to [lo, hi], logit.

    Groups outside the bounds table get null.  The default bounds table has a
    fixed 7 rows, so it is broadcast (no shuffle of ``df``); a caller's table is
    left to AQE.
    """
    if bounds is None:
        bounds = F.broadcast(asfr_bounds(df.sparkSession))
    b = bounds.withColumnRenamed(bounds.columns[0], group)
    out = df.join(b, group, "left")
    scaled = F.try_divide(F.col(value) - F.col("lb"), F.col("ub") - F.col("lb"))
    out = out.withColumn("scaled_" + value, pafx.clip(scaled, lo, hi))
    out = out.withColumn("logit_" + value, numeric.logit("scaled_" + value))
    return out.drop("lb", "ub")


def add_decade(df: DataFrame, year: str = "year_id", out: str = "decade",
               lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Decade bucket; outside [lo, hi] -> null (as the R factor levels)."""
    d = numeric.decade(year)
    if lo is not None:
        d = F.when((d >= lo) & (d <= hi), d)
    return df.withColumn(out, d)


def knot_bounds(df: DataFrame, column: str) -> DataFrame:
    """One-row table of min and max of ``column`` (saved for reuse)."""
    return df.agg(F.min(column).alias(f"min_{column}"),
                  F.max(column).alias(f"max_{column}"))


def spline_basis(df: DataFrame, column: str, inner_knots, names,
                 bounds: DataFrame | None = None) -> DataFrame:
    """Piecewise-linear basis at knots (min, k1, ..., max).

    Piece i is 0 below knot i, ``x - k_i`` inside, ``k_{i+1} - k_i`` above;
    null x gives 0.  ``bounds`` (from :func:`knot_bounds`, one row) lets
    forecast rows reuse the training knots; its two numbers are read once on
    the driver (a one-row aggregate) and enter the plan as literals.
    """
    if bounds is None:
        bounds = knot_bounds(df, column)
    # one row of two numbers: read it once and use literals (no join)
    row = bounds.first()
    lo, hi = row[f"min_{column}"], row[f"max_{column}"]
    out = df
    knots = [F.lit(lo)] + [F.lit(float(k)) for k in inner_knots] + [F.lit(hi)]
    x = F.col(column)
    cols = {}
    for i, name in enumerate(names):
        k0, k1 = knots[i], knots[i + 1]
        piece = (F.when((x >= k0) & (x < k1), x - k0)
                  .when(x >= k1, k1 - k0))
        cols[name] = F.coalesce(piece, F.lit(0.0))
    return out.withColumns(cols)


def rescale(df: DataFrame, column: str, factor: float, out: str | None = None,
            **constants) -> DataFrame:
    """Unit conversion by a factor, plus constant key columns."""
    df = df.withColumn(out or column, F.col(column) * F.lit(factor))
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def signif_columns(df: DataFrame, columns, digits: int = 5) -> DataFrame:
    """Significant-digit rounding of several columns."""
    return df.withColumns({c: numeric.signif(c, digits) for c in columns})


def outbox(df: DataFrame, template: str, mapping: dict, name_col: str,
           domain: str, time_col: str, run_date: Column | None = None) -> DataFrame:
    """One message row per recipient.

    ``body`` fills the template, ``recipient`` is ``name@domain`` and
    ``send_at`` is the run date plus the 'HH:mm:ss' time-of-day column.
    """
    run_date = run_date if run_date is not None else F.current_date()
    send_at = F.try_to_timestamp(
        F.concat_ws(" ", F.date_format(run_date, "yyyy-MM-dd"), F.col(time_col)),
        F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.select(
        F.col(name_col).alias("name"),
        F.concat(F.col(name_col), F.lit("@" + domain)).alias("recipient"),
        text.render_template(template, mapping).alias("body"),
        send_at.alias("send_at"))


def axis_values(spec):
    """(start, stop, step) inclusive range or an explicit list."""
    if isinstance(spec, tuple):
        start, stop, step = spec
        n = int(round((stop - start) / step)) + 1
        return [round(start + i * step, 10) for i in range(n)]
    return list(spec)


def with_parameter_grid(df: DataFrame, **axes) -> DataFrame:
    """P20: run one job over a parameter grid instead of a shell loop.

    Each row is repeated once per grid point by exploding literal arrays
    (the grid is a handful of values by construction), so the parameter
    becomes a column that later filters and groupings use.
    """
    out = df
    for name, spec in axes.items():
        vals = axis_values(spec)
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return out
