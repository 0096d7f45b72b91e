"""Sort, limit, set and reshape operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, order_cols, k: int) -> DataFrame:
    """O1: sort + first k (planned as TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order_cols).limit(k)


def sort_nulls_last(df: DataFrame, *cols, descending=()) -> DataFrame:
    """O2: multi-key sort with pandas' NaN-last rule."""
    order = [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last()
             for c in cols]
    return df.orderBy(*order)


def distinct_sorted(df: DataFrame, *order_cols) -> DataFrame:
    """O3: distinct rows, then the sort (sorting first is lost by the
    de-duplication shuffle)."""
    out = df.dropDuplicates()
    return out.orderBy(*order_cols) if order_cols else out


def year_slice(df: DataFrame, version: str, y0: int, y1: int, y2: int,
               year: str = "year_id") -> DataFrame:
    """past = [y0, y1), forecast = [y1, y2]; any other name is an error."""
    if version == "past":
        return df.where((F.col(year) >= y0) & (F.col(year) < y1))
    if version == "forecast":
        return df.where((F.col(year) >= y1) & (F.col(year) <= y2))
    raise ValueError(f"version must be 'past' or 'forecast', got {version!r}")


def past_plus_forecast(past: DataFrame, forecast: DataFrame, y0: int, y1: int,
                       y2: int, year: str = "year_id") -> DataFrame:
    """Slice both, then concatenate by name (order by year at output)."""
    return year_slice(past, "past", y0, y1, y2, year).unionByName(
        year_slice(forecast, "forecast", y0, y1, y2, year))


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Row-bind with missing columns filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def clean_name(v) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", str(v)).strip("_").lower()


def long_to_wide(df: DataFrame, keys, pivot_col: str, value: str, values=None,
                 agg: str = "avg", prefix: str = "") -> DataFrame:
    """Long -> wide with the mean of duplicates; column names cleaned.

    Rows with a null pivot value are dropped first (pandas drops them).
    Give ``values`` when known: it saves the extra job that finds them.
    """
    src = df.where(F.col(pivot_col).isNotNull())
    g = src.groupBy(*keys).pivot(pivot_col, list(values) if values is not None else None)
    wide = g.agg(getattr(F, agg)(value))
    ren = {c: prefix + clean_name(c) for c in wide.columns if c not in keys}
    return wide.withColumnsRenamed(ren)


def wide_to_long(df: DataFrame, keys, prefix: str, var: str = "draw",
                 value: str = "value") -> DataFrame:
    """Wide draw columns ``prefix<N>`` -> (keys, draw N, value)."""
    pat = re.compile(re.escape(prefix) + r"(\d+)$")
    cols = [c for c in df.columns if pat.match(c)]
    long = df.unpivot(list(keys), cols, "__name", value)
    num = F.regexp_extract(F.col("__name"), re.escape(prefix) + r"(\d+)$", 1)
    return long.withColumn(var, num.cast("int")).drop("__name").select(*keys, var, value)


def nested_to_long(df: DataFrame, keys, array_col: str, labels) -> DataFrame:
    """An N-level nested array -> one row per leaf with index labels.

    ``labels`` is a list of (name, offset) per level, e.g.
    ``[("age_group_id", 8), ("year_id", 1950), ("draw", 0)]``.
    """
    cur = df.select(*keys, F.col(array_col).alias("__a0"))
    for i, (name, off) in enumerate(labels):
        nxt = f"__a{i + 1}"
        cur = (cur.select("*", F.posexplode(f"__a{i}").alias("__p", nxt))
                  .withColumn(name, F.col("__p") + F.lit(off))
                  .drop("__p", f"__a{i}"))
    return cur.withColumnRenamed(f"__a{len(labels)}", "value")


MAX_DIMENSION = 100_000  # values of a factor of the dense index (all but the first are broadcast)


def complete_index(dims: dict, spark=None, version: str | None = None,
                   y1: int | None = None, year: str = "year_id") -> DataFrame:
    """Cross product of all key values (the dense index).

    ``dims`` maps a key name to a DataFrame of its values or to a list.
    Each factor must be a dimension of small cardinality (locations, 20 ages, 2
    sexes, years, 3 scenarios): a DataFrame's distinct values are counted up to
    ``MAX_DIMENSION`` and more are refused, so the cross join is a chain of
    broadcasts of checked size; ``version`` keeps past (< y1) or forecast
    (>= y1) years.
    """
    parts = []
    for name, vals in dims.items():
        if isinstance(vals, DataFrame):
            part = vals.select(name).distinct()
            if parts and part.limit(MAX_DIMENSION + 1).count() > MAX_DIMENSION:
                raise ValueError(f"{name} has over {MAX_DIMENSION} values: not a dimension")
            parts.append(part)
        else:
            vals = list(vals)
            small_int = all(isinstance(v, int) and -2 ** 31 <= v < 2 ** 31 for v in vals)
            ddl = f"{name} int" if small_int else None
            parts.append(spark.createDataFrame([(v,) for v in vals], ddl or [name]))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    if version == "past":
        out = out.where(F.col(year) < y1)
    elif version == "forecast":
        out = out.where(F.col(year) >= y1)
    return out


def scenario_table(df: DataFrame, keys, value: str = "value",
                   scenario: str = "scenario", scenarios=(-1, 0, 1)) -> DataFrame:
    """Mean over draws per keys, one column per scenario."""
    wide = (df.groupBy(*keys).pivot(scenario, list(scenarios)).agg(F.avg(value)))
    return wide.withColumnsRenamed(
        {str(s): f"{value}_s{'m' if s < 0 else ''}{abs(s)}" for s in scenarios})
