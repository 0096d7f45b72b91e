"""Join operators.

Join strategy is left to Catalyst/AQE (sort-merge or shuffled hash for large
sides, runtime broadcast when a side is measured small).  An explicit
``broadcast`` hint is only placed on tables whose size is bounded by
construction (dimension tables of fixed cardinality, band tables).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inner(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner equi-join on several keys."""
    return left.join(right, list(keys), "inner")


def complete(full_index: DataFrame, df: DataFrame, keys) -> DataFrame:
    """Left join onto the complete key set, so no key is missing."""
    return full_index.join(df, list(keys), "left")


def outer(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Full outer join on shared keys (key columns merged)."""
    return left.join(right, list(keys), "full_outer")


def shared_keys(keys, right: DataFrame):
    """The keys the right side actually has (intended semantics: every
    key is tested, none skipped)."""
    return [k for k in keys if k in right.columns]


def outer_on_available(left: DataFrame, right: DataFrame, keys, always=()) -> DataFrame:
    """J4 + J3: outer join on ``always`` plus those of ``keys`` the right
    side has.  An empty key list is refused (it would be a cross join)."""
    on = list(always) + shared_keys(keys, right)
    if not on:
        raise ValueError("no join keys in common")
    return outer(left, right, on)


def on_pairs(left: DataFrame, right: DataFrame, pairs, how: str = "inner") -> DataFrame:
    """Join on differently named keys ``[(left_col, right_col), ...]``;
    right key columns are dropped after the join."""
    cond = reduce(lambda a, b: a & b,
                  [left[lc] == right[rc] for lc, rc in pairs])
    out = left.join(right, cond, how)
    for _lc, rc in pairs:
        out = out.drop(right[rc])
    return out


def self_join(a: DataFrame, b: DataFrame, keys, suffixes=("_x", "_y"),
              null_safe: bool = False) -> DataFrame:
    """Join two subsets of one table; clashing non-key columns get
    suffixes.  ``null_safe`` matches null keys to null keys like pandas."""
    keys = list(keys)
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    a2 = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c)
                           for c in a.columns if c not in keys])
    b2 = b.select(*[F.col(k).alias("__r_" + k) for k in keys],
                  *[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c)
                    for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y,
                  [(a2[k].eqNullSafe(b2["__r_" + k]) if null_safe
                    else a2[k] == b2["__r_" + k]) for k in keys])
    return a2.join(b2, cond, "inner").drop(*["__r_" + k for k in keys])


def lookup(df: DataFrame, dim: DataFrame, keys, how: str = "left") -> DataFrame:
    """Lookup join against a dimension.

    The strategy is left to AQE, which broadcasts the dimension only after
    measuring it small.
    """
    return df.join(dim, list(keys), how)


def anti(df: DataFrame, pairs: DataFrame, keys) -> DataFrame:
    """Drop rows whose keys appear in ``pairs``."""
    return df.join(pairs, list(keys), "left_anti")


def semi(df: DataFrame, allowed: DataFrame, keys) -> DataFrame:
    """Keep rows whose keys appear in ``allowed`` (no duplicates added)."""
    return df.join(allowed, list(keys), "left_semi")


def geocode(df: DataFrame, gazetteer: DataFrame, address: str = "address",
            lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Address -> (lat, lng); null when the address is unknown.

    A gazetteer with several entries for one address keeps the smallest
    (lat, lng) — a deterministic pick (``dropDuplicates`` keeps any row).
    """
    from .windows import dedupe_first
    g = dedupe_first(gazetteer.select(address, lat, lng), [address], [lat, lng])
    return df.join(g, address, "left")


# Under-one age bands and their week ranges (week 1; 2-4; 5-52).
WEEK_BANDS = [("enn", 2, 1, 1), ("lnn", 3, 2, 4), ("pnn", 4, 5, 52)]


def week_bands(spark) -> DataFrame:
    return spark.createDataFrame(
        WEEK_BANDS, "age string, age_group_id int, wk_from int, wk_to int")


def replicate_by_band(df: DataFrame, bands: DataFrame, band_col: str = "age",
                      out: str = "age_wks") -> DataFrame:
    """One row per week of the row's band (enn 1, lnn 3, pnn 48).

    Keyed on the band value, so any number of locations/years/draws is
    handled in one pass; AQE broadcasts the band table when it is small.
    """
    b = bands.select(band_col, "wk_from", "wk_to")
    return (df.join(b, band_col, "inner")
              .withColumn(out, F.explode(F.sequence("wk_from", "wk_to")))
              .drop("wk_from", "wk_to"))
