"""Sinks K1-K8: Parquet/CSV writes, keyed datasets, incremental writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save(df: DataFrame, path: str, fmt: str = "parquet",
         mode: str = "overwrite") -> None:
    """K1: save to a path (Parquet by default)."""
    df.write.mode(mode).format(fmt).save(path)


def save_keyed(df: DataFrame, path: str, partition_cols, sort_cols=None,
               mode: str = "overwrite") -> None:
    """K2: keyed table, one folder per partition value, zstd Parquet.

    Rows are clustered by the partition columns (a rebalance, so a value that
    holds a large share of the rows is split over several tasks and files) and sorted inside each file
    by ``sort_cols`` so row-group min/max statistics make the demography
    keys searchable (what HDF ``data_columns`` gave the reference).
    Dynamic partition overwrite only replaces the partitions present.
    """
    partition_cols = list(partition_cols)
    out = df.hint("rebalance", *[F.col(c) for c in partition_cols])
    if sort_cols:
        out = out.sortWithinPartitions(*partition_cols, *sort_cols)
    (out.write.mode(mode).option("compression", "zstd")
        .partitionBy(*partition_cols).parquet(path))


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """What is stored under ``path``, read with the caller's schema (so keys like
    ``01`` and ``1`` stay apart), or None when nothing is there.  Any other error rises."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def missing_keys(spark: SparkSession, wanted: DataFrame, path: str,
                 keys) -> DataFrame:
    """K4: the wanted keys whose output is absent from ``path``.

    Compute-only-if-absent as an anti-join against what is already written
    (no driver-side listing of files).
    """
    have = stored(spark, path, wanted.select(*keys).schema)
    if have is None:
        return wanted
    return wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")


def write_incremental(df: DataFrame, path: str, partition_cols,
                      overwrite: bool = False) -> None:
    """K4/K5: ``overwrite=False`` appends only partitions not yet present;
    ``overwrite=True`` replaces exactly the partitions in ``df``."""
    spark = df.sparkSession
    partition_cols = list(partition_cols)
    if not overwrite:
        df = df.join(missing_keys(spark, df.select(*partition_cols).distinct(),
                                  path, partition_cols), partition_cols, "left_semi")
    # a partition's rows in few tasks, a large one's in several: not one file per task and partition
    (df.hint("rebalance", *[F.col(c) for c in partition_cols])
       .write.mode("overwrite" if overwrite else "append")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(path))


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """K6: rows kept after deleting those matching ``predicate``.

    Null-safe: a row whose predicate is null (e.g. null city) is kept.
    Write the result with dynamic partition overwrite to apply the delete.
    """
    return df.where(~F.coalesce(predicate, F.lit(False)))


def split_by_day(df: DataFrame, path: str, day_col: str = "day") -> None:
    """K7: one output folder per day of ``day_col``."""
    save_keyed(df, path, [day_col])


def to_driver(df: DataFrame, n: int):
    """K8: bring at most ``n`` rows to the driver, at the very end only."""
    return df.limit(n).toPandas()
