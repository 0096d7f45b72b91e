"""Tables of whole files under a manifest: clustered writes, lookups, deletes by file (K2, K6).

A table is a folder with data files and a manifest: one small Parquet table per
version that names the version's files.  A change writes new files first and then a
new manifest; a version counts only when all the names it announces are there, so a
run that fails in between leaves the last version as it was.  Files are never changed.

Files are clustered by several keys at once: every key is cut at quantiles, the bits
of the cuts' numbers are interleaved, and rows are range-partitioned and sorted by
the result.  Neighbours in any of the keys lie in few files, whose min/max statistics
(and bloom filters, for equality inside a range) let a lookup by any key skip the others.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import stored

_MANIFEST = "file string, version long, n_files long"
_BITS = 6  # cuts of a key: 2 ** bits


def _order_number(df: DataFrame, key: str) -> Column:
    """A number that grows with the key: itself, its time, or the first seven bytes of its text."""
    kind, c = df.schema[key].dataType, F.col(key)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    head = F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("double")


def interleaved(df: DataFrame, keys, bits: int = _BITS) -> Column:
    """The interleaved cut numbers of the keys; a null key counts as the smallest."""
    keys = list(keys)
    if len(keys) * bits > 62:
        raise ValueError("too many keys to interleave")
    numbers = [_order_number(df, k) for k in keys]
    probs = F.array(*[F.lit(i / 2 ** bits) for i in range(1, 2 ** bits)])
    row = df.agg(*[F.percentile_approx(n, probs, 100 * 2 ** bits).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
    out = F.lit(0).cast("long")
    for i, n in enumerate(numbers):
        cuts = F.array(*[F.lit(float(v)) for v in row[i]]) if row[i] else F.array().cast("array<double>")
        place = _place(cuts, n)
        for j in range(bits):
            bit = F.shiftright(place, j).bitwiseAND(F.lit(1).cast("long"))
            out = out + F.shiftleft(bit, j * len(keys) + i)
    return out


def _place(cuts: Column, n: Column) -> Column:
    """How many of the cuts lie at or below the number; 0 for null."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= n)), F.lit(0)).cast("long")


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"


def _write_files(df: DataFrame, folder: str, bloom=()) -> list:
    w = df.write.option("compression", "zstd")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(folder)
    spark = df.sparkSession
    return [f for f in spark.read.schema(df.schema).parquet(folder).inputFiles()]


def _publish(spark: SparkSession, path: str, files: list, version: int) -> None:
    rows = [(f, version, len(files)) for f in files] or [(None, version, 0)]
    (spark.createDataFrame(rows, _MANIFEST).coalesce(1)
     .write.mode("append").parquet(f"{path.rstrip('/')}/manifest"))


def files_of(spark: SparkSession, path: str) -> tuple[list, int]:
    """The files of the newest whole version, and its number (none: [], 0)."""
    found = stored(spark, f"{path.rstrip('/')}/manifest", spark.createDataFrame([], _MANIFEST).schema)
    if found is None:
        return [], 0
    whole = (found.groupBy("version").agg(F.count("file").alias("n"), F.max("n_files").alias("m"))
             .where("n = m").agg(F.max("version")).first()[0])
    if whole is None:
        return [], 0
    return sorted(r["file"] for r in found.where((F.col("version") == whole) & F.col("file").isNotNull()).collect()), whole


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's newest version."""
    files, _ = files_of(spark, path)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def save_clustered(df: DataFrame, path: str, keys, files: int | None = None, bloom=None) -> list:
    """K2: write ``df`` as a new version in about ``files`` files (the session's shuffle width, if not given)
    clustered by all ``keys``; returns their names."""
    spark, keys = df.sparkSession, list(keys)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__z", interleaved(df, keys))
    rows = rows.repartitionByRange(files, "__z", *keys).sortWithinPartitions("__z", *keys).drop("__z")
    made = _write_files(rows, _data(path), keys if bloom is None else bloom)
    _publish(spark, path, made, files_of(spark, path)[1] + 1)
    return made


def lookup(spark: SparkSession, path: str, schema: T.StructType, **equal) -> DataFrame:
    """Rows whose keys equal the values (None: null); files are skipped by their statistics."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in equal.items()]
    return read(spark, path, schema).where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def delete(spark: SparkSession, path: str, schema: T.StructType, predicate: Column) -> dict:
    """K6: delete the rows that match (a null predicate keeps them), rewriting only files that hold one.

    Returns the numbers of files kept, rewritten and written, and of rows deleted.
    """
    files, version = files_of(spark, path)
    if not files:
        return {"kept": 0, "rewritten": 0, "written": 0, "deleted": 0}
    every = spark.read.schema(schema).parquet(*files)
    hit = (every.where(predicate).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
           .collect())  # at most one row per file
    if not hit:
        return {"kept": len(files), "rewritten": 0, "written": 0, "deleted": 0}
    names = {_plain(r["file"]) for r in hit}
    old = [f for f in files if _plain(f) in names]
    rest = spark.read.schema(schema).parquet(*old).where(~F.coalesce(predicate, F.lit(False)))
    made = _write_files(rest, _data(path))
    kept = [f for f in files if _plain(f) not in names]
    _publish(spark, path, kept + made, version + 1)
    return {"kept": len(kept), "rewritten": len(old), "written": len(made), "deleted": sum(r["n"] for r in hit)}


def _plain(name: str) -> str:
    """A file's name without the differences of spelling between two listings of it."""
    return name.replace("file:///", "/").replace("file:/", "/").replace("%20", " ")
