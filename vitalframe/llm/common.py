"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows per Arrow batch for whole texts: a batch of ordinary documents stays at a few MB.
TEXT_BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(columns: Sequence[str], name: str) -> str:
    """``name``, or a longer one, that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0.  A null id is never learned from: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_fraction(fraction: float, seed: int, *cols: Column) -> Column:
    """A deterministic sample: rows whose 63-bit key hash lies in the lowest ``fraction``."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)
    return h <= F.lit(min(2**63 - 1, int(min(1.0, max(0.0, fraction)) * 2**63)))


def texts_of(column: pa.Array) -> list:
    """Arrow strings as UTF-8 bytes objects (None for null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def with_text_columns(df: DataFrame, text: str, fields: Sequence[T.StructField],
                      make: Callable[[], Callable[[list], list]],
                      keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``fields`` computed from whole texts, batch by batch, without a shuffle.

    ``make`` is called once per task and returns a function from a list of UTF-8
    texts (None for null) to one sequence per field.  ``keep`` names the input
    columns that stay (all when None).  An input column whose name clashes with a
    new field is dropped first, so the field wins.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    body = df.select(F.col(f"`{text}`").alias(fresh_name(names, "_vf_text")), *[F.col(f"`{c}`") for c in names])
    schema = T.StructType([f for f in body.schema.fields[1:]] + list(fields))
    tail = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = work(texts_of(b.column(0)))
            made = [pa.array(c, type=f.type) for c, f in zip(cols, tail, strict=True)]
            yield pa.RecordBatch.from_arrays(list(b.columns[1:]) + made,
                                             names=[*names, *(f.name for f in tail)])

    return body.mapInArrow(run, schema)
