"""Day-batch processing on Structured Streaming (K5, K6, K7 as a stream).

The original split a log into one file per day and replaced a day's output
by deleting and rewriting it, from shell loops.  Here new input files are
picked up by a file-source stream; each micro-batch is transformed and
written by day.  The caller says what a further file of a day means, so the
trigger size never decides it:

* ``mode="add"``: every file's rows stay.  A batch writes a folder of its own
  below the day (``day=.../batch=<id>``), so a repeated batch rewrites only
  what it wrote itself.
* ``mode="replace"``: the newest file that holds a day (by modification time,
  then path) is that day's whole content, however files fall into batches.  The
  newest version of each day stands in a small table beside the output, written
  after the day's data, so a batch reads a row per day and never the store; a batch
  that is repeated after a failure finds its days not yet noted and writes them again.

Progress lives in a checkpoint under ``spark.checkpoint.dir`` (a shared folder
on a cluster).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks

BATCH = "batch"      # partition column that tells the batches of mode "add" apart
VERSION = "__file"   # (modification time, path) of the input file


def day_stream(spark: SparkSession, source_dir: str, schema, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a folder that receives day files, with each row's file version."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    version = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    return r.load(source_dir).select("*", version.alias(VERSION))


def versions_path(out_dir: str) -> str:
    """Where the newest versions of an output's days are noted: beside it, not among its days."""
    return out_dir.rstrip("/") + "_versions"


def day_versions(spark: SparkSession, out_dir: str, like: DataFrame, day_col: str) -> DataFrame | None:
    """Rows (day, version) noted for an output, or None.  An output without notes is read for them once."""
    schema = like.select(F.col(day_col).alias("day"), F.col(VERSION).alias("version")).schema
    noted = sinks.stored(spark, versions_path(out_dir), schema)
    if noted is not None:
        return noted
    old = sinks.stored(spark, out_dir, like.schema)
    if old is None:
        return None
    old.groupBy(F.col(day_col).alias("day")).agg(F.max(VERSION).alias("version")).write.parquet(versions_path(out_dir))
    return sinks.stored(spark, versions_path(out_dir), schema)


def write_days(stream: DataFrame, out_dir: str, day_col: str, name: str,
               transform: Callable[[DataFrame], DataFrame] | None = None,
               delete_predicate=None, once: bool = True, mode: str = "add"):
    """Start the query: per micro-batch apply ``transform`` (which keeps the
    file version) and the K6 null-safe delete, then write the batch's days."""
    if mode not in ("add", "replace"):
        raise ValueError(f"mode must be 'add' or 'replace', got {mode!r}")
    spark = stream.sparkSession
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)

    def batch(df: DataFrame, epoch: int) -> None:
        out = transform(df) if transform else df
        if delete_predicate is not None:
            out = sinks.delete_where(out, delete_predicate)
        if mode == "add":
            sinks.write_incremental(out.drop(VERSION).withColumn(BATCH, F.lit(epoch)), out_dir,
                                    [day_col, BATCH], overwrite=True)
            return
        # The newest file of each day in this batch, unless a stored one is newer.
        newest = df.groupBy(F.col(day_col).alias("__day")).agg(F.max(VERSION).alias("__newest"))
        have = day_versions(spark, out_dir, out, day_col)
        if have is not None:
            have = have.groupBy(F.col("day").alias("__had")).agg(F.max("version").alias("__have"))
            newest = (newest.join(have, F.col("__day").eqNullSafe(F.col("__had")), "left")
                      .where(F.col("__have").isNull() | (F.col("__newest") > F.col("__have")))
                      .select("__day", "__newest"))
        newest = cut_lineage(newest, "day-versions")  # the same days for the data and for the note
        kept = out.join(newest, out[day_col].eqNullSafe(F.col("__day")) &
                        (out[VERSION] == F.col("__newest"))).select(*out.columns)
        sinks.write_incremental(kept, out_dir, [day_col], overwrite=True)
        (newest.select(F.col("__day").alias("day"), F.col("__newest").alias("version")).coalesce(1)
         .write.mode("append").parquet(versions_path(out_dir)))

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
