"""SparkSession construction and session-level helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session gets: ANSI on (Spark 4 default, stated explicitly so
# operators use try_divide / try_cast), UTC so timestamps compare across
# engines, AQE for runtime coalescing and skew-join splitting.
_BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: float, executors: int, cores_per_executor: int,
                 executor_memory_gb: float = 16.0, target_partition_mb: int = 256) -> dict:
    """Spark settings sized from the input volume (e.g. 100 TB on 1000
    executors).

    * file splits of ``target_partition_mb`` (each scan task reads that much);
    * an initial shuffle width of ~input / target so the largest stage's
      partitions fit executor memory per core, AQE coalescing small ones at
      run time and splitting skewed ones (a key holding a third of the rows
      is cut into advisory-size pieces on the large side of a join);
    * broadcast only below a size AQE measures (no size guessed up front).
    """
    cores = max(1, executors * cores_per_executor)
    target = target_partition_mb * 1024 * 1024
    per_core_mem = executor_memory_gb * 1024 ** 3 / max(1, cores_per_executor)
    # keep a shuffle partition well under the memory of one core (spill-aware)
    part_bytes = min(target, per_core_mem / 4)
    shuffle_parts = int(max(cores * 3, input_bytes / part_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(int(target)),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(part_bytes)),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(int(part_bytes)),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.speculation": "true",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }


def _default_heap() -> str:
    """Local-mode heap: 60% of physical memory, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gb = max(1, min(16, int(total * 0.6 / 1024 ** 3)))
    return f"{gb}g"


def build_session(master: str | None = None, app: str = "vitalframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, input_bytes: float | None = None,
                  executors: int | None = None, cores_per_executor: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    Master, driver memory and shuffle width are set only when asked for, so what
    ``spark-submit`` or the deployment gives stays in force.  With ``input_bytes``,
    ``executors`` and ``cores_per_executor`` the sizes come from ``cluster_conf``.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(_BASE_CONF)
    if input_bytes and executors and cores_per_executor:
        conf.update(cluster_conf(input_bytes, executors, cores_per_executor))
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local["):
            conf["spark.driver.memory"] = os.environ.get("VF_DRIVER_MEMORY", _default_heap())
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vitalframe`` importable in the Python workers (pandas UDFs,
    ``applyInPandas``): zip the package once per application and add it with
    ``addPyFile``, which distributes it to every executor (as ``--py-files``
    would on ``spark-submit``)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if "vitalframe" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)  # already given with --py-files
        return
    # The zip is a driver-side file; Spark's file server copies it to every
    # executor (nothing is read from a shared or executor-local folder).
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="vf-pyfiles-"), "vitalframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder set by the deployment.  Only a
    local-mode session that has none (tests) gets a folder below its warehouse.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is unset; set it to a shared folder")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/vitalframe-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder in the shared checkpoint folder; ``drop_tables`` removes them all."""
    import uuid
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/vitalframe-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str = "t", replaces=None):
    """Materialise ``df`` as a Parquet table under ``spark.checkpoint.dir``
    and return a DataFrame reading it.

    The table is computed once, survives executor loss (it is in the shared
    folder, never executor-local as ``localCheckpoint`` would be), is
    columnar and compressed, and later filters and projections push down
    into it.  Used at fan-out points: a table with several consumers.
    ``replaces`` is an earlier result of this function, of a round before, that nothing
    reads once this one is written: it is removed.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)  # known schema: no footer inference
    out._vf_path = path
    if getattr(replaces, "_vf_path", None):
        _remove(spark, replaces._vf_path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession) -> None:
    """Remove what ``cut_lineage`` and ``run_folder``'s users have written in this application, through
    Spark's own file system; call it when no result is read any more."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    _remove(spark, f"{root}/vitalframe-tables/{spark.sparkContext.applicationId}")
