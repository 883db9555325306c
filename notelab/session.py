"""Spark session helpers.

On a cluster the session already exists and carries its own settings; ``get_session``
only fills in SQL settings that are unset.  Local defaults (loopback host, small shuffle count,
scratch checkpoint folder) are applied only when the master is local.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every run wants.  AQE re-plans joins from runtime sizes (broadcast only when the
# measured side is under the adaptive threshold), coalesces small shuffle partitions and
# splits skewed join partitions, also where that costs an extra shuffle.
_ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # text rows are CPU-heavy per byte: aim for smaller post-shuffle partitions than the 64MB default
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_LOCAL_CONF = {
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
    "spark.sql.files.maxPartitionBytes": "32MB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
}


#: Memory settings of Python workers (glibc's allocator, which Arrow then shares).
_WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def get_session(master: str | None = None, app_name: str = "notelab", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    An active session keeps every setting that it carries; only the SQL settings of
    ``_ENGINE_CONF`` that it does not set are filled in.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        given = {k for k, _ in active.sparkContext.getConf().getAll()}
        for key, value in _ENGINE_CONF.items():
            if key.startswith("spark.sql.") and key not in given and active.conf.isModifiable(key):
                active.conf.set(key, value)
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("NOTELAB_MASTER") or "local[8]"
    builder = builder.master(master)
    settings = dict(_ENGINE_CONF)
    if _one_machine(master):
        settings.update(_LOCAL_CONF)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local run without one gets a scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not _one_machine(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="notelab-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def reachable(spark: SparkSession) -> None:
    """Ready a session for this package's Python workers.

    They import the package where it is installed in the driver's place (--py-files is the other way), and rows reach
    them in batches of 2,000 unless the session says otherwise: a batch of Spark's default 10,000 whole texts takes a
    few hundred MB in the executor and its workers. A worker serves many tasks: arrays of 4 MB or more go back to the
    system when they are freed, and aren't kept for the worker's life beside the executor's heap.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(batch) is None:
        spark.conf.set(batch, "2000")
    env, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    for name, value in _WORKER_ENV.items():
        env.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all slots where the scan has fewer partitions than the session has slots.

    For row-local work that costs far more than a shuffle of its rows: a file of one row group is one partition, however
    many slots are free. A table of many row groups has partitions enough and is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


_STAGED: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write a table once as Parquet in the shared folder and read it back.

    For slim tables that are read more than once: the lineage is cut in storage that survives lost
    executors, later scans read only their columns, and the planner knows the size. ``drop_staged``
    removes the files when no result needs them any more.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables that this process has staged."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
