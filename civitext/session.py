"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_SCAN_PARTS = "spark.civitext.scan.partitions"


def local_session(cores: int | str = "*", app: str = "civitext", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine.

    On a cluster the caller brings the session; nothing in this package needs
    settings beyond Spark's defaults (adaptive execution on).
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CIVITEXT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config(_SCAN_PARTS, str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which goes
    with the process: on a cluster, executors would not see a folder of the
    driver's machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="civitext-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/civitext/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under this application's part of the scratch folder."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder; its frames can't be read any more.

    For the end of a job, when its results are stored elsewhere.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table and read it back; ``compression`` names another codec than the session's.

    Cuts lineage, survives the loss of executors and gives later scans column
    pruning, filter pushdown and true size statistics.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_parts(spark: SparkSession) -> int | None:
    """Parts that small tables are cut into after their scan, if the session names a number.

    A cluster-sized table has parts enough and no such setting; a session on one
    machine sets it, so that one small file does not keep the other cores idle.
    """
    named = spark.conf.get(_SCAN_PARTS, None)
    return int(named) if named else None


def cut(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """``df`` in so many parts by ``key``, or as it is."""
    return df.repartition(parts, key) if parts else df
