"""Session construction and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove checkpoint files once their RDD is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keep a finished task's output when a later task of the same job fails (ledger appends).
    "spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "2",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "acct_health", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, else the one already set on the
    context (None if neither)."""
    value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not value:
        value = spark.conf.get("spark.checkpoint.dir", None)
    return value or spark.sparkContext.getCheckpointDir() or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder. Only a local-mode session without one (tests) gets a folder
    of its own; on a cluster a machine-local folder would be invisible to the executors, so the
    shared folder must be configured."""
    value = checkpoint_dir(spark)
    if value:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(value)
        return value
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    value = tempfile.mkdtemp(prefix="acct-health-ckpt-")
    spark.conf.set("spark.checkpoint.dir", value)
    spark.sparkContext.setCheckpointDir(value)
    return value


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table a job writes itself, in a folder of this application under the shared
    checkpoint folder. The folder goes when the application ends."""
    sc = spark.sparkContext
    if getattr(sc, "_acct_health_scratch", None) is None:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/acct_health/{uuid.uuid4().hex}"
        where = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        sc._acct_health_scratch = folder
    return f"{sc._acct_health_scratch}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on Python workers, once per SparkContext.

    Stages that run Python (the delivery ``mapInPandas``) pickle functions by module reference, so
    the workers must import ``acct_health`` even when the driver found it through a path the
    workers do not share. The package is zipped into the shared checkpoint folder (through the
    Hadoop FileSystem API, so any cluster file system works) and added with ``addPyFile``, the same
    mechanism as ``--py-files``.
    """
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_acct_health_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = scratch_path(spark, "pyfiles") + "/acct_health.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(buf.getvalue())
    finally:
        out.close()
    sc.addPyFile(str(fs.makeQualified(path).toString()))
    sc._acct_health_shipped = True
