"""Session construction and the shared scratch location.

Writes that must outlive a task (round trips, stream checkpoints, saved
models) go under the folder the cluster names in ``spark.checkpoint.dir``.
Only when that is unset and Spark runs in local mode do we pick our own
folder, as tests do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "rentlens", extra: dict[str, str] | None = None) -> SparkSession:
    """A session with this library's settings; master, memory and partitions are the submitter's unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # HTML documents can be hundreds of KB: bound a Python worker's Arrow batch
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for k, v in {**settings, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set one only when none is configured."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = tempfile.mkdtemp(prefix="rentlens-ckpt-")
    sc.setCheckpointDir(base)
    return base


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/rentlens-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under this application's folder in the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything that this application wrote to scratch paths; results that read it end here."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
