"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows are often exploded after a small shuffle; keep enough tasks for that on small data.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture more than doubles the driver time spent building wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Archives are few and large, so one file per split is the useful grain there;
    # Parquet scans keep the 128 MB default.
    "spark.sql.files.maxPartitionBytes": "128m",
}


# On a cluster shuffles start with thousands of partitions: adaptive execution joins small ones, but cannot split
# the partitions of an aggregate later.
CLUSTER = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}


def _is_local(master: str) -> bool:
    """One process for driver and executors, so that they share a disk."""
    return master == "local" or master.startswith("local[")


def build_session(app: str = "finfacts", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cluster = {} if master and _is_local(master) else CLUSTER
    for key, value in {**DEFAULTS, **cluster, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory path for intermediate tables, readable by every executor.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors share one disk, may fall back to /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="finfacts-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
