"""Session helpers: a local session for tests and benchmarks, and the shared
scratch folder for lineage cuts and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "quarry",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster the builder picks up the cluster's own master and defaults;
    only the knobs below are set explicitly.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2)))
    from pyspark import SparkConf
    if master or not SparkConf().contains("spark.master"):
        # local runs only: under spark-submit the cluster's master is kept
        b = b.master(master or f"local[{cpus}]")
        b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Where it is unset, a folder of our own is created
    in local mode only; on a cluster a machine-local folder would be seen by
    one machine, so that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a SparkContext (e.g. Spark Connect)
        sc = None
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local") or \
                spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        if sc:
            sc.setCheckpointDir(root)
    elif sc and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quarry/{name}-{uuid.uuid4().hex[:12]}"
