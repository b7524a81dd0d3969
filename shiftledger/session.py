"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings that the library assumes; a cluster sets its own sizes on top.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(
    name: str, cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", **more: str
) -> SparkSession:
    """A local session for tests and the benchmark, with ``more`` settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_base() -> str:
    """A temporary folder of this process, deleted at its end."""
    base = tempfile.mkdtemp(prefix="shiftledger-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return os.path.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")
