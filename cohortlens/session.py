"""Session construction and small plan-level helpers shared by every module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension frames (concept vocabularies, label grids, top-k lists) are
# broadcast only when the optimizer's size estimate is below this bound.
# Above it the join stays a shuffle join and AQE may still convert it at run
# time from measured sizes.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cohortlens") -> SparkSession:
    """Session with the settings the operators assume.

    On a cluster the master, memory and shuffle width come from spark-submit;
    locally (tests, bench) we size shuffles to the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only pick our own when it is
    unset, which happens in local tests.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan, or None when unavailable."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return size if isinstance(size, int) else int(size.toString())
    except Exception:  # Spark Connect or a plan without statistics
        return None


#: Bytes in memory for a byte of a compressed file, at most.
INFLATION = 8


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its size is proven below ``max_bytes``.

    The optimizer's estimate starts from the bytes of the files and is never
    below the truth but for two things: files are compressed, so it must stay
    below the bound by ``INFLATION``; and rows made by ``explode`` are not
    counted, so a plan that has them is never broadcast by its estimate.
    Otherwise the frame is returned unchanged and the planner falls back to a
    shuffle join (which AQE may turn around from measured sizes).
    """
    size = estimated_bytes(df)
    if size is not None and size * INFLATION <= max_bytes and not _explodes(df):
        return F.broadcast(df)
    return df


def _explodes(df: DataFrame) -> bool:
    return "Generate " in df._jdf.queryExecution().optimizedPlan().toString()
