"""STR-01: resumable labelling as a Structured Streaming job, each note once.

* *Keyed state.* The ids seen so far are streaming state (``dropDuplicates`` on
  the id, kept in RocksDB on the executors' disks and in the checkpoint), so a
  micro-batch meets its own ids only and never reads the stored results.
* *Epoch folders.* A micro-batch writes ``<out>/stream=<query id>/epoch=<n>`` as a
  whole. A batch that was killed is replayed with the same rows and overwrites
  its folder; one that was written but not yet recorded in the checkpoint has
  its ``_SUCCESS`` mark, and its notes are not sent to the labeller again.
* *Violations.* Rows that are no JSON, have no id or have no text are not
  labelled: they go to ``<out>_violations`` with their reason, in the same way.

A new checkpoint is a new stream with its own folders and state; it labels all
that is there, and the latest record per note wins on read.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.datasets import last_record
from cohortlens.operators.scoring import label_batches
from cohortlens.sources.catalog import path_exists

LETTER_SCHEMA = T.StructType([T.StructField("note_id", T.LongType()), T.StructField("person_id", T.LongType()),
                              T.StructField("text", T.StringType())])
BROKEN = "_broken_row"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def violations_path(out_dir: str) -> str:
    return out_dir.rstrip("/") + "_violations"


def violation_reason(letters: DataFrame) -> F.Column:
    """Why a row cannot be labelled; null when it can."""
    broken = F.when(F.col(BROKEN).isNotNull(), "broken_row") if BROKEN in letters.columns else F
    return broken.when(F.col("note_id").isNull(), "missing_id").when(F.col("text").isNull(), "missing_text")


def label_letters(letters: DataFrame, out_dir: str, checkpoint: str, label_fn: Callable[[str], int | None],
                  **labelling):
    """Start labelling a streaming frame of (note_id, text, ...); availableNow: all that is there, then stop.

    ``labelling`` goes to ``label_batches`` (retries, waits, concurrency, rate).
    """
    spark = letters.sparkSession
    marked = letters.withColumn("reason", violation_reason(letters))
    once = marked.filter("reason IS NULL").dropDuplicates(["note_id"])
    rows = once.unionByName(marked.filter("reason IS NOT NULL"))
    named, started = {}, threading.Event()

    def write(df: DataFrame, folder: str, epoch: int) -> None:
        path = f"{folder.rstrip('/')}/stream={named['id']}/epoch={epoch}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)

    def handle(batch: DataFrame, epoch: int) -> None:
        started.wait()  # the stream's id is known once it has started
        batch.persist()  # both writes see one run of the stateful plan
        try:
            todo = batch.filter("reason IS NULL")
            write(label_batches(todo, label_fn, "text", "note_id", **labelling), out_dir, epoch)
            bad = batch.filter("reason IS NOT NULL")
            if not bad.isEmpty():
                write(bad, violations_path(out_dir), epoch)
        finally:
            batch.unpersist()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # read when the stream starts, and kept in its checkpoint
    try:
        stream = (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PROVIDER, before)
    named["id"] = stream.id
    started.set()
    return stream


def label_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, label_fn,
                 schema: T.StructType = LETTER_SCHEMA, **labelling):
    """Label new letter files (JSON lines) arriving in ``in_dir``."""
    letters = (spark.readStream.schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]))
               .option("columnNameOfCorruptRecord", BROKEN).json(in_dir))
    return label_letters(letters, out_dir, checkpoint, label_fn, **labelling)


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """Labelling results, last record per note."""
    found = spark.read.parquet(out_dir).withColumn("_order", F.struct("epoch", "stream"))
    return last_record(found, "note_id", "_order").drop("_order")


def read_violations(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows that could not be labelled, with their reason."""
    return spark.read.parquet(violations_path(out_dir))
