"""Sinks (SNK-01..04). Data is written by the executors; only one-row
manifests are assembled from small aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# SNK-01 -----------------------------------------------------------------------
@contextmanager
def committed_folder(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write into that becomes ``path`` when the block ends, and goes when it fails.

    Readers of ``path`` see what was there before until the rename, then all of
    the new data; a failed or killed job leaves at most a ``.staging-`` folder
    beside it that no reader looks at.
    """
    path = path.rstrip("/")
    run = uuid.uuid4().hex
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    final, staging, before = hadoop(path), hadoop(f"{path}.staging-{run}"), hadoop(f"{path}.before-{run}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield staging.toString()
        fs.mkdirs(final.getParent())
        replaced = fs.exists(final) and fs.rename(final, before)
        if not fs.rename(staging, final):
            if replaced:
                fs.rename(before, final)
            raise OSError(f"{path}: the written data could not be put in place")
        if replaced:
            fs.delete(before, True)
    finally:
        fs.delete(staging, True)


def write_splits(df: DataFrame, path: str, label_map: dict[str, str], task: str = "classification",
                 splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Samples partitioned by split (``samples``) and the ``manifest`` beside them, committed together.

    The frame is computed once: the manifest is what the writing job observed.
    A row whose split is not in ``splits`` or whose label is not in
    ``label_map`` would be missing from the manifest, so it is an error and
    nothing is written.
    """
    spark = df.sparkSession
    cells = [(s, label) for s in splits for label in label_map]
    label = F.col("label").cast("string")
    counts = [F.count_if((F.col("split") == s) & (label == x)).alias(f"c{i}") for i, (s, x) in enumerate(cells)]
    seen = Observation()
    with committed_folder(spark, path) as folder:
        (df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
         .write.partitionBy("split").parquet(f"{folder}/samples"))
        got = seen.get
        found = [(s, x, got[f"c{i}"]) for i, (s, x) in enumerate(cells) if got[f"c{i}"]]
        if sum(n for _, _, n in found) != got["rows"]:
            raise ValueError(f"{got['rows'] - sum(n for _, _, n in found)} rows have another split or label than "
                             f"{', '.join(splits)} and {', '.join(label_map)}")
        rows = spark.createDataFrame(found, "split string, label string, n long")  # one row per split and label
        _manifest(rows, label_map, task).coalesce(1).write.json(f"{folder}/manifest")
    return _manifest(rows, label_map, task)


def split_manifest(df: DataFrame, label_map: dict[str, str], task: str = "classification") -> DataFrame:
    """One row per split: samples, class counts and the label map."""
    counts = df.groupBy("split", F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _manifest(counts, label_map, task)


def _manifest(counts: DataFrame, label_map: dict[str, str], task: str) -> DataFrame:
    per_split = counts.groupBy("split").agg(F.sum("n").alias("n_samples"),
                                            F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("class_counts"))
    return per_split.select(
        F.lit(task).alias("task"), "split", "n_samples", "class_counts",
        F.create_map(*[x for k, v in label_map.items() for x in (F.lit(k), F.lit(v))]).alias("label_map"))


def write_json_lists(df: DataFrame, path: str, files: int = 1) -> None:
    """The rows as up to ``files`` JSON files, each one list of records, committed together.

    Rows are dealt by their content; a task writes the lists it gets row by row and holds none of them.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).withColumn(
        "file", F.pmod(F.xxhash64("value"), F.lit(files)).cast("int"))

    def run(batches):
        last = None  # the row that waits to know whether another follows
        for b in batches:
            out = []
            for text, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None or last[1] != file:
                    out += [(last[0] + "]", last[1])] if last else []
                    last = "[" + text, file
                else:
                    out.append((last[0] + ",", file))
                    last = text, file
            yield pa.RecordBatch.from_pydict({"value": [t for t, _ in out], "file": pa.array([f for _, f in out], pa.int32())})
        if last:
            yield pa.RecordBatch.from_pydict({"value": [last[0] + "]"], "file": pa.array([last[1]], pa.int32())})

    lists = rows.repartition("file").sortWithinPartitions("file").mapInArrow(run, "value string, file int")
    with committed_folder(df.sparkSession, path) as folder:
        lists.write.partitionBy("file").text(folder)


# SNK-02 -----------------------------------------------------------------------
def write_cases(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Case-level CSV with a fixed column list; arrays joined with ' | '."""
    case_rows(df, columns).write.mode(mode).option("header", True).csv(path)


def case_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a case file: the listed columns, arrays as text joined with ' | '."""
    types = dict(df.dtypes)
    return df.select(*[F.array_join(F.col(c), " | ").alias(c) if types[c].startswith("array") else F.col(c)
                       for c in columns])


# SNK-03 -----------------------------------------------------------------------
def confusion_grid(conf: DataFrame, by: list[str], names: list[str], true: str = "true_label",
                   pred: str = "predicted_label") -> DataFrame:
    """Labelled grid: one row per true label, one column per predicted label (fixed values)."""
    named = conf.withColumn("_p", F.element_at(F.array(*[F.lit(n) for n in names]), F.col(pred) + 1))
    grid = named.groupBy(*by, true).pivot("_p", names).agg(F.sum("n"))
    return grid.withColumn("true/predicted", F.element_at(F.array(*[F.lit(n) for n in names]), F.col(true) + 1)) \
        .select(*by, "true/predicted", *names)


def write_confusion(conf: DataFrame, path: str, by: list[str], names: list[str], mode: str = "overwrite") -> None:
    confusion_grid(conf, by, names).write.mode(mode).option("header", True).csv(path)


def read_confusion(spark: SparkSession, path: str, by: list[str], names: list[str]) -> DataFrame:
    """A written grid as (by..., true_label, predicted_label, n) cells.

    Tolerant: blanks around numbers and names, whole numbers written as decimals, further columns; a cell that is no
    number, or whose column is missing, is null. Rows of other labels are left out.
    """
    grid = spark.read.option("header", True).csv(path)
    place = lambda c: F.array_position(F.array(*[F.lit(n) for n in names]), F.trim(c)) - 1
    cells = F.array(*[F.struct(F.lit(i).alias("predicted_label"),
                               (F.trim(F.col(f"`{n}`")).try_cast("double") if n in grid.columns else F.lit(None))
                               .cast("long").alias("n")) for i, n in enumerate(names)])
    return (grid.select(*by, place(F.col("`true/predicted`")).cast("int").alias("true_label"), F.explode(cells).alias("_c"))
            .filter("true_label >= 0").select(*by, "true_label", "_c.predicted_label", "_c.n"))


# SNK-04 -----------------------------------------------------------------------
def nested_metrics(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Long (by, metric, value) -> one row per group with a metrics map."""
    return metrics.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


def write_metrics(metrics: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    nested_metrics(metrics, by).write.mode(mode).json(path)
