"""Table catalog: load a folder of Parquet files as named tables (SRC-01..03)."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# CDM tables that must be present before any cohort work.
REQUIRED_CDM_TABLES = [
    "person", "condition_occurrence", "drug_exposure", "visit_occurrence",
    "measurement", "observation", "procedure_occurrence", "concept", "vocabulary",
]


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet data at ``path``, or None when there is none; any file system that Spark reads."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _parquet_stems(spark: SparkSession, directory: str) -> list[str]:
    """Names of the tables below ``directory``: one row each, from file metadata only."""
    if "://" not in directory and not directory.startswith(("/", "file:")):
        directory = os.path.abspath(directory)
    inside = re.escape(directory.rstrip("/").split("://")[-1].removeprefix("file:")) + "/+([^/]+)"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(directory))
    names = files.select(F.regexp_extract("path", inside, 1).alias("name")).filter("name <> ''").distinct()
    return sorted({r["name"].removesuffix(".parquet") for r in names.collect()})


def load_tables(spark: SparkSession, directory: str, names: list[str] | None = None,
                register: bool = True) -> dict[str, DataFrame]:
    """SRC-01: every ``*.parquet`` below ``directory`` as a table named by its stem.

    Reading is lazy: only the footers are touched here; scans happen when a
    query runs and then read just the columns and row groups it needs.
    """
    stems = names if names is not None else _parquet_stems(spark, directory)
    tables: dict[str, DataFrame] = {}
    for stem in stems:
        base = f"{directory.rstrip('/')}/{stem}"
        df = read_if_there(spark, base + ".parquet")
        if df is None:
            df = spark.read.parquet(base)
        tables[stem] = df
        if register:
            df.createOrReplaceTempView(stem)
    return tables


def require_tables(available, required: list[str]) -> None:
    """SRC-02: fail naming every required table that is missing."""
    have = set(available.keys() if isinstance(available, dict) else available)
    missing = sorted(set(required) - have)
    if missing:
        raise ValueError("Missing required tables: " + ", ".join(missing))


def list_tables(spark: SparkSession) -> list[str]:
    """SRC-03: sorted names of the registered tables and views."""
    return sorted(t.name for t in spark.catalog.listTables())


def table(spark: SparkSession, name: str) -> DataFrame:
    """SRC-03: a registered table; unknown names raise with the available ones."""
    if not spark.catalog.tableExists(name):
        raise KeyError(f"Table '{name}' not found. Available: {', '.join(list_tables(spark))}")
    return spark.table(name)


def table_report(tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """SRC-02 / SRC-03 over data: (table_name, present, n_columns, n_rows) of every table and every required one."""
    out = None
    for name in sorted(set(tables) | set(required)):
        if name in tables:
            row = tables[name].agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit(True).alias("present"),
                F.lit(len(tables[name].columns)).alias("n_columns"), "n_rows")
        else:
            some = next(iter(tables.values()))
            row = some.sparkSession.range(1).select(
                F.lit(name).alias("table_name"), F.lit(False).alias("present"), F.lit(None).cast("int").alias("n_columns"),
                F.lit(None).cast("long").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out
