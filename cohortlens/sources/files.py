"""File sources (SRC-04..10): strict JSON readers, split payloads, input discovery,
metric files, evaluation-log metrics and checksum manifests.

Readers stay lazy; validation runs one aggregate (or a ``limit(1)``
existence probe) and only the offending file is ever re-read to report a
line number.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import logs as LOGS
from cohortlens.sources.json_elements import read_elements

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])


# SRC-04 -----------------------------------------------------------------------
def json_lines(lines: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """The frame's other columns, the record's fields and ``broken`` for every non-blank line of JSON text."""
    strict = F.from_json(F.col(text), _with_corrupt(schema),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_r")
    others = [c for c in lines.columns if c != text]
    return (lines.filter(F.trim(F.col(text)) != "").select(*others, strict)
            .select(*others, *[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields],
                    (F.col("_r").isNull() | F.col("_r").getField(CORRUPT).isNotNull()).alias("broken")))


def line_number(spark: SparkSession, file_path: str, line: str) -> int:
    """1-based number of the first line equal to ``line``, from line counts per block; no file is read as one row."""
    lines = (spark.read.text(file_path).withColumn("_b", F.col("_metadata.file_block_start"))
             .withColumn("_i", F.monotonically_increasing_id()))
    first = lines.filter(F.col("value") == line).agg(F.min(F.struct("_b", "_i")).alias("f")).first()["f"]
    if first is None:
        return 1
    before = (F.col("_b") < first["_b"]) | ((F.col("_b") == first["_b"]) & (F.col("_i") <= first["_i"]))
    return lines.filter(before).count()


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSONL: blank lines skipped, a bad line fails with file and line number,
    an input without records fails."""
    df = (spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path)
          .withColumn("_file", F.col("_metadata.file_path")))
    bad = df.filter(F.col(CORRUPT).isNotNull()).select("_file", CORRUPT, *[f.name for f in schema.fields]).limit(1).collect()
    if bad:
        file_path, record = bad[0]["_file"], bad[0][CORRUPT]
        raise ValueError(f"{file_path}:{line_number(spark, file_path, record)}: invalid JSON line")
    if not df.limit(1).collect():
        raise ValueError(f"{path}: no records")
    return df.drop(CORRUPT, "_file")


# SRC-05 -----------------------------------------------------------------------
def _records(elements: DataFrame, schema: T.StructType) -> DataFrame:
    """(file, the fields of ``schema``) of JSON texts; a text that does not fit is an error that names its file."""
    strict = F.from_json("text", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = elements.select("file", strict.alias("_r"))
    bad = rows.filter(F.col("_r").isNull() | F.col("_r").getField(CORRUPT).isNotNull()).select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: broken JSON")
    return rows.select("file", *[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields])


def read_json_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files that hold a non-empty list of records each, a large one read by many tasks.

    Other JSON, broken files and empty lists are errors that name the file.
    """
    elements, files = read_elements(spark, path)
    records = _records(elements, schema)
    full = {r["file"] for r in records.select("file").distinct().collect()}  # one row per file
    empty = sorted(set(files) - full)
    if empty or not files:
        raise ValueError(f"{empty[0] if empty else path}: an empty list")
    return records.drop("file")


# SRC-06 -----------------------------------------------------------------------
SAMPLE_SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("text", T.StringType()),
                              T.StructField("label", T.IntegerType()), T.StructField("label_name", T.StringType()),
                              T.StructField("source", T.StringType())])


def split_violations(samples: DataFrame, labels: list[int]) -> DataFrame:
    """Samples without text / label or with a label outside the allowed set."""
    reason = (F.when(F.col("text").isNull(), "missing_text").when(F.col("label").isNull(), "missing_label")
              .when(~F.col("label").isin(*labels), "label_not_allowed"))
    return samples.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def read_split(spark: SparkSession, path: str, labels: list[int]) -> DataFrame:
    """Samples of split payloads (an object with ``task``, ``split`` and the list ``samples``), with their split.

    A large payload is read by many tasks. Fewer than two classes, or a sample
    without text or an allowed label, is an error.
    """
    elements, files = read_elements(spark, path, "samples")
    splits = spark.createDataFrame([(f, x.get("split")) for f, x in files.items()], "file string, split string")
    samples = _records(elements, SAMPLE_SCHEMA).join(F.broadcast(splits), "file").select(  # one row per file
        "split", *SAMPLE_SCHEMA.fieldNames())
    stats = samples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    bad = split_violations(samples, labels).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: sample {bad[0]['sample_id']} {bad[0]['violation']}")
    if stats["n"] == 0 or stats["k"] < 2:
        raise ValueError(f"{path}: at least two classes are required")
    return samples


# SRC-07 -----------------------------------------------------------------------
def input_matches(files: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """(name, n, path): how many of the paths end in each required file name, and the first; ``n`` should be 1."""
    named = files.select(F.col(path).alias("path"), F.element_at(F.split(F.col(path), "/"), -1).alias("name"))
    found = named.filter(F.col("name").isin(*names)).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    wanted = files.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return wanted.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "path")


def require_inputs(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """Exactly one file of each required name below ``directory`` (metadata only, content not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path")
    found = input_matches(files, names)
    problems = sorted(r["name"] for r in found.filter("n <> 1").collect())  # at most len(names) rows
    if problems:
        raise ValueError("Required inputs missing or ambiguous: " + ", ".join(problems))
    return found


# SRC-08 -----------------------------------------------------------------------
# What a path says about its metrics, and what holds where it says nothing.
METRIC_TAGS = {"dataset": {"pifu": "pifu"}, "model": {"base": "base"},
               "split": {"challenge": "challenge", "external": "external_test"}}
METRIC_DEFAULTS = {"dataset": "original", "model": "fine_tuned", "split": "test"}


def flat_metrics(texts: DataFrame, text: str = "value") -> DataFrame:
    """Numeric entries of JSON objects as rows (the frame's other columns, metric, value).

    An object may hold the metrics itself or under ``metrics``. Text that is no
    JSON object gives no rows.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    top = as_map(F.col(text))
    inner = F.coalesce(as_map(F.try_element_at(top, F.lit("metrics"))), top)
    others = [c for c in texts.columns if c != text]
    return (texts.select(*others, F.explode(inner).alias("metric", "_v"))
            .select(*others, "metric", F.col("_v").try_cast("double").alias("value")).filter("value IS NOT NULL"))


def collect_metric_files(spark: SparkSession, pattern: str, tags: dict[str, dict[str, str]] | None = None,
                         defaults: dict[str, str] | None = None) -> DataFrame:
    """Metric JSON files -> long (dataset, model, split, source, metric, value).

    ``tags`` maps a tag column to {path fragment: value}; the first fragment in
    the lower-cased path (for model and split: the file name) wins, else the default.
    """
    texts = spark.read.text(pattern, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    tagged = tag_paths(texts, "source", tags, defaults)
    names = METRIC_TAGS if tags is None else tags
    return flat_metrics(tagged).select(*names, "source", "metric", "value")


def tag_paths(df: DataFrame, path: str, tags: dict[str, dict[str, str]] | None = None,
              defaults: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a column per tag, from fragments of its paths (see ``collect_metric_files``)."""
    by_name = ("model", "split") if tags is None else ()  # the standard tags read these from the file name
    tags = METRIC_TAGS if tags is None else tags
    defaults = METRIC_DEFAULTS if defaults is None else defaults
    low = F.lower(F.col(path))
    for col, mapping in tags.items():
        where = F.element_at(F.split(low, "/"), -1) if col in by_name else low
        expr = F.lit(defaults.get(col))
        for frag, value in reversed(mapping.items()):
            expr = F.when(where.contains(frag.lower()), value).otherwise(expr)
        df = df.withColumn(col, expr)
    return df


# SRC-09 -----------------------------------------------------------------------
def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines of log files, in parts; a log is never one value."""
    return LOGS.read_logs(spark, path)


def extract_log_metrics(logs: DataFrame, text: str = "value") -> DataFrame:
    """(source, section, metric, value) of the ``key : number`` lines per section, names in lower snake case.

    ``logs`` has lines (``read_logs``), or whole logs in the column ``text``.
    """
    lines = logs if "part" in logs.columns else LOGS.log_lines(logs, text)
    return LOGS.log_metrics(lines).select("source", "section", "metric", "value")


def collect_log_metrics(logs: DataFrame, text: str = "value") -> DataFrame:
    """(dataset, model, split, source, metric, value) of the models' sections, like ``collect_metric_files``."""
    return LOGS.log_bundles(logs if "part" in logs.columns else LOGS.log_lines(logs, text))


# SRC-10 -----------------------------------------------------------------------
def checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """Other columns with the SHA-256 and the byte length of ``content`` (binary or text)."""
    raw = F.col(content).cast("binary")
    return files.select(F.sha2(raw, 256).alias("sha256"), *[c for c in files.columns if c not in (content, "length")],
                        F.octet_length(raw).cast("long").alias("length"))


#: Files of more bytes are hashed from pieces.
LARGE_FILE = 256 * 1024 * 1024


def streamed_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, length) of large files, each fed to its digest in pieces.

    The pieces are the file's lines, read by many tasks and brought into order
    by an external sort; the task that hashes a file holds one batch of them.
    (Only bytes between two line feeds must fit a value.)
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/").alias("path"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("data"))
    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "row")
    mark = b"\xef\xbb\xbf"  # the text reader leaves out a byte order mark, which the size of the file tells

    def run(batches):
        path, size, fed, plain, marked = None, 0, 0, None, None

        def out():
            left = size - fed  # a last line feed, a mark, or both
            if left in (1, 4):
                plain.update(b"\n")
                marked.update(b"\n")
            if left not in (0, 1, 3, 4):
                raise ValueError(f"{path}: {fed} bytes read of {size}")
            digest = marked if left > 1 else plain
            return pa.RecordBatch.from_pydict({"sha256": [digest.hexdigest()], "path": [path], "length": [size]})

        for b in batches:
            for p, s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4)):
                if p != path:
                    if plain:
                        yield out()
                    path, size, fed, plain, marked = p, s, 0, hashlib.sha256(), hashlib.sha256(mark)
                else:
                    plain.update(b"\n")
                    marked.update(b"\n")
                    fed += 1
                raw = data.as_buffer()
                plain.update(raw)
                marked.update(raw)
                fed += raw.size
        if plain:
            yield out()

    return ordered.mapInArrow(run, "sha256 string, path string, length long")


def checksum_manifest(spark: SparkSession, directory: str, large: int = LARGE_FILE) -> DataFrame:
    """SHA-256 and length of every file below ``directory``; files of more than ``large`` bytes are hashed in pieces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    big = [r[0] for r in files.filter(F.col("length") > large).select("path").collect()]  # names from metadata
    small = checksums(files.filter(F.col("length") <= large).select("path", "content"))
    if not big:
        return small
    return small.unionByName(streamed_checksums(spark, big))
