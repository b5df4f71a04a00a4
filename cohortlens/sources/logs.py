"""Evaluation logs read line by line (SRC-09).

A metric belongs to the last section heading above it, which may lie in another
part of a large file. Every part is walked once, in order, by the task that
reads it: metrics below a heading of the same part know their section at once,
those above it wait. Each part also tells what it leaves to the next one (a
section, none, or what it got). Carrying that on over the parts of a file, one
small row each, names the section of the waiting metrics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The models' headings, the dataset and split of these logs, and the names of the metrics of a bundle.
MODELS = {"BASE MODEL": "base", "FINE-TUNED MODEL": "fine_tuned"}
DATASET, SPLIT = "original", "test"
BUNDLE_METRICS = ["f1", "macro_f1", "accuracy", "balanced_accuracy", "precision", "recall", "roc_auc", "pr_auc"]

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(?=\s|$)")
#: What a part leaves when it ends outside any section.
NONE = ""


def heading(line: str) -> str | None:
    """The section that a line opens: capitals (with blanks and hyphens) before ``Results:`` at its end."""
    name, word, rest = line.rstrip().rpartition("Results:")
    if not word or rest or not name.endswith((" ", "\t")):
        return None
    name = name.strip()
    capitals = name and all(c == " " or c == "-" or "A" <= c <= "Z" for c in name) and name[0] not in " -"
    return name if capitals else None


def is_rule(line: str) -> bool:
    line = line.rstrip()
    return bool(line) and set(line) == {"="}


def metric(line: str) -> tuple[str, float] | None:
    """(name in lower snake case, value) of a ``key : number`` line; words may follow the number of a known metric."""
    key, colon, value = line.partition(":")
    name = re.sub(r"[\s\-]+", "_", key.strip().lower())
    if not colon or not name[:1].isalpha() or not name.isascii() or not name.replace("_", "").isalnum():
        return None
    m = _NUMBER.match(value.strip())
    if not m or (name not in BUNDLE_METRICS and m.end() != len(value.strip())):
        return None
    return name, float(m.group())


class Part:
    """One part of a log, line by line. ``section`` is None until the part itself tells one (``NONE``: outside any)."""

    def __init__(self) -> None:
        self.section: str | None = None
        self.rule = False  # the last line is a rule
        self.opens_with_end = False  # the first line may end a section, if the part before ended with a rule
        self.n = 0
        self.found: list[tuple[str | None, int, str, float]] = []

    def line(self, text: str) -> None:
        text = text.removesuffix("\r")
        self.n += 1
        name, ends = heading(text), text.startswith("COMPARISON")
        if name:
            self.section = name
        elif ends and self.rule:
            self.section = NONE
        elif ends and self.n == 1:
            self.opens_with_end = True
        elif (m := metric(text)) and self.section != NONE:
            self.found.append((self.section, self.n, *m))
        self.rule = is_rule(text)


_ROWS = pa.schema([("source", pa.string()), ("log", pa.int64()), ("part", pa.int64()), ("line", pa.int64()),
                   ("section", pa.string()), ("metric", pa.string()), ("value", pa.float64()), ("rule", pa.bool_()),
                   ("opens_with_end", pa.bool_())])
_ROWS_DDL = ("source string, log long, part long, line long, section string, metric string, value double, "
             "rule boolean, opens_with_end boolean")


def _walk(lines: DataFrame) -> DataFrame:
    """Metric rows, and one row without a metric for what each part leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, Part()

        def out(done: bool) -> pa.RecordBatch:
            rows = [(*name, n, section, m, v, None, None) for section, n, m, v in part.found]
            part.found.clear()
            if done:
                rows.append((*name, part.n, part.section, None, None, part.rule, part.opens_with_end))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_ROWS), _ROWS.types)], schema=_ROWS)

        for b in batches:
            for source, log, at, text in zip(*(c.to_pylist() for c in b.columns)):
                if (source, log, at) != name:
                    if name:
                        yield out(True)
                    name, part = (source, log, at), Part()
                part.line(text)
            if name:
                yield out(False)
        if name:
            yield out(True)

    return lines.select("source", "log", "part", "line").mapInArrow(run, _ROWS_DDL)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(source, log, part, line): the lines of log files in order, a large file in many parts."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.lit(0).cast("long").alias("log"),
        F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))


def log_lines(logs: DataFrame, text: str = "value") -> DataFrame:
    """The same from whole logs held as text, one per row (``source`` may be missing)."""
    source = F.col("source").cast("string") if "source" in logs.columns else F.lit(None).cast("string")
    numbered = logs.select(source.alias("source"), F.monotonically_increasing_id().alias("log"), text)
    return numbered.select("source", "log", F.lit(0).cast("long").alias("part"),
                           F.explode(F.split(text, "\n")).alias("line"))


def log_metrics(lines: DataFrame) -> DataFrame:
    """(source, section, metric, value) of every ``key : number`` line below a section heading.

    A section ends at the next heading, or at a line that begins with
    COMPARISON right below a rule of equals signs.
    """
    rows = _walk(lines)
    parts = rows.filter("metric IS NULL")
    before = Window.partitionBy("source", "log").orderBy("part")  # one row per part of one file
    cut = F.coalesce(F.lag("rule").over(before) & F.col("opens_with_end"), F.lit(False))
    carried = parts.select("source", "log", "part", "section", cut.alias("cut")).select(
        "source", "log", "part", "cut",
        F.last(F.coalesce("section", F.when(F.col("cut"), NONE)), ignorenulls=True).over(
            before.rowsBetween(Window.unboundedPreceding, -1)).alias("got"))
    carried = carried.select(F.col("source").alias("_s"), F.col("log").alias("_l"), F.col("part").alias("_p"),
                             F.when(F.col("cut"), NONE).otherwise(F.col("got")).alias("got"))
    found = rows.filter("metric IS NOT NULL")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("log") == F.col("_l")) & (F.col("part") == F.col("_p"))
    waiting = found.filter("section IS NULL").join(carried, same).withColumn("section", F.col("got")).filter(
        F.col("section") != NONE)
    names = ["source", "log", "part", "line", "section", "metric", "value"]
    return found.filter("section IS NOT NULL").select(names).unionByName(waiting.select(names))


def log_bundles(lines: DataFrame) -> DataFrame:
    """(dataset, model, split, source, metric, value): the first value of each known metric of the models' sections."""
    model = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])[F.col("section")]
    known = log_metrics(lines).withColumn("model", model).filter(
        F.col("model").isNotNull() & F.col("metric").isin(BUNDLE_METRICS))
    return known.groupBy("source", "log", "model", "metric").agg(
        F.min(F.struct("part", "line", "value")).alias("first")).select(
        F.lit(DATASET).alias("dataset"), "model", F.lit(SPLIT).alias("split"), "source", "metric",
        F.col("first.value").alias("value"))
