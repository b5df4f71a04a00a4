"""Score post-processing and batch model hooks (PRJ-19..23, UDF-01, UDF-02).

Probabilities, argmax, margins, integrity checks and review flags are array
built-ins. The model itself is outside Spark's optimizer: ``score_batches``
and ``label_batches`` run a pluggable function over Arrow batches (bounded by
``spark.sql.execution.arrow.maxRecordsPerBatch``): a model is built once per
Python worker, a labeller is called from several threads of a task.
"""

from __future__ import annotations

import hashlib
import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import columns as C

# Review flag texts.
FLAG_BORDERLINE = "Classifier returned BORDERLINE."
FLAG_LOW_CONFIDENCE = "Classifier confidence is below {:.2f}."
FLAG_CLOSE_MARGIN = "The two highest class probabilities are close."
REVIEW_BASE = "Research-only PIFU classification requires human clinical review."
REVIEW_MORE = " Additional review triggers: "
# Integrity tolerances.
SUM_TOLERANCE = 1e-3
CONFIDENCE_TOLERANCE = 1e-4
MAX_LABEL_ATTEMPTS = 6
MAX_CONCURRENT_LABELS = 8
BASE_WAIT_SECONDS, MAX_WAIT_SECONDS = 1.0, 60.0


# PRJ-19 -----------------------------------------------------------------------
def pack_example(prompt_ids, response_ids, max_len: int) -> F.Column:
    """Supervised example: prompt truncated to max_len - len(response), prompt masked with -100."""
    p, r = C.col_(prompt_ids), C.col_(response_ids)
    keep = F.greatest(F.lit(0), F.least(F.size(p), F.lit(max_len) - F.size(r)))
    head = F.slice(p, 1, keep)
    ids = F.concat(head, r)
    return F.struct(ids.alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(-100), keep), r).alias("labels"),
                    F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def whitespace_token_ids(text) -> F.Column:
    """Stand-in tokeniser: one id per whitespace word (its character length)."""
    words = F.filter(F.split(C.col_(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.length(w))


# PRJ-21 -----------------------------------------------------------------------
def decide(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Predicted class (first maximum), its probability, and the top-two margin."""
    return (df.withColumn("predicted_label", C.argmax(probs))
            .withColumn("predicted_class", C.label_name("predicted_label"))
            .withColumn("confidence", F.array_max(probs))
            .withColumn("top_two_margin", C.top_two_margin(probs)))


# PRJ-22 -----------------------------------------------------------------------
def check_predictions(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Rows breaking a prediction-integrity rule, with the names of the broken rules."""
    p = F.col(probs)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(p)
    cls = F.element_at(p, F.col("predicted_label") + 1)
    rules = F.array_compact(F.array(
        F.when(F.exists(p, lambda x: (x < 0) | (x > 1)), F.lit("probability_out_of_range")),
        F.when(F.abs(total - 1.0) > SUM_TOLERANCE, F.lit("probabilities_do_not_sum_to_one")),
        F.when(~C.label_name("predicted_label").eqNullSafe(F.col("predicted_class")), F.lit("label_class_mismatch")),
        F.when(F.abs(F.col("confidence") - cls) > CONFIDENCE_TOLERANCE, F.lit("confidence_not_class_probability")),
        F.when(cls < top - CONFIDENCE_TOLERANCE, F.lit("class_is_not_max"))))
    return df.withColumn("violations", rules).filter(F.size("violations") > 0)


def check_reports(df: DataFrame) -> DataFrame:
    """Reports breaking a report rule: marked for research only, and reviewed by a human when the safety check asks so."""
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = F.array_compact(F.array(
        F.when(known("requires_human_review") & ~known("human_review_required"), F.lit("human_review_not_required")),
        F.when(~known("research_use_only"), F.lit("not_research_only"))))
    return df.withColumn("violations", rules).filter(F.size("violations") > 0)


# PRJ-23 -----------------------------------------------------------------------
def review_flags(df: DataFrame, conf: float = C.CONFIDENCE_THRESHOLD, margin: float = C.MARGIN_THRESHOLD) -> DataFrame:
    flags = F.array_compact(F.array(
        F.when(F.col("predicted_label") == 1, F.lit(FLAG_BORDERLINE)),
        F.when(F.col("confidence") < conf, F.lit(FLAG_LOW_CONFIDENCE.format(conf))),
        F.when(F.col("top_two_margin") < margin, F.lit(FLAG_CLOSE_MARGIN))))
    reason = F.when(F.size(flags) > 0, F.concat(F.lit(REVIEW_BASE + REVIEW_MORE), F.array_join(flags, " "))) \
        .otherwise(F.lit(REVIEW_BASE))
    return (df.withColumn("safety_flags", flags).withColumn("safety_flag_count", F.size(flags))
            .withColumn("requires_human_review", F.lit(True)).withColumn("review_reason", reason))


# UDF-01 -----------------------------------------------------------------------
#: Models that a Python worker keeps; the one used longest ago goes first.
MODELS_KEPT = 2
_models: dict[str, Callable] = {}


def worker_model(name: str, model_fn: Callable[[], Callable]) -> Callable:
    """The model ``name`` of this Python worker, built by ``model_fn`` when the worker has none.

    Workers outlive tasks (``spark.python.worker.reuse``), so a stage of many
    tasks builds a model once per worker.
    """
    if name in _models:
        _models[name] = _models.pop(name)  # used last
        return _models[name]
    while len(_models) >= MODELS_KEPT:
        del _models[next(iter(_models))]
    _models[name] = model_fn()
    return _models[name]


def score_batches(df: DataFrame, model_fn: Callable[[], Callable[[pd.Series], list[list[float]]]],
                  text: str = "text", key: str = "sample_id", n_classes: int = 3, name: str | None = None,
                  profile: ResourceProfile | None = None) -> DataFrame:
    """Candidate scores from a batch model: ``model_fn()`` builds the scorer, once per Python worker; the scorer maps
    a pandas Series of texts to ``n_classes`` log scores each.

    ``name`` identifies the model in the worker's cache; by default it is a digest of ``model_fn`` with all it closes
    over, so another model never answers for this one. ``profile`` asks for the executors and task slots of the stage
    (memory or a GPU for the model). Another number of scores than ``n_classes`` is an error.
    """
    name = name or hashlib.sha256(cloudpickle.dumps(model_fn)).hexdigest()

    def run(batches):
        scorer = worker_model(name, model_fn)
        for pdf in batches:
            out = [list(map(float, s)) for s in scorer(pdf[text])]
            if len(out) != len(pdf) or any(len(s) != n_classes for s in out):
                raise ValueError(f"the model must give {n_classes} scores for each of {len(pdf)} texts")
            yield pd.DataFrame({key: pdf[key], "scores": out})

    return df.select(F.col(key).cast("string").alias(key), text).mapInPandas(
        run, f"{key} string, scores array<double>", profile=profile)


# UDF-02 -----------------------------------------------------------------------
class Pace:
    """Hands out start times, ``per_second`` of them each second, to the threads of one task."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = (1.0 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            start = max(time.monotonic(), self.next)
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))


def attempt_label(label_fn: Callable[[str], int | None], text: str | None, retries: int, base_wait: float,
                  pace: Pace) -> tuple:
    """(status, label, label_failed, error_type, unresolved_reason, attempts) of one text."""
    error = None
    for attempt in range(1, retries + 1):
        pace.wait()
        try:
            label = label_fn(text)
        except Exception as exc:  # noqa: BLE001 - any failure is retried
            error = type(exc).__name__
            if base_wait and attempt < retries:
                time.sleep(min(MAX_WAIT_SECONDS, base_wait * 2 ** (attempt - 1) + random.random()))
            continue
        if label is None:
            return "unresolved", None, False, None, "labeller_uncertain", attempt
        return "resolved", int(label), False, None, None, attempt
    return "unresolved", None, True, error, "api_failure", retries


_LABELLED = pa.schema([("status", pa.string()), ("label", pa.int32()), ("label_failed", pa.bool_()),
                       ("error_type", pa.string()), ("unresolved_reason", pa.string()), ("attempts", pa.int32())])


def label_batches(df: DataFrame, label_fn: Callable[[str], int | None], text: str = "text", key: str = "note_id",
                  retries: int = MAX_LABEL_ATTEMPTS, base_wait: float = BASE_WAIT_SECONDS,
                  concurrency: int = MAX_CONCURRENT_LABELS, per_second: float | None = None) -> DataFrame:
    """Label each row with bounded retries: after ``retries`` failures the row is
    unresolved / api_failure; a None answer is unresolved / labeller_uncertain.

    A task keeps up to ``concurrency`` calls under way, so the waits of failing
    rows overlap with the calls of others, and starts at most ``per_second``
    calls a second (retries included; None: no limit). Both hold per task: a
    service sees them times the running tasks. ``label_fn`` must allow calls
    from several threads; ``concurrency=1`` calls it from one at a time.

    Between attempts a row waits ``base_wait`` * 2^attempt seconds and up to one
    more, at most ``MAX_WAIT_SECONDS``; 0 turns waiting off (labellers without a service).

    Keys stay Arrow longs: a null key gives a row with a null key, and large ids are exact beside it. Results keep the
    order of the rows.
    """
    schema = (f"{key} long, status string, label int, label_failed boolean, error_type string, "
              "unresolved_reason string, attempts int")

    def run(batches):
        pace = Pace(per_second)
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = list(pool.map(lambda t: attempt_label(label_fn, t, retries, base_wait, pace),
                                     batch.column(1).to_pylist()))
                columns = list(zip(*rows)) or [()] * len(_LABELLED)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _LABELLED.types)]],
                    [key, *_LABELLED.names])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
