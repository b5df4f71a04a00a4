"""Run reporting (AGG-21..23, WIN-06, SRC-11, PRJ-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.dist import dist_rank, last_rows


# PRJ-28 -----------------------------------------------------------------------
def assign_cyclic(df: DataFrame, order: list[Column | str], items: list[str], out: str = "query") -> DataFrame:
    """Item ``rank % len(items)`` of the ordered rows (distributed rank, no single-task window)."""
    ranked = dist_rank(df, order, "_r")
    arr = F.array(*[F.lit(i) for i in items])
    return (ranked.withColumn("query_index", ((F.col("_r") - 1) % len(items)).cast("int"))
            .withColumn(out, F.element_at(arr, F.col("query_index") + 1)).drop("_r"))


# AGG-21 -----------------------------------------------------------------------
def response_lines(results: DataFrame) -> DataFrame:
    """Per-row line count (of the trimmed response; null when empty) and length of successful responses."""
    r = F.col("response")
    trimmed = F.regexp_replace(r, r"^\s+|\s+$", "")
    lines = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")))
    return results.select("*", F.when(r != "", lines).alias("response_lines"),
                          F.length(r).alias("response_chars"))


def run_responses(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    ok = F.col("status") == "success"
    length = F.when(ok, F.length("response"))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(length).alias("avg_response_chars"), F.min(length).alias("min_response_chars"),
        F.max(length).alias("max_response_chars"))


# AGG-22 -----------------------------------------------------------------------
def run_status(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """partial_success when a run has failures and successes, failed when only failures, else success.

    Flags: results are always research outputs and for clinicians to review; after a failure they may be incomplete.
    """
    s = F.col("status")
    agg = steps.groupBy(run).agg(F.count_if(s == "failed").alias("n_failed"),
                                 F.count_if(s == "succeeded").alias("n_succeeded"),
                                 F.count_if(s == "skipped").alias("n_skipped"))
    return agg.withColumn("run_status", F.when((F.col("n_failed") > 0) & (F.col("n_succeeded") > 0), "partial_success")
                          .when(F.col("n_failed") > 0, "failed").otherwise("success")).select(
        "*", F.lit(True).alias("research_output"), F.lit(True).alias("needs_clinician_review"),
        (F.col("n_failed") > 0).alias("may_be_incomplete"))


# AGG-23 -----------------------------------------------------------------------
def step_table(steps: DataFrame, run: str = "run_id") -> DataFrame:
    return (steps.filter(F.col("status") != "skipped")
            .select(run, "step", "status", "duration_seconds"))


def step_totals(steps: DataFrame, run: str = "run_id") -> DataFrame:
    return step_table(steps, run).groupBy(run).agg(F.count(F.lit(1)).alias("steps"),
                                                   F.sum("duration_seconds").alias("total_seconds"))


# WIN-06 / SRC-11 ----------------------------------------------------------------
def last_bundle(bundles: DataFrame, keys: list[str], order: str = "source") -> DataFrame:
    """The last bundle (by ``order``) per key; copies of one source count once, as only one row per key is kept."""
    return latest(bundles, keys, order)


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest row per key by timestamp; equal times: greatest row hash."""
    return last_rows(df, keys, ts)
