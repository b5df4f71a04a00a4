"""Judge-case selection and judge summaries (WIN-04, WIN-05, PRJ-25, AGG-25, EVL-16, JON-11).

Selection picks a small budget of cases per group; every per-group top-k is
the salted two-stage ``top_k_per_group``, so the case table is never
collected in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.dist import top_k_per_group

DEFAULT_BUDGET = 24
# Judge pass rule.
PASS_MIN_SCORE = 4
SCORES = ["explanation_faithfulness", "evidence_grounding", "prediction_consistency", "safety_compliance"]


def _case_order():
    return [F.col("confidence"), F.col("top_two_margin"), F.col("split"), F.col("sample_id")]


def _priority(cases: DataFrame):
    """(whether a case has priority, its order, the reason) of wrong / flagged / borderline cases."""
    correct = F.col("true_label") == F.col("predicted_label")
    flagged = F.col("safety_flag_count") > 0
    reason = (F.when(~correct, "misclassified_priority").when(flagged, "safety_flag_priority")
              .otherwise("borderline_priority"))
    return (~correct | flagged | (F.col("predicted_label") == 1),
            [correct.asc(), F.col("safety_flag_count").desc()] + _case_order(), reason)


# WIN-04 -----------------------------------------------------------------------
def priority_cases(cases: DataFrame, by: list[str], budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Up to half the budget (at least 1) of wrong / flagged / borderline cases."""
    prior, order, reason = _priority(cases)
    top = top_k_per_group(cases.filter(prior), by, order, max(1, budget // 2), salt_by="sample_id", out="selection_order")
    return top.withColumn("selection_reason", reason)


# WIN-05 -----------------------------------------------------------------------
def select_cases(cases: DataFrame, by: list[str], budget: int = DEFAULT_BUDGET, salts: int = 64) -> DataFrame:
    """Priority cases, then round-robin over (split, predicted label) buckets by confidence.

    Round-robin = rank inside each bucket among the not-yet-selected cases,
    then order by (rank, bucket key): pass one takes the first case of every
    bucket, pass two the second, and so on.

    One pass: every case gets its place among the priority cases and in its
    bucket, within a slice of the group. Only cases that may be chosen go on (a
    bucket's best, with as many more as priority cases may be among them); the
    selection is made among those few.
    """
    half = max(1, budget // 2)
    prior, order, reason = _priority(cases)
    bucket = [*by, "split", "predicted_label"]
    place = lambda keys, o: F.row_number().over(Window.partitionBy(*keys).orderBy(*o))
    marked = cases.withColumn("_prior", F.coalesce(prior, F.lit(False))).withColumn(
        "_salt", F.pmod(F.xxhash64("sample_id"), F.lit(salts)))
    few = (marked.withColumn("_p", place([*by, "_salt", "_prior"], order))
           .withColumn("_b", place([*bucket, "_salt"], _case_order()))
           .filter((F.col("_prior") & (F.col("_p") <= half)) | (F.col("_b") <= budget + half)).drop("_p", "_b", "_salt"))
    chosen = few.withColumn("_place", place([*by, "_prior"], order)).withColumn(
        "_chosen", F.col("_prior") & (F.col("_place") <= half))
    ranked = chosen.withColumn("_n_chosen", F.count_if("_chosen").over(Window.partitionBy(*by))).withColumn(
        "_rank", place([*bucket, "_chosen"], _case_order()))
    filled = ranked.withColumn("_fill", place([*by, "_chosen"], [F.col("_rank"), F.col("split"), F.col("predicted_label")]))
    taken = filled.filter(F.col("_chosen") | (F.col("_fill") <= budget - F.col("_n_chosen")))
    return taken.withColumn(
        "selection_order", F.when(F.col("_chosen"), F.col("_place")).otherwise(F.col("_n_chosen") + F.col("_fill"))).withColumn(
        "selection_reason", F.when(F.col("_chosen"), reason).otherwise("split_class_representative")).select(
        *cases.columns, "selection_order", "selection_reason")


# Texts that stand for a missing explanation or judgement.
NO_EXPLANATION = "Automated narrative explanation was unavailable."
NO_JUDGE = "LLM-as-a-Judge evaluation was unavailable:"


def availability(df: DataFrame, summary: str = "clinical_summary", judged: str = "judge_summary") -> DataFrame:
    """Whether a real explanation and a real judgement are there; missing text counts as not there."""
    return df.select("*", F.coalesce(F.col(summary) != NO_EXPLANATION, F.lit(False)).alias("explanation_available"),
                     F.coalesce(~F.col(judged).startswith(NO_JUDGE), F.lit(False)).alias("judge_available"))


# PRJ-25 -----------------------------------------------------------------------
def check_judge(judge: DataFrame) -> DataFrame:
    """Pass <=> all four scores >= 4 and no hallucination (judge available)."""
    ok = F.lit(True)
    for s in SCORES:
        ok = ok & (F.col(s) >= PASS_MIN_SCORE)
    scores_valid = F.lit(True)
    for s in SCORES:
        scores_valid = scores_valid & F.col(s).between(1, 5)
    return (judge.withColumn("judge_pass", F.col("judge_available") & ok & ~F.col("judge_hallucination"))
            .withColumn("scores_valid", ~F.col("judge_available") | scores_valid))


# AGG-25 -----------------------------------------------------------------------
def judge_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    av = F.col("judge_available")
    explained = F.col("explanation_available")
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(explained).alias("explanations"),
        F.avg(explained.cast("double")).alias("explanation_coverage"),
        F.count_if(av).alias("judged"),
        F.count_if(~av).alias("unavailable"),
        F.avg(av.cast("double")).alias("coverage"),
        F.avg(F.when(av, F.col("judge_pass").cast("double"))).alias("pass_rate"),
        F.avg(F.when(av, F.col("judge_hallucination").cast("double"))).alias("hallucination_rate"),
        F.avg(F.when(av, (F.col("unsupported_claim_count") > 0).cast("double"))).alias("unsupported_rate"),
        *[F.avg(F.when(av, F.col(s).cast("double"))).alias(f"mean_{s}") for s in SCORES])


# EVL-16 -----------------------------------------------------------------------
def flagged_cases(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("judge_available") & ~F.col("judge_pass"))


# JON-11 -----------------------------------------------------------------------
def assemble_cases(pred: DataFrame, explanation: DataFrame, judge: DataFrame, key: list[str]) -> DataFrame:
    """Case record: prediction + safety, explanation and judge joined on the case key."""
    return pred.join(explanation, key, "left").join(judge, key, "left")
