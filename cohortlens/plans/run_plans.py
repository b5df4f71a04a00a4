"""Registered judge-selection and run-reporting queries
(WIN-04/05, PRJ-25, AGG-25, EVL-16, JON-11, PRJ-28, AGG-21..23, WIN-06, SRC-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.keywords import COHORT_QUERIES
from cohortlens.operators import judge as J
from cohortlens.operators import runs as RU
from cohortlens.plans.evaluation_plans import cases3
from cohortlens.plans.oracle_views import register_view, with_views
from cohortlens.plans.registry import query

R = C.round6
BUDGET = J.DEFAULT_BUDGET

register_view("selected", ["cases3"], f"""
  SELECT * FROM (
    SELECT c.*, CAST(row_number() OVER (PARTITION BY model ORDER BY true_label = predicted_label, safety_flag_count DESC,
                          confidence, top_two_margin, split, sample_id) AS INTEGER) AS selection_order,
           CASE WHEN true_label <> predicted_label THEN 'misclassified_priority'
                WHEN safety_flag_count > 0 THEN 'safety_flag_priority' ELSE 'borderline_priority' END AS selection_reason
    FROM cases3 c WHERE true_label <> predicted_label OR safety_flag_count > 0 OR predicted_label = 1)
  WHERE selection_order <= {max(1, BUDGET // 2)}
  UNION ALL
  SELECT * EXCLUDE (br, fo) FROM (
    SELECT f.*, CAST(least(coalesce(np.n_pri, 0), {max(1, BUDGET // 2)}) + f.fo AS INTEGER) AS selection_order,
           'split_class_representative' AS selection_reason
    FROM (SELECT b.*, row_number() OVER (PARTITION BY model ORDER BY br, split, predicted_label) AS fo
          FROM (SELECT r.*, row_number() OVER (PARTITION BY model, split, predicted_label
                                                ORDER BY confidence, top_two_margin, split, sample_id) AS br
                FROM cases3 r WHERE NOT EXISTS (
                  SELECT 1 FROM (SELECT model, sample_id, row_number() OVER (PARTITION BY model ORDER BY
                                   true_label = predicted_label, safety_flag_count DESC, confidence, top_two_margin,
                                   split, sample_id) AS rk
                                 FROM cases3 WHERE true_label <> predicted_label OR safety_flag_count > 0
                                   OR predicted_label = 1) p
                  WHERE p.rk <= {max(1, BUDGET // 2)} AND p.model = r.model AND p.sample_id = r.sample_id)) b) f
    LEFT JOIN (SELECT model, count(*) AS n_pri FROM cases3 WHERE true_label <> predicted_label OR safety_flag_count > 0
                 OR predicted_label = 1 GROUP BY 1) np ON f.model = np.model
    WHERE f.fo <= {BUDGET} - least(coalesce(np.n_pri, 0), {max(1, BUDGET // 2)}))""")


def selected(cdm):
    return J.select_cases(cases3(cdm), ["model"], BUDGET)


def judge_rows(cdm):
    s = cases3(cdm)
    k = F.col("doc_id")
    expl = k % 9 != 0
    avail = expl & (k % 7 != 0)
    scores = [F.when(avail, (1 + (k * (i + 1)) % 5).cast("int")).alias(name) for i, name in enumerate(J.SCORES)]
    j = s.select("model", "sample_id", "split", "doc_id", expl.alias("explanation_available"),
                 avail.alias("judge_available"), *scores,
                 F.when(avail, k % 6 == 0).otherwise(F.lit(False)).alias("judge_hallucination"),
                 F.when(avail, (k % 4).cast("int")).otherwise(F.lit(0)).alias("unsupported_claim_count"))
    return J.check_judge(j)


register_view("judged", ["cases3"], """
  SELECT *, judge_available AND explanation_faithfulness >= 4 AND evidence_grounding >= 4 AND prediction_consistency >= 4 AND safety_compliance >= 4
              AND NOT judge_hallucination AS judge_pass
  FROM (SELECT model, sample_id, split, doc_id, doc_id % 9 <> 0 AS explanation_available,
               doc_id % 9 <> 0 AND doc_id % 7 <> 0 AS judge_available,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN CAST(1 + (doc_id * 1) % 5 AS INTEGER) END AS explanation_faithfulness,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN CAST(1 + (doc_id * 2) % 5 AS INTEGER) END AS evidence_grounding,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN CAST(1 + (doc_id * 3) % 5 AS INTEGER) END AS prediction_consistency,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN CAST(1 + (doc_id * 4) % 5 AS INTEGER) END AS safety_compliance,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 6 = 0 ELSE false END AS judge_hallucination,
               CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 <> 0 THEN CAST(doc_id % 4 AS INTEGER) ELSE 0 END AS unsupported_claim_count
        FROM cases3)""")


@query("win_04_priority_cases", with_views("""
  SELECT model, sample_id, selection_order, selection_reason FROM selected WHERE selection_reason <> 'split_class_representative'""",
                                           "selected"))
def win_04(cdm):
    """Judge selection, priority part: up to half the budget of wrong / flagged / borderline cases per model."""
    p = J.priority_cases(cases3(cdm), ["model"], BUDGET)
    return p.select("model", "sample_id", F.col("selection_order").cast("int").alias("selection_order"),
                    "selection_reason")


@query("win_05_select_cases", with_views("""
  SELECT model, sample_id, split, predicted_label, selection_order, selection_reason FROM selected""", "selected"))
def win_05(cdm):
    """Judge selection of 24 cases per model: priority cases, then round-robin over (split, predicted label)."""
    return selected(cdm).select("model", "sample_id", "split", "predicted_label",
                                F.col("selection_order").cast("int").alias("selection_order"), "selection_reason")


@query("prj_25_judge_checks", with_views("""
  SELECT model, sample_id, judge_available, judge_pass,
         NOT judge_available OR (explanation_faithfulness BETWEEN 1 AND 5 AND evidence_grounding BETWEEN 1 AND 5
                                 AND prediction_consistency BETWEEN 1 AND 5 AND safety_compliance BETWEEN 1 AND 5) AS scores_valid
  FROM judged""", "judged"))
def prj_25(cdm):
    """Judge consistency: pass <=> four scores >= 4 and no hallucination; scores within 1..5."""
    return judge_rows(cdm).select("model", "sample_id", "judge_available", "judge_pass", "scores_valid")


@query("agg_25_judge_summary", with_views("""
  SELECT model, CAST(count(*) AS BIGINT) AS selected,
         CAST(count(*) FILTER (WHERE explanation_available) AS BIGINT) AS explanations,
         round(avg(CASE WHEN explanation_available THEN 1.0 ELSE 0.0 END), 6) AS explanation_coverage,
         CAST(count(*) FILTER (WHERE judge_available) AS BIGINT) AS judged,
         CAST(count(*) FILTER (WHERE NOT judge_available) AS BIGINT) AS unavailable,
         round(avg(CASE WHEN judge_available THEN 1.0 ELSE 0.0 END), 6) AS coverage,
         round(avg(CASE WHEN judge_pass THEN 1.0 ELSE 0.0 END) FILTER (WHERE judge_available), 6) AS pass_rate,
         round(avg(CASE WHEN judge_hallucination THEN 1.0 ELSE 0.0 END) FILTER (WHERE judge_available), 6) AS hallucination_rate,
         round(avg(CASE WHEN unsupported_claim_count > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE judge_available), 6) AS unsupported_rate,
         round(avg(explanation_faithfulness) FILTER (WHERE judge_available), 6) AS mean_explanation_faithfulness,
         round(avg(evidence_grounding) FILTER (WHERE judge_available), 6) AS mean_evidence_grounding,
         round(avg(prediction_consistency) FILTER (WHERE judge_available), 6) AS mean_prediction_consistency,
         round(avg(safety_compliance) FILTER (WHERE judge_available), 6) AS mean_safety_compliance
  FROM judged GROUP BY 1""", "judged"))
def agg_25(cdm):
    """Judge summary per model: explanations, coverage, pass / hallucination / unsupported rates, four mean scores."""
    out = J.judge_summary(judge_rows(cdm), ["model"])
    return out.select(*[R(n).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


@query("evl_16_flagged_cases", with_views("""
  SELECT model, sample_id, split, judge_hallucination FROM judged WHERE judge_available AND NOT judge_pass""",
                                          "judged"))
def evl_16(cdm):
    """Error analysis: judged cases that fail the judge."""
    return J.flagged_cases(judge_rows(cdm)).select("model", "sample_id", "split", "judge_hallucination")


@query("jon_11_assemble_cases", with_views("""
  SELECT c.model, c.sample_id, c.split, c.true_label, c.predicted_label, round(c.confidence, 6) AS confidence,
         c.safety_flag_count, j.explanation_available, j.judge_available, j.judge_pass
  FROM cases3 c LEFT JOIN judged j ON c.model = j.model AND c.sample_id = j.sample_id""", "cases3", "judged"))
def jon_11(cdm):
    """Case records: prediction + safety joined with explanation and judge results (every case)."""
    c = cases3(cdm).select("model", "sample_id", "split", "true_label", "predicted_label",
                           R("confidence").alias("confidence"), "safety_flag_count")
    jr = judge_rows(cdm)
    expl = jr.select("model", "sample_id", "explanation_available")
    jd = jr.select("model", "sample_id", "judge_available", "judge_pass")
    return J.assemble_cases(c, expl, jd, ["model", "sample_id"])


# ---------------------------------------------------------------- runs
def run_results(cdm):
    c = cdm.raw("conversations").filter(F.col("role") == "assistant")
    failed = F.col("turn") % 7 == 6
    return c.select((F.col("conv_id") + 1).alias("person_id"), "turn",
                    F.when(failed, "failed").otherwise("success").alias("status"),
                    F.when(~failed, F.col("text")).alias("response"),
                    F.when(failed, "timeout").alias("error"))


_RESULTS_SQL = """SELECT conv_id + 1 AS person_id, turn, CASE WHEN turn % 7 = 6 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN turn % 7 <> 6 THEN text END AS response FROM conversations WHERE role = 'assistant'"""


@query("prj_28_assign_queries", with_views(f"""
  SELECT person_id, CAST((row_number() OVER (ORDER BY person_id) - 1) % 5 AS INTEGER) AS query_index FROM person""",
                                           "person"))
def prj_28(cdm):
    """Cohort-run queries assigned to patients cyclically (index mod 5) over a distributed rank."""
    out = RU.assign_cyclic(cdm.person.select("person_id"), [F.col("person_id")], COHORT_QUERIES)
    return out.select("person_id", "query_index")


@query("agg_21_run_responses", f"""
  SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS success,
         CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed,
         round(avg(length(response)) FILTER (WHERE status = 'success'), 6) AS avg_response_chars,
         CAST(min(length(response)) FILTER (WHERE status = 'success') AS INTEGER) AS min_response_chars,
         CAST(max(length(response)) FILTER (WHERE status = 'success') AS INTEGER) AS max_response_chars
  FROM ({_RESULTS_SQL})""")
def agg_21(cdm):
    """Cohort-run summary: success / failed, response length statistics."""
    out = RU.run_responses(run_results(cdm))
    return out.withColumn("avg_response_chars", R("avg_response_chars"))


@query("agg_21_response_lines", f"""
  SELECT person_id, turn, CAST(CASE WHEN response <> '' THEN len(string_split(regexp_replace(response, '^\\s+|\\s+$', '', 'g'), chr(10))) END AS INTEGER)
         AS response_lines, CAST(length(response) AS INTEGER) AS response_chars FROM ({_RESULTS_SQL})""")
def agg_21_lines(cdm):
    """Per-response line count and length."""
    return RU.response_lines(run_results(cdm)).select("person_id", "turn", "response_lines", "response_chars")


def steps(cdm):
    c = cdm.raw("conversations")
    status = (F.when(F.length("text") % 11 == 0, "failed").when(F.col("turn") % 5 == 4, "skipped")
              .otherwise("succeeded"))
    return c.select((F.col("conv_id") % 10).alias("run_id"),
                    F.concat(F.lit("step_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
                    .alias("step"), status.alias("status"), (F.length("text") / 100.0).alias("duration_seconds"))


_STEPS_SQL = """SELECT conv_id % 10 AS run_id, 'step_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS step,
         CASE WHEN length(text) % 11 = 0 THEN 'failed' WHEN turn % 5 = 4 THEN 'skipped' ELSE 'succeeded' END AS status,
         length(text) / 100.0 AS duration_seconds FROM conversations"""


@query("agg_22_run_status", f"""
  SELECT run_id, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
         CAST(count(*) FILTER (WHERE status = 'succeeded') AS BIGINT) AS n_succeeded,
         CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS n_skipped,
         CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 AND count(*) FILTER (WHERE status = 'succeeded') > 0
              THEN 'partial_success' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'success' END
           AS run_status, true AS research_output, true AS needs_clinician_review,
         count(*) FILTER (WHERE status = 'failed') > 0 AS may_be_incomplete
  FROM ({_STEPS_SQL}) GROUP BY 1""")
def agg_22(cdm):
    """Run status rollup: partial_success / failed / success."""
    return RU.run_status(steps(cdm))


@query("agg_23_step_table", f"""
  SELECT run_id, step, status, round(duration_seconds, 6) AS duration_seconds FROM ({_STEPS_SQL}) WHERE status <> 'skipped'""")
def agg_23(cdm):
    """Step table: non-skipped steps with their duration."""
    return RU.step_table(steps(cdm)).withColumn("duration_seconds", R("duration_seconds"))


def bundles(cdm):
    c = cdm.raw("conversations")
    return c.select(F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("dataset"),
                    F.when(F.col("conv_id") % 2 == 0, "base").otherwise("tuned").alias("model"),
                    F.col("role").alias("split"),
                    F.concat(F.lit("runs/"), F.lpad(F.col("conv_id").cast("string"), 4, "0"), F.lit("/turn_"),
                             F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit(".json")).alias("source"),
                    F.length("text").alias("metric_value"))


@query("win_06_last_bundle", """
  SELECT dataset, model, split, arg_max(source, source) AS source, CAST(arg_max(metric_value, source) AS INTEGER) AS metric_value
  FROM (SELECT 'd' || CAST(conv_id % 3 AS VARCHAR) AS dataset, CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model,
               role AS split, 'runs/' || lpad(CAST(conv_id AS VARCHAR), 4, '0') || '/turn_' || lpad(CAST(turn AS VARCHAR), 3, '0')
               || '.json' AS source, length(text) AS metric_value FROM conversations)
  GROUP BY 1, 2, 3""")
def win_06(cdm):
    """Last metric bundle per (dataset, model, split), ordered by source path."""
    return RU.last_bundle(bundles(cdm), ["dataset", "model", "split"], "source")


@query("src_11_latest_event", """
  SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1""")
def src_11(cdm):
    """Latest record per key by timestamp (newest event of every user)."""
    e = cdm.raw("events").select("user_id", "event_id", "event_type", "ts")
    return RU.latest(e, ["user_id"], "ts").select("user_id", "event_id", "event_type")
