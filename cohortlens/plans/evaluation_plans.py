"""Registered scoring and evaluation queries (PRJ-19..24/26/29, EVL-01..15, JON-09).

Fixtures (FIXTURES §3): three integer pseudo log-scores per labelled document
and model; the tuned model leans harder towards the truth. Challenge rows
never have a BORDERLINE truth (an empty class). Binary scores for the
ranking metrics have many ties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import evaluate as E
from cohortlens.operators import scoring as S
from cohortlens.plans import fixtures as FX
from cohortlens.plans.oracle_views import register_view, with_views
from cohortlens.plans.registry import query

R = C.round6
BY = ["model", "split"]
MODELS = [("base", 1.0), ("tuned", 4.0)]


# ---------------------------------------------------------------- fixtures
def raw_scores(cdm):
    s = FX.samples3(cdm)
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(v).alias("shift")) for n, v in MODELS]))
    x = s.select("sample_id", "doc_id", "n_chars", F.col("label").alias("true_label"), m.alias("_m"))
    scores = F.array(*[(-((F.col("doc_id") * (k + 3) + F.col("n_chars")) % 7).cast("double")
                        + F.when(F.col("true_label") == k, F.col("_m.shift")).otherwise(F.lit(0.0))) for k in range(3)])
    split = F.when((F.col("doc_id") % 3 == 0) & (F.col("true_label") != 1), "challenge").otherwise("external")
    return x.select("sample_id", "doc_id", F.col("_m.model").alias("model"), split.alias("split"), "true_label",
                    scores.alias("scores"))


def cases3(cdm):
    sc = raw_scores(cdm).withColumn("probs", C.softmax("scores"))
    return S.review_flags(S.decide(sc, "probs"))


register_view("cases3", ["samples3"], """
  SELECT *, CASE WHEN predicted_label = 0 THEN 'NOT_ELIGIBLE' WHEN predicted_label = 1 THEN 'BORDERLINE'
                 ELSE 'ELIGIBLE' END AS predicted_class,
         confidence - second AS top_two_margin,
         CAST((predicted_label = 1)::INT + (confidence < 0.8)::INT + (confidence - second < 0.15)::INT AS INTEGER)
           AS safety_flag_count
  FROM (SELECT *, greatest(p0, p1, p2) AS confidence, greatest(least(p0, p1), least(p1, p2), least(p0, p2)) AS second,
               CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS predicted_label
        FROM (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2
              FROM (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1,
                           exp(s2 - greatest(s0, s1, s2)) AS e2
                    FROM (SELECT s.sample_id, s.doc_id, m.model, s.label AS true_label,
                                 CASE WHEN s.doc_id % 3 = 0 AND s.label <> 1 THEN 'challenge' ELSE 'external' END AS split,
                                 -CAST((s.doc_id * 3 + s.n_chars) % 7 AS DOUBLE) + CASE WHEN s.label = 0 THEN m.shift ELSE 0.0 END AS s0,
                                 -CAST((s.doc_id * 4 + s.n_chars) % 7 AS DOUBLE) + CASE WHEN s.label = 1 THEN m.shift ELSE 0.0 END AS s1,
                                 -CAST((s.doc_id * 5 + s.n_chars) % 7 AS DOUBLE) + CASE WHEN s.label = 2 THEN m.shift ELSE 0.0 END AS s2
                          FROM samples3 s,
                               (SELECT 'base' AS model, CAST(1.0 AS DOUBLE) AS shift
                                UNION ALL SELECT 'tuned', CAST(4.0 AS DOUBLE)) m))))""")


def bscores(cdm):
    lab = cdm.raw("labels")
    d = cdm.raw("documents").select("doc_id", "n_chars")
    base = (F.col("doc_id") * 37 + F.col("n_chars")) % 101
    x = lab.join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").cast("int").alias("label"),
        F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("test").alias("split"),
        F.explode(F.array(F.struct(F.lit("base").alias("model"), (base / 100.0).alias("score")),
                          F.struct(F.lit("tuned").alias("model"), ((base + 60 * F.col("quality")) / 160.0).alias("score"))))
        .alias("_m"))
    return x.select("sample_id", "label", "split", F.col("_m.model").alias("model"), F.col("_m.score").alias("score"))


register_view("bscores", [], """
  SELECT CAST(lb.doc_id AS VARCHAR) AS sample_id, CAST(lb.quality AS INTEGER) AS label,
         CASE WHEN lb.doc_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split, m.model,
         CASE WHEN m.model = 'base' THEN ((lb.doc_id * 37 + d.n_chars) % 101) / 100.0
              ELSE ((lb.doc_id * 37 + d.n_chars) % 101 + 60 * lb.quality) / 160.0 END AS score
  FROM labels lb JOIN documents d ON lb.doc_id = d.doc_id, (SELECT 'base' AS model UNION ALL SELECT 'tuned') m""")

register_view("conf3", ["cases3"], """
  SELECT g.model, g.split, t.t AS true_label, p.p AS predicted_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT model, split FROM cases3) g CROSS JOIN (VALUES (0), (1), (2)) t(t) CROSS JOIN (VALUES (0), (1), (2)) p(p)
  LEFT JOIN (SELECT model, split, true_label, predicted_label, count(*) AS n FROM cases3 GROUP BY ALL) c
    ON c.model = g.model AND c.split = g.split AND c.true_label = t.t AND c.predicted_label = p.p""")

register_view("pc3", ["conf3"], """
  SELECT model, split, label, support, predicted, tp,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM (SELECT a.model, a.split, a.label, a.support, a.tp, b.predicted FROM
          (SELECT model, split, true_label AS label, CAST(sum(n) AS BIGINT) AS support,
                  CAST(sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS BIGINT) AS tp
           FROM conf3 GROUP BY ALL) a
        JOIN (SELECT model, split, predicted_label AS label, CAST(sum(n) AS BIGINT) AS predicted FROM conf3 GROUP BY ALL) b
        ON a.model = b.model AND a.split = b.split AND a.label = b.label)""")

register_view("ov3", ["pc3"], """
  SELECT model, split, CAST(sum(support) AS BIGINT) AS n,
         CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0.0 END AS accuracy,
         avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy,
         avg(f1) FILTER (WHERE support + predicted > 0) AS macro_f1, avg(f1) AS macro_f1_fixed,
         CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS weighted_f1
  FROM pc3 GROUP BY 1, 2""")

register_view("us3", ["cases3"], """
  SELECT model, split, CAST(count(*) FILTER (WHERE true_label = 0 AND predicted_label = 2) AS BIGINT) AS unsafe_eligible_count,
         count(*) FILTER (WHERE true_label = 0 AND predicted_label = 2)
           / nullif(count(*) FILTER (WHERE true_label = 0), 0) AS unsafe_eligible_rate,
         count(*) FILTER (WHERE predicted_label = 1) / count(*) AS manual_review_rate
  FROM cases3 GROUP BY 1, 2""")

register_view("curve", ["bscores"], """
  SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum,
         sum(tp) OVER (PARTITION BY model, split) AS P, sum(fp) OVER (PARTITION BY model, split) AS N
  FROM (SELECT model, split, score, sum(label) AS tp, sum(1 - label) AS fp FROM bscores GROUP BY ALL)
  WINDOW w AS (PARTITION BY model, split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

register_view("pr", ["curve"], """
  SELECT model, split, score AS threshold,
         CASE WHEN tp_cum + fp_cum > 0 THEN tp_cum / (tp_cum + fp_cum) ELSE 0.0 END AS precision,
         CASE WHEN P > 0 THEN tp_cum / P ELSE 1.0 END AS recall FROM curve""")

register_view("thr", ["pr"], """
  SELECT model, split, coalesce(a_t, b_t) AS threshold, coalesce(a_p, b_p) AS precision, coalesce(a_r, b_r) AS recall,
         CASE WHEN a_t IS NOT NULL THEN 'min_recall' ELSE 'f2' END AS rule
  FROM (SELECT model, split,
          arg_max(threshold, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_t,
          arg_max(precision, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_p,
          arg_max(recall, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_r,
          arg_max(threshold, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_t,
          arg_max(precision, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_p,
          arg_max(recall, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_r
        FROM pr GROUP BY 1, 2)""")


def _curve(cdm):
    return E.score_curve(bscores(cdm), BY)


def _thresholds(cdm):
    val = bscores(cdm).filter(F.col("split") == "validation")
    pr = E.pr_curve(E.score_curve(val, ["model"]), ["model"])
    return E.select_threshold(pr, ["model"])


def _rounded(df):
    return df.select(*[R(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# ---------------------------------------------------------------- PRJ-20..23 / 29
@query("prj_20_softmax", with_views("""
  SELECT sample_id, model, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM cases3""", "cases3"))
def prj_20(cdm):
    """Candidate log-scores -> probabilities (numerically stable softmax)."""
    c = cases3(cdm)
    return c.select("sample_id", "model", *[R(F.col("probs")[k]).alias(f"p{k}") for k in range(3)])


@query("prj_21_decisions", with_views("""
  SELECT sample_id, model, split, predicted_label, predicted_class, round(confidence, 6) AS confidence,
         round(top_two_margin, 6) AS top_two_margin FROM cases3""", "cases3"))
def prj_21(cdm):
    """Predicted class (argmax, first maximum), label name, confidence and top-two margin."""
    c = cases3(cdm)
    return c.select("sample_id", "model", "split", "predicted_label", "predicted_class", R("confidence").alias("confidence"),
                    R("top_two_margin").alias("top_two_margin"))


@query("prj_23_review_flags", with_views("""
  SELECT sample_id, model, safety_flag_count, true AS requires_human_review,
         CASE WHEN safety_flag_count = 0 THEN 'Research-only PIFU classification requires human clinical review.'
              ELSE 'Research-only PIFU classification requires human clinical review. Additional review triggers: '
                   || concat_ws(' ', CASE WHEN predicted_label = 1 THEN 'Classifier returned BORDERLINE.' END,
                                     CASE WHEN confidence < 0.8 THEN 'Classifier confidence is below 0.80.' END,
                                     CASE WHEN top_two_margin < 0.15 THEN 'The two highest class probabilities are close.' END)
         END AS review_reason
  FROM cases3""", "cases3"))
def prj_23(cdm):
    """Review flags (BORDERLINE, confidence < 0.80, margin < 0.15) and the review reason text."""
    c = cases3(cdm)
    return c.select("sample_id", "model", "safety_flag_count", "requires_human_review", "review_reason")


@query("prj_22_prediction_checks", with_views("""
  , x AS (SELECT sample_id, model, predicted_label, predicted_class,
                 CASE WHEN doc_id % 45 = 0 THEN p0 * 0.99 ELSE p0 END AS q0,
                 CASE WHEN doc_id % 45 = 0 THEN p1 * 0.99 ELSE p1 END AS q1,
                 CASE WHEN doc_id % 45 = 0 THEN p2 * 0.99 ELSE p2 END AS q2,
                 CASE WHEN doc_id % 40 = 0 THEN round(confidence, 2) ELSE confidence END AS conf,
                 CASE WHEN doc_id % 35 = 0 THEN 'ELIGIBLE' ELSE predicted_class END AS shown_class
          FROM cases3),
  y AS (SELECT *, CASE predicted_label WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS cls FROM x)
  SELECT sample_id, model, concat_ws(',',
           CASE WHEN least(q0, q1, q2) < 0 OR greatest(q0, q1, q2) > 1 THEN 'probability_out_of_range' END,
           CASE WHEN abs(q0 + q1 + q2 - 1.0) > 0.001 THEN 'probabilities_do_not_sum_to_one' END,
           CASE WHEN shown_class IS DISTINCT FROM predicted_class THEN 'label_class_mismatch' END,
           CASE WHEN abs(conf - cls) > 0.0001 THEN 'confidence_not_class_probability' END,
           CASE WHEN cls < greatest(q0, q1, q2) - 0.0001 THEN 'class_is_not_max' END) AS violations
  FROM y WHERE least(q0, q1, q2) < 0 OR greatest(q0, q1, q2) > 1 OR abs(q0 + q1 + q2 - 1.0) > 0.001
        OR shown_class IS DISTINCT FROM predicted_class OR abs(conf - cls) > 0.0001
        OR cls < greatest(q0, q1, q2) - 0.0001""", "cases3"))
def prj_22(cdm):
    """Prediction integrity report over predictions with injected defects (scaled probabilities,
    rounded confidence, wrong class name); one row per broken prediction."""
    c = cases3(cdm)
    k = F.col("doc_id")
    probs = F.when(k % 45 == 0, F.transform("probs", lambda x: x * 0.99)).otherwise(F.col("probs"))
    d = c.select("sample_id", "model", "predicted_label", probs.alias("probs"),
                 F.when(k % 40 == 0, F.round("confidence", 2)).otherwise(F.col("confidence")).alias("confidence"),
                 F.when(k % 35 == 0, F.lit("ELIGIBLE")).otherwise(F.col("predicted_class")).alias("predicted_class"))
    v = S.check_predictions(d, "probs")
    return v.select("sample_id", "model", F.array_join("violations", ",").alias("violations"))


@query("prj_19_pack_examples", """
  SELECT doc_id, CAST(k + 1 AS INTEGER) AS n_input, CAST(k AS INTEGER) AS n_masked,
         CAST(coalesce(list_sum(list_slice(ids, 1, k)), 0) + lbl AS BIGINT) AS sum_input_ids
  FROM (SELECT doc_id, ids, lbl, CAST(greatest(0, least(len(ids), 512 - 1)) AS BIGINT) AS k
        FROM (SELECT d.doc_id, CAST(lb.quality AS INTEGER) AS lbl,
                     list_transform(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS ids
              FROM documents d JOIN labels lb ON d.doc_id = lb.doc_id))""")
def prj_19(cdm):
    """Supervised examples (max 512 tokens): prompt truncated to fit the response, prompt masked with -100."""
    d = cdm.raw("documents").join(cdm.raw("labels"), "doc_id")
    ex = S.pack_example(S.whitespace_token_ids("text"), F.array(F.col("quality").cast("int")), 512).alias("ex")
    x = d.select("doc_id", ex)
    return x.select("doc_id", F.size("ex.input_ids").alias("n_input"),
                    F.size(F.filter("ex.labels", lambda v: v == -100)).alias("n_masked"),
                    F.aggregate("ex.input_ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("sum_input_ids"))


# ---------------------------------------------------------------- EVL-01..05 / 11 / 12 / 14
@query("evl_01_confusion", with_views("SELECT * FROM conf3", "conf3"))
def evl_01(cdm):
    """Confusion matrix per (model, split) on the full 3x3 label grid, zeros kept."""
    return E.confusion(cases3(cdm), BY)


@query("evl_02_per_class", with_views("""
  SELECT model, split, label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
         round(f1, 6) AS f1 FROM pc3""", "pc3"))
def evl_02(cdm):
    """Per-class precision / recall / F1 / support (zero_division = 0)."""
    return _rounded(E.per_class(E.confusion(cases3(cdm), BY), BY))


@query("evl_03_overall", with_views("""
  SELECT model, split, n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
         round(macro_f1, 6) AS macro_f1, round(macro_f1_fixed, 6) AS macro_f1_fixed, round(weighted_f1, 6) AS weighted_f1
  FROM ov3""", "ov3"))
def evl_03(cdm):
    """Accuracy, balanced accuracy, macro-F1 (present / fixed labels), weighted-F1."""
    return _rounded(E.overall(E.per_class(E.confusion(cases3(cdm), BY), BY), BY))


@query("evl_04_unsafe", with_views("""
  SELECT model, split, unsafe_eligible_count, round(unsafe_eligible_rate, 6) AS unsafe_eligible_rate,
         round(manual_review_rate, 6) AS manual_review_rate FROM us3""", "us3"))
def evl_04(cdm):
    """Unsafe-eligible count and rate, manual-review rate."""
    return _rounded(E.unsafe(cases3(cdm), BY))


@query("evl_05_prediction_counts", with_views("""
  SELECT model, split, predicted_label, CAST(count(*) AS BIGINT) AS n FROM cases3 GROUP BY ALL""", "cases3"))
def evl_05(cdm):
    """Prediction counts per class."""
    return E.prediction_counts(cases3(cdm), BY)


@query("evl_11_confidence_rates", with_views("""
  SELECT model, split, round(avg(confidence), 6) AS mean_confidence,
         round(avg(confidence) FILTER (WHERE true_label = predicted_label), 6) AS mean_confidence_correct,
         round(avg(confidence) FILTER (WHERE true_label <> predicted_label), 6) AS mean_confidence_incorrect,
         round(avg(top_two_margin), 6) AS mean_top_two_margin,
         round(avg(CASE WHEN confidence < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate,
         round(avg(CASE WHEN top_two_margin < 0.15 THEN 1.0 ELSE 0.0 END), 6) AS close_margin_rate,
         round(avg(CASE WHEN safety_flag_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate,
         CAST(1.0 AS DOUBLE) AS human_review_rate,
         CAST(count(*) FILTER (WHERE true_label <> predicted_label) AS BIGINT) AS misclassified
  FROM cases3 GROUP BY 1, 2""", "cases3"))
def evl_11(cdm):
    """Mean confidence (all / correct / incorrect), margin, low-confidence, close-margin, flag and review rates."""
    return _rounded(E.confidence_rates(cases3(cdm), BY))


@query("evl_12_report", with_views("""
  SELECT model, split, CASE label WHEN 0 THEN 'NOT_ELIGIBLE' WHEN 1 THEN 'BORDERLINE' ELSE 'ELIGIBLE' END AS row,
         round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS DOUBLE) AS support
  FROM pc3
  UNION ALL SELECT model, split, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS DOUBLE)
  FROM pc3 GROUP BY 1, 2
  UNION ALL SELECT model, split, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
         CAST(sum(support) AS DOUBLE) FROM pc3 GROUP BY 1, 2
  UNION ALL SELECT model, split, 'weighted avg', round(sum(precision * support) / sum(support), 6),
         round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
         CAST(sum(support) AS DOUBLE) FROM pc3 GROUP BY 1, 2""", "pc3"))
def evl_12(cdm):
    """Classification report: per class, accuracy, macro avg and weighted avg rows."""
    pc = E.per_class(E.confusion(cases3(cdm), BY), BY)
    return _rounded(E.report(pc, BY, dict(enumerate(C.LABEL_NAMES))))


register_view("cf3", ["cases3"], """
  SELECT model, split, avg(confidence) AS mean_confidence,
         avg(confidence) FILTER (WHERE true_label = predicted_label) AS mean_confidence_correct,
         avg(confidence) FILTER (WHERE true_label <> predicted_label) AS mean_confidence_incorrect,
         avg(top_two_margin) AS mean_top_two_margin, avg((confidence < 0.8)::INT) AS low_confidence_rate,
         avg((top_two_margin < 0.15)::INT) AS close_margin_rate, avg((safety_flag_count > 0)::INT) AS safety_flag_rate,
         CAST(1.0 AS DOUBLE) AS human_review_required_rate,
         CAST(count(*) FILTER (WHERE true_label <> predicted_label) AS DOUBLE) AS misclassified_count
  FROM cases3 GROUP BY 1, 2""")

_CLASS_SQL = ", ".join(f"CAST(max({m}) FILTER (WHERE label = {k}) AS DOUBLE) AS {c}_{m}"
                       for k, c in enumerate(E.CLASS_KEYS) for m in ("precision", "recall", "f1", "support"))

_EVAL_LONG = f"""SELECT model, split, metric, value FROM (
    SELECT o.model, o.split, CAST(o.n AS DOUBLE) AS n, o.accuracy, o.balanced_accuracy, o.macro_f1, o.macro_f1_fixed,
           o.weighted_f1, CAST(u.unsafe_eligible_count AS DOUBLE) AS unsafe_eligible_count, u.unsafe_eligible_rate,
           u.manual_review_rate, c.* EXCLUDE (model, split), f.* EXCLUDE (model, split)
    FROM ov3 o JOIN us3 u ON o.model = u.model AND o.split = u.split
    JOIN (SELECT model, split, {_CLASS_SQL} FROM pc3 GROUP BY 1, 2) c ON o.model = c.model AND o.split = c.split
    JOIN cf3 f ON o.model = f.model AND o.split = f.split)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (model, split))))"""
_EVAL_VIEWS = ("ov3", "us3", "pc3", "cf3")


@query("evl_14_evaluate", with_views(f"SELECT model, split, metric, round(value, 6) AS value FROM ({_EVAL_LONG})",
                                     *_EVAL_VIEWS))
def evl_14(cdm):
    """All three-class metrics for every (model, split) in one pass, long form."""
    return E.evaluate(cases3(cdm), BY).withColumn("value", R("value"))


@query("jon_09_compare", with_views(f"""
  , m AS ({_EVAL_LONG})
  SELECT coalesce(b.split, t.split) AS split, coalesce(b.metric, t.metric) AS metric, round(b.value, 6) AS base,
         round(t.value, 6) AS tuned, round(t.value - b.value, 6) AS delta
  FROM (SELECT * FROM m WHERE model = 'base') b FULL OUTER JOIN (SELECT * FROM m WHERE model = 'tuned') t
    ON b.split = t.split AND b.metric = t.metric""", *_EVAL_VIEWS))
def jon_09(cdm):
    """Base vs tuned model per (split, metric) with the delta."""
    out = E.compare(E.evaluate(cases3(cdm), BY), ["split"])
    return out.select("split", "metric", R("base").alias("base"), R("tuned").alias("tuned"), R("delta").alias("delta"))


@query("prj_26_finite_metrics", with_views(f"""
  SELECT model, split, 'external_' || metric AS metric, round(value, 6) AS value FROM ({_EVAL_LONG})
  WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE""", *_EVAL_VIEWS))
def prj_26(cdm):
    """Finite scalar metrics only (null / NaN / infinite dropped), names prefixed."""
    out = E.finite_metrics(E.evaluate(cases3(cdm), BY), "external_")
    return out.withColumn("value", R("value"))


@query("evl_15_generated", with_views("""
  , g AS (SELECT model, split, true_label,
                 CASE WHEN doc_id % 11 = 0 THEN 'maybe' ELSE CAST(predicted_label AS VARCHAR) || ' - rationale' END AS raw
          FROM cases3),
  p AS (SELECT model, split, true_label, regexp_matches(trim(raw), '^[012]') AS ok,
               CASE WHEN regexp_matches(trim(raw), '^[012]') THEN CAST(left(trim(raw), 1) AS INTEGER) ELSE 1 END AS predicted_label
        FROM g),
  k AS (SELECT model, split, label, count(*) FILTER (WHERE true_label = label) AS s,
               count(*) FILTER (WHERE predicted_label = label) AS q,
               count(*) FILTER (WHERE true_label = label AND predicted_label = label) AS t
        FROM p, (VALUES (0), (1), (2)) v(label) GROUP BY ALL),
  m AS (SELECT model, split, avg(t / s) FILTER (WHERE s > 0) AS balanced_accuracy,
               avg(2 * t / (s + q)) FILTER (WHERE s + q > 0) AS macro_f1,
               sum(CASE WHEN s + q > 0 THEN 2 * t / (s + q) * s ELSE 0 END) / sum(s) AS weighted_f1 FROM k GROUP BY ALL),
  o AS (SELECT model, split, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS invalid_outputs,
               avg((true_label = predicted_label)::INT) AS accuracy,
               count(*) FILTER (WHERE true_label = 0 AND predicted_label = 2) AS unsafe_eligible_count,
               count(*) FILTER (WHERE true_label = 0) AS negatives FROM p GROUP BY ALL)
  SELECT model, split, CAST(n AS BIGINT) AS n, CAST(invalid_outputs AS BIGINT) AS invalid_outputs,
         round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1,
         round(weighted_f1, 6) AS weighted_f1, CAST(unsafe_eligible_count AS BIGINT) AS unsafe_eligible_count,
         round(unsafe_eligible_count / nullif(negatives, 0), 6) AS unsafe_eligible_rate
  FROM o JOIN m USING (model, split)""", "cases3"))
def evl_15(cdm):
    """Generation-mode evaluation: leading-digit parse, invalid outputs routed to BORDERLINE and counted."""
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit("maybe")).otherwise(
        F.concat(F.col("predicted_label").cast("string"), F.lit(" - rationale")))
    return _rounded(E.generated_metrics(cases3(cdm).select("model", "split", "true_label", raw.alias("raw")), BY))


@query("evl_01_off_grid", with_views("""
  SELECT sample_id, model, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 7 ELSE true_label END AS true_label
  FROM cases3 WHERE doc_id % 13 = 0 OR doc_id % 17 = 0""", "cases3"))
def evl_01_off_grid(cdm):
    """Cases that no confusion cell counts: null or unknown labels (planted by id)."""
    planted = (F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("int")).when(F.col("doc_id") % 17 == 0, F.lit(7))
               .otherwise(F.col("true_label")))
    return E.off_grid(cases3(cdm).withColumn("true_label", planted)).select("sample_id", "model", "true_label")


# ---------------------------------------------------------------- EVL-06..10 / 13 / PRJ-24
@query("evl_06_roc_auc", with_views("""
  SELECT model, split, round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(fp * (tp_cum - tp + tp / 2.0)) / (max(P) * max(N)) END, 6)
         AS roc_auc FROM curve GROUP BY 1, 2""", "curve"))
def evl_06(cdm):
    """ROC AUC per (model, split), ties half-credited (distributed prefix sums)."""
    return _rounded(E.roc_auc(_curve(cdm), BY))


@query("evl_07_average_precision", with_views("""
  SELECT model, split, round(CASE WHEN max(P) > 0 THEN sum(tp / P * tp_cum / (tp_cum + fp_cum)) END, 6) AS average_precision
  FROM curve GROUP BY 1, 2""", "curve"))
def evl_07(cdm):
    """Average precision (step sum) per (model, split)."""
    return _rounded(E.average_precision(_curve(cdm), BY))


@query("evl_08_pr_curve", with_views("""
  SELECT model, split, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
  FROM pr""", "pr"))
def evl_08(cdm):
    """Precision-recall curve: one point per distinct score."""
    return _rounded(E.pr_curve(_curve(cdm), BY))


_VAL_THR = """
  , vcurve AS (SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum, sum(tp) OVER (PARTITION BY model) AS P
               FROM (SELECT model, score, sum(label) AS tp, sum(1 - label) AS fp FROM bscores WHERE split = 'validation'
                     GROUP BY ALL)
               WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  vpr AS (SELECT model, score AS threshold, CASE WHEN tp_cum + fp_cum > 0 THEN tp_cum / (tp_cum + fp_cum) ELSE 0.0 END AS precision,
                 CASE WHEN P > 0 THEN tp_cum / P ELSE 1.0 END AS recall FROM vcurve),
  vthr AS (SELECT model, coalesce(a_t, b_t) AS threshold, coalesce(a_p, b_p) AS precision, coalesce(a_r, b_r) AS recall,
                  CASE WHEN a_t IS NOT NULL THEN 'min_recall' ELSE 'f2' END AS rule
           FROM (SELECT model,
                   arg_max(threshold, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_t,
                   arg_max(precision, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_p,
                   arg_max(recall, (precision, -threshold)) FILTER (WHERE recall >= 0.95) AS a_r,
                   arg_max(threshold, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_t,
                   arg_max(precision, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_p,
                   arg_max(recall, (5 * precision * recall / (4 * precision + recall + 1e-12), -threshold)) AS b_r
                 FROM vpr GROUP BY 1))"""


@query("evl_09_threshold", with_views(_VAL_THR + """
  SELECT model, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, rule
  FROM vthr""", "bscores"))
def evl_09(cdm):
    """Threshold chosen on validation: best precision with recall >= 0.95, else best F2."""
    return _rounded(_thresholds(cdm))


_APPLIED = """, applied AS (SELECT b.*, CAST(b.score >= coalesce(t.threshold, 0.5) AS INTEGER) AS predicted_label
                FROM bscores b LEFT JOIN vthr t ON b.model = t.model WHERE b.split = 'test')"""


@query("prj_24_apply_threshold", with_views(_VAL_THR + _APPLIED + """
  SELECT sample_id, model, predicted_label FROM applied""", "bscores"))
def prj_24(cdm):
    """Validation-chosen threshold applied (>=) to the test scores of each model."""
    test = bscores(cdm).filter(F.col("split") == "test")
    return E.apply_threshold(test, _thresholds(cdm), ["model"]).select("sample_id", "model", "predicted_label")


@query("evl_13_binary_suite", with_views(_VAL_THR + _APPLIED + """
  , c AS (SELECT model, count(*) FILTER (WHERE label = 1 AND predicted_label = 1) AS tp,
                 count(*) FILTER (WHERE label = 0 AND predicted_label = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND predicted_label = 0) AS fn,
                 count(*) FILTER (WHERE label = 0 AND predicted_label = 0) AS tn FROM applied GROUP BY 1),
  m AS (SELECT model, tp, fp, fn, tn,
               CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
               CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END AS f1_0,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall_0 FROM c)
  SELECT model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
         round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (recall + recall_0) / 2 WHEN tp + fn > 0 THEN recall ELSE recall_0 END, 6)
           AS balanced_accuracy,
         round((f1_0 + f1) / 2, 6) AS macro_f1, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall
  FROM m""", "bscores"))
def evl_13(cdm):
    """Binary suite on the test split after the validation threshold: F1, macro-F1, accuracy,
    balanced accuracy, precision, recall."""
    test = bscores(cdm).filter(F.col("split") == "test")
    applied = E.apply_threshold(test, _thresholds(cdm), ["model"]).withColumnRenamed("label", "true_label")
    return _rounded(E.binary_suite(applied, ["model"]))


@query("evl_10_score_range", with_views("""
  SELECT model, split, round(min(score), 6) AS probability_min, round(median(score), 6) AS probability_median,
         round(max(score), 6) AS probability_max FROM bscores GROUP BY 1, 2""", "bscores"))
def evl_10(cdm):
    """Probability min / median / max per (model, split)."""
    return _rounded(E.score_range(bscores(cdm), BY))


# ---------------------------------------------------------------- UDF-01 / UDF-02 (rows-only: model code)
def stub_model():
    """Deterministic stand-in scorer (a real one loads weights here, once per worker)."""
    def score(texts):
        out = []
        for t in texts:
            n = len(t or "")
            out.append([-float(n % 7), -float(n % 5), -float(n % 3)])
        return out
    return score


def stub_labeller(text):
    """Deterministic stand-in labeller: fails on some letters, is unsure on others."""
    n = len(text or "")
    if n % 13 == 0:
        raise TimeoutError("labeller timeout")
    if n % 5 == 0:
        return None
    return int(n % 2)


@query("udf_01_score_batches", """
  WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, -(length(coalesce(text, '')) % 7) AS a,
                    -(length(coalesce(text, '')) % 5) AS b, -(length(coalesce(text, '')) % 3) AS c FROM documents)
  SELECT sample_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS predicted_label,
         round(exp(greatest(a, b, c)) / (exp(a) + exp(b) + exp(c)), 6) AS confidence FROM s""")
def udf_01(cdm):
    """Batch scorer over every document text (mapInPandas, scorer built once per worker) -> probabilities."""
    d = cdm.raw("documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    scored = S.score_batches(d, stub_model, "text", "sample_id")
    return S.decide(scored.withColumn("probs", C.softmax("scores")), "probs").select(
        "sample_id", F.col("predicted_label").cast("int").alias("predicted_label"),
        C.round6("confidence").alias("confidence"))


@query("udf_02_label_batches", with_views(f"""
  SELECT CAST(note_id AS BIGINT) AS note_id,
         CASE WHEN n % 13 = 0 OR n % 5 = 0 THEN 'unresolved' ELSE 'resolved' END AS status,
         CAST(CASE WHEN n % 13 <> 0 AND n % 5 <> 0 THEN n % 2 END AS INTEGER) AS label, n % 13 = 0 AS label_failed,
         CASE WHEN n % 13 = 0 THEN 'TimeoutError' END AS error_type,
         CASE WHEN n % 13 = 0 THEN 'api_failure' WHEN n % 5 = 0 THEN 'labeller_uncertain' END AS unresolved_reason,
         CAST(CASE WHEN n % 13 = 0 THEN {S.MAX_LABEL_ATTEMPTS} ELSE 1 END AS INTEGER) AS attempts FROM (SELECT note_id, length(text) AS n FROM letters)""", "letters"))
def udf_02(cdm):
    """Batch labeller with bounded retries over every letter; failures -> unresolved / api_failure."""
    return S.label_batches(FX.letters(cdm), stub_labeller, "text", "note_id", base_wait=0)
