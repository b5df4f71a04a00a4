"""Classifier evaluation (EVL-01..15, JON-09).

Every operator takes ``by`` group keys (e.g. model, split), so many runs are
evaluated in one pass. The case table is reduced once to a
``(by, true, predicted) -> n`` confusion table and once to a
``(by, score) -> (tp, fp)`` table; all metrics derive from those small
tables. Ranking metrics use distributed prefix sums, never a window over the
whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators.dist import checked_broadcast, exact_quantiles, prefix_sum

LABELS3 = [0, 1, 2]
# Threshold search settings.
MIN_RECALL = 0.95
DEFAULT_THRESHOLD = 0.5
F2_EPS = 1e-12


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# EVL-01 -----------------------------------------------------------------------
def confusion(df: DataFrame, by: list[str], labels: list[int] = LABELS3, true: str = "true_label",
              pred: str = "predicted_label") -> DataFrame:
    """Counts on the full label grid per group; empty cells kept as 0."""
    counts = df.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in labels for p in labels])
    grid = (df.select(*by).distinct().select(*by, F.explode(cells).alias("_c"))
            .select(*by, F.col("_c.t").alias(true), F.col("_c.p").alias(pred)))
    return grid.join(counts, by + [true, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def off_grid(df: DataFrame, labels: list[int] = LABELS3, true: str = "true_label",
             pred: str = "predicted_label") -> DataFrame:
    """Violation rows that no cell of the grid counts: a null or unknown true or predicted label."""
    known = F.coalesce(F.col(true).isin(labels), F.lit(False)) & F.coalesce(F.col(pred).isin(labels), F.lit(False))
    return df.filter(~known)


# EVL-02 -----------------------------------------------------------------------
def per_class(conf: DataFrame, by: list[str], true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """Precision / recall / F1 / support per class (zero_division = 0)."""
    t = conf.groupBy(*by, F.col(true).alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    p = conf.groupBy(*by, F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, by + ["label"], "inner")
    return j.select(*by, "label", F.col("support").cast("long").alias("support"),
                    F.col("predicted").cast("long").alias("predicted"), F.col("tp").cast("long").alias("tp"),
                    _div0(F.col("tp"), F.col("predicted")).alias("precision"),
                    _div0(F.col("tp"), F.col("support")).alias("recall"),
                    _div0(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


# EVL-03 -----------------------------------------------------------------------
def overall(pc: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro-F1 (present and fixed label policy), weighted-F1."""
    present = (F.col("support") + F.col("predicted")) > 0
    return pc.groupBy(*by).agg(
        F.sum("support").alias("n"),
        _div0(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.avg("f1").alias("macro_f1_fixed"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


# EVL-04 / EVL-05 ----------------------------------------------------------------
def unsafe(df: DataFrame, by: list[str], true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """Unsafe-eligible: truth NOT_ELIGIBLE predicted ELIGIBLE; manual review = predicted BORDERLINE."""
    bad = (F.col(true) == 0) & (F.col(pred) == 2)
    return df.groupBy(*by).agg(
        F.count_if(bad).alias("unsafe_eligible_count"),
        F.try_divide(F.count_if(bad), F.nullif(F.count_if(F.col(true) == 0), F.lit(0))).alias("unsafe_eligible_rate"),
        (F.count_if(F.col(pred) == 1) / F.count(F.lit(1))).alias("manual_review_rate"))


def prediction_counts(df: DataFrame, by: list[str], pred: str = "predicted_label") -> DataFrame:
    return df.groupBy(*by, pred).agg(F.count(F.lit(1)).alias("n"))


# EVL-06..08 -------------------------------------------------------------------
def score_curve(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """One row per (group, distinct score, descending) with cumulative tp / fp and group totals."""
    pts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("tp"),
                                     F.sum((1 - F.col(label)).cast("long")).alias("fp"))
    cum = prefix_sum(pts, by, [F.col(score).desc()], ["tp", "fp"], total_suffix="_total")
    return cum.withColumnRenamed("tp_total", "P").withColumnRenamed("fp_total", "N")


def roc_auc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney AUC with ties half-credited; null when one class is absent."""
    term = F.col("fp") * (F.col("tp_cum") - F.col("tp") + F.col("tp") / 2.0)
    return curve.groupBy(*by).agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(term) / (F.first("P") * F.first("N"))).alias("roc_auc"))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """Step-sum AP: sum over thresholds of (recall increase) x precision."""
    term = F.col("tp") / F.col("P") * F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))
    return curve.groupBy(*by).agg(F.when(F.first("P") > 0, F.sum(term)).alias("average_precision"))


def pr_curve(curve: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score used as threshold (score >= t)."""
    return curve.select(*by, F.col(score).alias("threshold"),
                        _div0(F.col("tp_cum"), F.col("tp_cum") + F.col("fp_cum")).alias("precision"),
                        F.when(F.col("P") > 0, F.col("tp_cum") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))


# EVL-09 -----------------------------------------------------------------------
def select_threshold(pr: DataFrame, by: list[str], min_recall: float = MIN_RECALL) -> DataFrame:
    """Highest precision among recall >= min_recall (lowest threshold on ties);
    otherwise the best F2 point; groups without thresholds are absent (callers
    default to 0.5)."""
    f2 = 5 * F.col("precision") * F.col("recall") / (4 * F.col("precision") + F.col("recall") + F2_EPS)
    ok = F.col("recall") >= min_recall
    picked = pr.groupBy(*by).agg(
        F.max_by(F.struct("threshold", "precision", "recall"),
                 F.when(ok, F.struct(F.col("precision"), -F.col("threshold")))).alias("_a"),
        F.max_by(F.struct("threshold", "precision", "recall"), F.struct(f2, -F.col("threshold"))).alias("_b"),
        F.max(ok.cast("int")).alias("_any"))
    chosen = F.when(F.col("_any") == 1, F.col("_a")).otherwise(F.col("_b"))
    return picked.select(*by, chosen["threshold"].alias("threshold"), chosen["precision"].alias("precision"),
                         chosen["recall"].alias("recall"),
                         F.when(F.col("_any") == 1, "min_recall").otherwise("f2").alias("rule"))


def apply_threshold(df: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score",
                    out: str = "predicted_label") -> DataFrame:
    """PRJ-24: predicted = score >= threshold of the group (0.5 when none was chosen)."""
    t = thresholds.select(*by, "threshold")
    j = df.join(checked_broadcast(t), by, "left")
    thr = F.coalesce(F.col("threshold"), F.lit(DEFAULT_THRESHOLD))
    return j.withColumn(out, (F.col(score) >= thr).cast("int")).drop("threshold")


# EVL-10 / EVL-11 ----------------------------------------------------------------
def score_range(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Least, middle and greatest score; the exact median is taken from value counts, not from a buffer per group."""
    ends = df.groupBy(*by).agg(F.min(score).alias("probability_min"), F.max(score).alias("probability_max"))
    middle = exact_quantiles(df, by, score, {"probability_median": 0.5})
    return ends.join(middle, by, "left").select(*by, "probability_min", "probability_median", "probability_max")


def confidence_rates(df: DataFrame, by: list[str], conf: float = 0.80, margin: float = 0.15) -> DataFrame:
    ok = F.col("true_label") == F.col("predicted_label")
    return df.groupBy(*by).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence_correct"),
        F.avg(F.when(~ok, F.col("confidence"))).alias("mean_confidence_incorrect"),
        F.avg("top_two_margin").alias("mean_top_two_margin"),
        F.avg((F.col("confidence") < conf).cast("double")).alias("low_confidence_rate"),
        F.avg((F.col("top_two_margin") < margin).cast("double")).alias("close_margin_rate"),
        F.avg((F.col("safety_flag_count") > 0).cast("double")).alias("flag_rate"),
        F.avg(F.col("requires_human_review").cast("double")).alias("human_review_rate"),
        F.count_if(~ok).alias("misclassified"))


# EVL-12 -----------------------------------------------------------------------
def report(pc: DataFrame, by: list[str], names: dict[int, str] | None = None) -> DataFrame:
    """Classification report rows: per class, accuracy, macro avg, weighted avg."""
    lab = F.col("label").cast("string")
    if names:
        expr = None
        for k, v in names.items():
            expr = F.when(F.col("label") == k, v) if expr is None else expr.when(F.col("label") == k, v)
            lab = expr.otherwise(F.col("label").cast("string"))
    rows = pc.select(*by, lab.alias("row"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    total = F.sum("support")
    acc = pc.groupBy(*by).agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                              F.lit(None).cast("double").alias("recall"), _div0(F.sum("tp"), total).alias("f1"),
                              total.cast("double").alias("support"))
    macro = pc.groupBy(*by).agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                total.cast("double").alias("support"))
    weighted = pc.groupBy(*by).agg(F.lit("weighted avg").alias("row"),
                                   *[_div0(F.sum(F.col(m) * F.col("support")), total).alias(m)
                                     for m in ("precision", "recall", "f1")], total.cast("double").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


# EVL-13 -----------------------------------------------------------------------
def binary_suite(df: DataFrame, by: list[str]) -> DataFrame:
    """F1 / precision / recall of class 1, macro-F1, accuracy, balanced accuracy."""
    pc = per_class(confusion(df, by, [0, 1]), by)
    ov = overall(pc, by)
    pos = pc.filter(F.col("label") == 1).select(*by, F.col("f1").alias("f1"), "precision", "recall")
    return ov.select(*by, "accuracy", "balanced_accuracy", F.col("macro_f1_fixed").alias("macro_f1")).join(pos, by)


# EVL-14 -----------------------------------------------------------------------
CLASS_KEYS = ["not_eligible", "borderline", "eligible"]
_CASE_COLUMNS = {"confidence", "top_two_margin", "safety_flag_count", "requires_human_review"}


def _measures(cells: DataFrame, by: list[str], labels: list[int] = LABELS3) -> DataFrame:
    """All label metrics in one wide row per group, from (by, true_label, predicted_label) cells with ``n``.

    A row with an off-grid label counts as wrong in the accuracy and in no class.
    """
    t, p, n = F.col("true_label"), F.col("predicted_label"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    per = []
    for k in labels:
        per += [total(t == k).alias(f"_s{k}"), total(p == k).alias(f"_p{k}"), total((t == k) & (p == k)).alias(f"_t{k}")]
    counted = cells.groupBy(*by).agg(F.sum("n").alias("n"), total(t == p).alias("_right"),
                                     total((t == 0) & (p == 2)).alias("unsafe_eligible_count"),
                                     *per, *[F.sum(c).alias(c) for c in cells.columns if c.startswith("_sum_")])
    s, pr, tp = ([F.col(f"_{x}{k}") for k in labels] for x in "spt")
    recall = [_div0(a, b) for a, b in zip(tp, s)]
    precision = [_div0(a, b) for a, b in zip(tp, pr)]
    f1 = [_div0(2 * a, b + c) for a, b, c in zip(tp, s, pr)]
    mean_of = lambda vs, oks: F.try_divide(
        sum((F.when(ok, v).otherwise(0.0) for v, ok in zip(vs, oks)), F.lit(0.0)),
        sum((ok.cast("int") for ok in oks), F.lit(0)))
    support = sum(s, F.lit(0))
    return counted.select(
        "*", _div0(F.col("_right"), F.col("n")).alias("accuracy"),
        mean_of(recall, [x > 0 for x in s]).alias("balanced_accuracy"),
        mean_of(f1, [a + b > 0 for a, b in zip(s, pr)]).alias("macro_f1"),
        (sum(f1, F.lit(0.0)) / len(labels)).alias("macro_f1_fixed"),
        _div0(sum((a * b for a, b in zip(f1, s)), F.lit(0.0)), support).alias("weighted_f1"),
        F.try_divide(F.col("unsafe_eligible_count"), F.nullif(s[0], F.lit(0))).alias("unsafe_eligible_rate"),
        _div0(pr[1], F.col("n")).alias("manual_review_rate"), (F.col("n") - F.col("_right")).alias("misclassified_count"),
        *[v.alias(f"{name}_{what}") for k, name in zip(labels, CLASS_KEYS) for what, v in (
            ("precision", precision[k]), ("recall", recall[k]), ("f1", f1[k]), ("support", s[k]))])


def evaluate(cases: DataFrame, by: list[str], conf: float = 0.80, margin: float = 0.15) -> DataFrame:
    """All three-class metrics for every group, as a long (by, metric, value) table.

    The cases are reduced once to (by, true, predicted) cells with counts and
    sums; every metric is arithmetic on those. Confidence, margin, flag and
    review rates are given when the cases have the columns for them.
    """
    sums = []
    metrics = ["n", "accuracy", "balanced_accuracy", "macro_f1", "macro_f1_fixed", "weighted_f1",
               "unsafe_eligible_count", "unsafe_eligible_rate", "manual_review_rate", "misclassified_count",
               *[f"{c}_{m}" for c in CLASS_KEYS for m in ("precision", "recall", "f1", "support")]]
    full = _CASE_COLUMNS <= set(cases.columns)
    if full:
        sums = [F.sum("confidence").alias("_sum_conf"), F.sum("top_two_margin").alias("_sum_margin"),
                F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("confidence"))).alias("_sum_right"),
                F.count_if(F.col("confidence") < conf).alias("_sum_low"),
                F.count_if(F.col("top_two_margin") < margin).alias("_sum_close"),
                F.count_if(F.col("safety_flag_count") > 0).alias("_sum_flag"),
                F.count_if("requires_human_review").alias("_sum_review")]
    cells = cases.groupBy(*by, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"), *sums)
    wide = _measures(cells, by)
    if full:
        n, right, wrong = F.col("n"), F.col("_right"), F.col("misclassified_count")
        rates = {"mean_confidence": (F.col("_sum_conf"), n), "mean_confidence_correct": (F.col("_sum_right"), right),
                 "mean_confidence_incorrect": (F.col("_sum_conf") - F.coalesce("_sum_right", F.lit(0.0)), wrong),
                 "mean_top_two_margin": (F.col("_sum_margin"), n), "low_confidence_rate": (F.col("_sum_low"), n),
                 "close_margin_rate": (F.col("_sum_close"), n), "safety_flag_rate": (F.col("_sum_flag"), n),
                 "human_review_required_rate": (F.col("_sum_review"), n)}
        wide = wide.select("*", *[F.try_divide(a, F.nullif(b, F.lit(0))).alias(m) for m, (a, b) in rates.items()])
        metrics += list(rates)
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(metrics)}, {stack}) AS (metric, value)")


# EVL-15 -----------------------------------------------------------------------
def generated_metrics(outputs: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Metrics of generated answers: the leading digit is the class, anything else is invalid and BORDERLINE."""
    parsed = outputs.select(*by, "true_label", C.parse_generated(raw).alias("_g"))
    cells = (parsed.groupBy(*by, "true_label", F.col("_g.label").alias("predicted_label"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_if("_g.invalid").alias("_sum_invalid")))
    return _measures(cells, by).select(
        *by, "n", F.col("_sum_invalid").alias("invalid_outputs"), "accuracy", "balanced_accuracy", "macro_f1",
        "weighted_f1", "unsafe_eligible_count", "unsafe_eligible_rate")


# JON-09 -----------------------------------------------------------------------
def compare(metrics: DataFrame, by: list[str], model: str = "model", base: str = "base",
            tuned: str = "tuned") -> DataFrame:
    """Base vs tuned per (by, metric) with the delta (full outer join keeps one-sided metrics)."""
    b = metrics.filter(F.col(model) == base).select(*by, "metric", F.col("value").alias("base"))
    t = metrics.filter(F.col(model) == tuned).select(*by, "metric", F.col("value").alias("tuned"))
    return b.join(t, by + ["metric"], "full_outer").withColumn("delta", F.col("tuned") - F.col("base"))


# PRJ-26 -----------------------------------------------------------------------
def finite_metrics(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Keep finite numeric metric values only, names prefixed."""
    v = F.col("value")
    return (metrics.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            .withColumn("metric", F.concat(F.lit(prefix), F.col("metric"))))
