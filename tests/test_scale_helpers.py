"""Cuts, quantiles, metrics and readers that replaced sorts, buffers and whole-file reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import datasets as D
from cohortlens.operators import dist
from cohortlens.operators import evaluate as E
from cohortlens.operators import judge as J
from cohortlens.operators import profile as P
from cohortlens.operators import scoring as S
from cohortlens.sources import files as IO
from cohortlens.sources import sinks as SNK
from cohortlens.sources.catalog import read_if_there


@pytest.mark.parametrize("n", [0, 1, 7, 50, 500])
def test_seeded_sample_takes_exactly_the_first_rows(spark, n):
    df = spark.range(0, 50).withColumn("text", F.lit("x"))
    order = [r.id for r in df.orderBy(dist.seeded_key("id", 3), "id").collect()]
    got = {r.id for r in D.seeded_sample(df, "id", 3, n).collect()}
    assert got == set(order[:n])


def test_seeded_cuts_with_null_ids_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, "a"), (3, None)], "id long, c string")
    out = D.ordered_split(df, "id", 1, 0.8)
    assert out.count() == 5
    assert out.filter("id = 1").select("split").distinct().count() == 1  # rows with one id stay together
    assert D.stratified_split(df, "id", "c", 0.4, 1).count() == 5
    assert D.ordered_split(df.limit(0), "id", 1).count() == 0


def test_splits_do_not_move_wide_rows(spark):
    df = spark.range(0, 100).select("id", (F.col("id") % 3).alias("label"), F.lit("long text").alias("text"))
    for out in (D.ordered_split(df, "id", 1), D.stratified_split(df, "id", "label", 0.1, 1)):
        physical = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in physical and "ShuffledHashJoin" not in physical


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, 37 if k == "a" else 12) / 4]
    df = spark.createDataFrame(rows + [("a", None)], "k string, v double")
    got = {r.k: r for r in dist.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    for k in ("a", "b", None):
        vals = [v for kk, v in rows if kk == k]
        for name, q in (("q1", 0.25), ("mid", 0.5), ("top", 1.0)):
            assert math.isclose(got[k][name], np.quantile(vals, q), abs_tol=1e-9)


def test_prefix_sum_totals_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("x", 1, 5)], "g string, k int, v int")
    got = {(r.g, r.k): (r.v_cum, r.v_all) for r in dist.prefix_sum(df, ["g"], [F.col("k")], ["v"],
                                                                    total_suffix="_all").collect()}
    assert got == {(None, 1): (2, 5), (None, 2): (5, 5), ("x", 1): (5, 5)}


def test_evaluate_by_hand(spark):
    rows = [(0, 0), (0, 2), (1, 1), (2, 2), (2, 1), (None, 2), (7, 0)]
    df = spark.createDataFrame([("m", t, p) for t, p in rows], "model string, true_label int, predicted_label int")
    m = {r.metric: r.value for r in E.evaluate(df, ["model"]).collect()}
    assert m["n"] == 7 and math.isclose(m["accuracy"], 3 / 7)  # rows off the grid count as wrong
    assert math.isclose(m["balanced_accuracy"], (0.5 + 1 + 0.5) / 3)
    assert (m["unsafe_eligible_count"], m["unsafe_eligible_rate"]) == (1, 0.5)
    assert m["borderline_recall"] == 1 and m["borderline_precision"] == 0.5 and m["eligible_support"] == 2
    assert E.off_grid(df).count() == 2
    assert E.evaluate(df.limit(0), ["model"]).count() == 0


def test_generated_metrics_count_invalid_answers(spark):
    df = spark.createDataFrame([("m", 0, "0 - no"), ("m", 1, "maybe"), ("m", 2, None)], "model string, true_label int, raw string")
    r = E.generated_metrics(df, ["model"]).first()
    assert (r.n, r.invalid_outputs) == (3, 2) and math.isclose(r.accuracy, 2 / 3)


def test_top_by_persons_merges_ids_with_one_name(spark):
    concept = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "concept_id long, concept_name string")
    events = spark.createDataFrame([(10, 1, 7), (11, 2, 7), (12, 3, 8), (13, 3, 9), (14, 0, 9), (15, None, 9)],
                                   "eid long, cid long, person_id long")
    got = [(r.concept_name, r.n, r.patient_count)
           for r in P.top_by_persons(events, "cid", concept, "eid", "none", 5, "n").collect()]
    assert got == [("B", 2, 2), ("A", 2, 1), ("none", 2, 1)]


def test_unit_histogram_over_more_than_one_block(spark):
    out = P.unit_histogram(spark.createDataFrame([(0,), (9000,), (9000,)], "v int"), "v")
    assert out.count() == 9001 and out.filter("n > 0").count() == 2 and out.filter("value = 9000").first().n == 2


def test_sample_shapes_and_unknown_labels(spark):
    schema = ("input string, expected_output struct<pifu_assessment: struct<eligibility: string>>, "
              "metadata map<string,string>")
    rows = [("A  b", (("eligible",),), {"document_id": "d1"}), ("A b", (("odd",),), None)]
    s = D.training_samples(spark.createDataFrame(rows, schema))
    got = s.orderBy("label").collect()
    assert (got[1].sample_id, got[1].label, got[1].label_name) == ("d1", 2, "ELIGIBLE")
    assert len(got[0].sample_id) == 16 and got[0].metadata == {}
    assert D.unknown_labels(s).count() == 1
    with pytest.raises(ValueError, match="ODD"):
        D.require_known_labels(s)
    ch = spark.createDataFrame([("x", "t", True, "Active Monitoring - Patient Initiated (PIFU)")],
                               "document_id string, document_content string, is_clock_stop boolean, clock_stop_event_type string")
    r = D.challenge_samples(ch, "edge").first()
    assert (r.label_name, r.metadata["hard_negative"], r.metadata["specialty"]) == ("ELIGIBLE", "false", None)


def test_guards_raise(spark):
    few = spark.createDataFrame([(1, 0, 1)], "id int, label int, person int")
    with pytest.raises(ValueError, match="10 rows"):
        D.check_stratified_input(few, "label")
    with pytest.raises(ValueError, match="8 groups"):
        D.check_grouped_input(few, "person", "label")
    with pytest.raises(ValueError, match="wanted"):
        D.require_rows(few, 5)
    assert D.missing_columns(few, ["id", "zz"]) == ["zz"]


def test_confusion_read_back_is_tolerant(spark, tmp_path):
    (tmp_path / "grid.csv").write_text("model,true/predicted,NO,YES,extra\nm, NO ,3.0, 1 ,x\nm,YES,oops,2,y\nm,total,9,9,z\n")
    got = {(r.true_label, r.predicted_label): r.n
           for r in SNK.read_confusion(spark, str(tmp_path / "grid.csv"), ["model"], ["NO", "YES"]).collect()}
    assert got == {(0, 0): 3, (0, 1): 1, (1, 0): None, (1, 1): 2}
    conf = spark.createDataFrame([("m", t, p, 2 * t + p) for t in (0, 1) for p in (0, 1)],
                                 "model string, true_label int, predicted_label int, n long")
    SNK.write_confusion(conf, str(tmp_path / "out"), ["model"], ["NO", "YES"])
    back = SNK.read_confusion(spark, str(tmp_path / "out"), ["model"], ["NO", "YES"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in conf.collect()}


def test_metrics_json_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", "f1", 0.5), ("a", "n", 3.0)], "model string, metric string, value double")
    SNK.write_metrics(m, str(tmp_path / "m"), ["model"])
    assert spark.read.json(str(tmp_path / "m")).first().metrics.f1 == 0.5


def test_line_number_and_missing_paths(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\nb\nb\n")
    assert IO.line_number(spark, str(tmp_path / "t.txt"), "b") == 3
    assert read_if_there(spark, str(tmp_path / "none")) is None
    (tmp_path / "empty").mkdir()
    assert read_if_there(spark, str(tmp_path / "empty")) is None


def test_report_rules_and_availability(spark):
    r = spark.createDataFrame([(1, True, True, True), (2, True, False, True), (3, False, False, None)],
                              "id int, requires_human_review boolean, human_review_required boolean, research_use_only boolean")
    assert {x.id: x.violations for x in S.check_reports(r).collect()} == {
        2: ["human_review_not_required"], 3: ["not_research_only"]}
    a = spark.createDataFrame([("fine", "good"), (J.NO_EXPLANATION, J.NO_JUDGE + " x"), (None, None)],
                              "clinical_summary string, judge_summary string")
    assert [(x.explanation_available, x.judge_available) for x in J.availability(a).collect()] == [
        (True, True), (False, False), (False, False)]


def test_label_batches_waits_between_attempts(spark):
    import time
    df = spark.createDataFrame([(1, "x")], "note_id long, text string")

    def fn(t):
        raise TimeoutError

    t0 = time.time()
    row = S.label_batches(df, fn, retries=2, base_wait=1.0).first()
    assert row.attempts == 2 and row.error_type == "TimeoutError" and time.time() - t0 >= 1.0
