"""Edge-case and invariant tests of single operators on small hand-made frames."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import datasets as D
from cohortlens.operators import dist
from cohortlens.operators import evaluate as E
from cohortlens.operators import profile as P
from cohortlens.operators import scoring as S


def test_histogram_all_equal_and_last_bin_closed(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),), (None,)], "v double")
    rows = P.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [0, 0, 2, 0]  # NumPy puts equal values in the middle bin
    df2 = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double")
    rows2 = P.histogram(df2, "v", 2).orderBy("bin").collect()
    assert [r.n for r in rows2] == [1, 2]  # max falls in the last (closed) bin


def test_modal_value_tie_lowest_and_blank_ignored(spark):
    df = spark.createDataFrame([("a", "mg"), ("a", "kg"), ("a", " "), ("a", None)], "k string, u string")
    assert P.modal_value(df, "u", ["k"]).first()["modal_u"] == "kg"


def test_iqr_fence_zero_iqr_keeps_all(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 100.0)], "k string, v double")
    assert P.iqr_fence(df, "v", ["k"]).count() == 6
    df2 = spark.createDataFrame([("a", float(x)) for x in range(1, 9)] + [("a", 1000.0)], "k string, v double")
    assert P.iqr_fence(df2, "v", ["k"]).filter("v = 1000").count() == 0




def test_age_and_count_bands(spark):
    df = spark.createDataFrame([(17,), (18,), (75,), (None,)], "a int")
    got = [r[0] for r in df.select(C.age_band("a")).collect()]
    assert got == ["0–17", "18–29", "75+", None]
    df = spark.createDataFrame([(0,), (3,), (4,), (10,)], "n int")
    assert [r[0] for r in df.select(C.count_band("n")).collect()] == [
        "0 conditions", "3–4 conditions", "3–4 conditions", "10+ conditions"]


def test_word_count_and_hash(spark):
    df = spark.createDataFrame([("  Hello \n  World\t ",)], "t string")
    r = df.select(C.word_count("t").alias("w"), C.norm_hash("t").alias("h")).first()
    import hashlib
    assert r.w == 2
    assert r.h == hashlib.sha256(b"hello world").hexdigest()


def test_parsers(spark):
    df = spark.createDataFrame([(" 1 ",), ("u",), ("2x",), ("x",)], "r string")
    rows = df.select(C.parse_strict("r").alias("s"), C.parse_int01("r").alias("i"),
                     C.parse_generated("r").alias("g"), C.parse_binary("r").alias("b")).collect()
    assert [r.s for r in rows] == [1, None, -1, -1]
    assert [r.i for r in rows] == [1, None, None, None]
    assert [(r.g.label, r.g.invalid) for r in rows] == [(1, False), (1, True), (2, False), (1, True)]
    assert [r.b for r in rows] == [1, 0, 0, 0]


def test_softmax_argmax_first_max_and_margin(spark):
    df = spark.createDataFrame([([0.0, 0.0, -1.0],)], "s array<double>")
    r = S.decide(df.withColumn("probs", C.softmax("s")), "probs").first()
    assert r.predicted_label == 0 and r.top_two_margin == 0.0
    assert math.isclose(sum(r.probs), 1.0)


def test_review_flags_and_checks(spark):
    df = spark.createDataFrame([([0.5, 0.45, 0.05],)], "probs array<double>")
    d = S.review_flags(S.decide(df, "probs"))
    r = d.first()
    assert r.safety_flag_count == 2 and r.requires_human_review
    assert "below 0.80" in r.review_reason
    bad = d.withColumn("probs", F.array(F.lit(0.5), F.lit(0.4), F.lit(0.09)))
    v = S.check_predictions(bad, "probs").first()
    assert "probabilities_do_not_sum_to_one" in v.violations


def test_confusion_keeps_zero_cells_and_policies(spark):
    rows = [("m", 0, 0), ("m", 0, 2), ("m", 2, 2), ("m", 2, 1)]  # class 1 has no support but is predicted
    df = spark.createDataFrame(rows, "model string, true_label int, predicted_label int")
    conf = E.confusion(df, ["model"])
    assert conf.count() == 9 and conf.filter("n = 0").count() == 5
    pc = E.per_class(conf, ["model"])
    ov = E.overall(pc, ["model"]).first()
    assert ov.accuracy == 0.5
    assert ov.balanced_accuracy == pytest.approx(0.5)      # only supported classes 0 and 2
    assert ov.macro_f1 == pytest.approx((2 / 3 + 0 + 0.5) / 3)  # class 1 present in predictions
    us = E.unsafe(df, ["model"]).first()
    assert us.unsafe_eligible_count == 1 and us.unsafe_eligible_rate == 0.5


def test_auc_ap_match_bruteforce(spark):
    import random
    rnd = random.Random(7)
    data = [("g", round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, score double, label int")
    curve = E.score_curve(df, ["g"])
    auc = E.roc_auc(curve, ["g"]).first().roc_auc
    ap = E.average_precision(curve, ["g"]).first().average_precision
    pos = [s for _, s, y in data if y == 1]
    neg = [s for _, s, y in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)
    thresholds = sorted({s for _, s, _ in data}, reverse=True)
    P_, ap_b, prev_r = len(pos), 0.0, 0.0
    for t in thresholds:
        tp = sum(1 for _, s, y in data if s >= t and y == 1)
        fp = sum(1 for _, s, y in data if s >= t and y == 0)
        r = tp / P_
        ap_b += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert ap == pytest.approx(ap_b)


def test_auc_null_with_one_class(spark):
    df = spark.createDataFrame([("g", 0.3, 1), ("g", 0.4, 1)], "g string, score double, label int")
    assert E.roc_auc(E.score_curve(df, ["g"]), ["g"]).first().roc_auc is None


def test_threshold_rules(spark):
    pr = spark.createDataFrame([("m", 0.2, 0.5, 1.0), ("m", 0.4, 0.6, 0.96), ("m", 0.6, 0.6, 0.95),
                                ("m", 0.8, 1.0, 0.5)], "model string, threshold double, precision double, recall double")
    r = E.select_threshold(pr, ["model"]).first()
    assert (r.threshold, r.rule) == (0.4, "min_recall")   # tie on precision -> lowest threshold
    pr2 = pr.filter("threshold = 0.8")
    assert E.select_threshold(pr2, ["model"]).first().rule == "f2"


def test_dist_rank_and_prefix_sum_equal_plain_window(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("id"))
    ranked = dist.dist_rank(df, [F.col("k"), F.col("id")], "r", partitions=5)
    plain = df.withColumn("r2", F.row_number().over(Window.orderBy("k", "id")))
    assert ranked.join(plain, ["k", "id"]).filter("r <> r2").count() == 0
    g = df.select((F.col("id") % 3).alias("g"), "k", F.lit(1).alias("v")).groupBy("g", "k").agg(F.sum("v").alias("v"))
    ps = dist.prefix_sum(g, ["g"], [F.col("k")], ["v"], partitions=4)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = g.withColumn("v2", F.sum("v").over(w))
    assert ps.join(ref, ["g", "k"]).filter("v_cum <> v2").count() == 0


def test_top_k_per_group_hot_key(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") < 1000, 0).otherwise(1 + F.col("id") % 50).alias("g"), "id")
    out = dist.top_k_per_group(df, ["g"], [F.col("id").desc()], 3, salt_by="id")
    assert out.filter("g = 0").orderBy("rank").select("id").collect()[0][0] == 999
    assert out.groupBy("g").count().filter("count <> 3").count() == 0


def test_stratified_split_quotas_exact(spark):
    rows = [(str(i), 0 if i < 60 else (1 if i < 90 else 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "sid string, label int")
    out = D.stratified_split(df, "sid", "label", 0.1, 42)
    got = {(r.label): r["count"] for r in out.filter("split = 'validation'").groupBy("label").count().collect()}
    assert got == {0: 6, 1: 3, 2: 1}
    assert out.count() == 100


def test_grouped_split_no_leakage(spark):
    rows = [(i, i % 23, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "note_id long, person_id long, label int")
    out = D.grouped_split(df, "person_id", "label")
    assert D.leaks(out, "person_id").count() == 0
    assert set(r.split for r in out.select("split").distinct().collect()) == {"train", "validation", "test"}
    assert out.count() == 300


def test_seeded_sample_reproducible(spark):
    df = spark.range(0, 1000)
    a = [r.id for r in D.seeded_sample(df, "id", 42, 10).collect()]
    b = [r.id for r in D.seeded_sample(df, "id", 42, 10).collect()]
    assert a == b and len(set(a)) == 10


def test_last_record_and_merge(spark):
    log = spark.createDataFrame([(1, 1, "unresolved"), (1, 2, "resolved"), (2, 1, "resolved")],
                                "note_id long, seq int, status string")
    last = {r.note_id: r.status for r in D.last_record(log, "note_id", "seq").collect()}
    assert last == {1: "resolved", 2: "resolved"}
    letters = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "note_id long, label int")
    results = spark.createDataFrame([(1, "resolved", 1, False, None), (2, "resolved", 0, False, None),
                                     (3, "unresolved", None, True, "Timeout")],
                                    "note_id long, status string, label int, label_failed boolean, error_type string")
    res, un = D.merge_labels(letters, results)
    ch = {r.note_id: r.label_changed for r in res.collect()}
    assert ch == {1: True, 2: False}
    assert un.first().unresolved_reason == "api_failure"


def test_remove_overlap_line_level(spark):
    train = spark.createDataFrame([(1, "a\nShared  LINE"), (2, "other"), (3, "\n\n")], "doc_id long, text string")
    test = spark.createDataFrame([("shared line\nx",)], "text string")
    kept = sorted(r.doc_id for r in D.remove_overlap(train, test, level="line").collect())
    assert kept == [2, 3]


def test_run_status_words(spark):
    from cohortlens.operators import runs as RU
    rows = [(1, "succeeded"), (1, "failed"), (2, "failed"), (2, "skipped"), (3, "succeeded"), (3, "skipped")]
    got = {r.run_id: r.run_status for r in RU.run_status(spark.createDataFrame(rows, "run_id int, status string")).collect()}
    assert got == {1: "partial_success", 2: "failed", 3: "success"}


def test_response_lines_trim_and_empty(spark):
    from cohortlens.operators import runs as RU
    df = spark.createDataFrame([("a\nb\n",), ("",), (None,), ("x\r\ny",), ("  one ",)], "response string")
    assert [r.response_lines for r in RU.response_lines(df).collect()] == [2, None, None, 2, 1]


def test_specialty_and_generated_parsers(spark):
    df = spark.createDataFrame([(" General  Surgery ", None), ("ear-nose", "2 yes"), ("x", "no")], "s string, g string")
    got = df.select(C.normalise_specialty("s").alias("s"), C.parse_generated("g").alias("g")).collect()
    assert [r.s for r in got] == ["general__surgery", "ear_nose", "x"]
    assert [(r.g.label, r.g.invalid) for r in got] == [(1, True), (2, False), (1, True)]


def test_splits_keep_rows_without_label_or_group(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2, None if i % 5 == 0 else i % 11) for i in range(60)],
                               "id int, label int, person int")
    assert D.stratified_split(df, "id", "label", 0.2, 1).count() == 60
    assert D.grouped_split(df, "person", "label", 1).count() == 60


def test_history_limit_is_not_changed_in_silence(spark):
    from cohortlens.operators import records as REC
    from cohortlens.sources.cdm import Cdm
    cdm = Cdm(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        REC.history(cdm.tables(), "measurements", None, limit=5000)


def test_histogram_ignores_infinity(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),)], "v double")
    assert [r.n for r in P.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 1]


def test_metric_and_log_readers(spark, tmp_path):
    from cohortlens.sources import files as FL
    (tmp_path / "base_external_metrics.json").write_text('{"f1": 0.5, "note": "x", "n": 3}')
    (tmp_path / "bad_metrics.json").write_text("{")
    got = {(r.dataset, r.model, r.split, r.metric, r.value)
           for r in FL.collect_metric_files(spark, f"{tmp_path}/*_metrics.json").collect()}
    assert {g[1:] for g in got} == {("base", "external_test", "f1", 0.5), ("base", "external_test", "n", 3.0)}
    log = "BASE MODEL Results:\n  F1 : 0.7\n  ROC AUC : 0.6\n======\nCOMPARISON\n  F1 : 0.9\n"
    (tmp_path / "run.log").write_text(log)
    rows = FL.extract_log_metrics(FL.read_logs(spark, f"{tmp_path}/run.log")).collect()
    assert {(r.section, r.metric, r.value) for r in rows} == {("BASE MODEL", "f1", 0.7), ("BASE MODEL", "roc_auc", 0.6)}
    assert all(r.source.endswith("run.log") for r in rows)


def test_json_list_is_strict(spark, tmp_path):
    from pyspark.sql import types as T
    from cohortlens.sources import files as FL
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    for name, text in (("o", '{"a": 1}'), ("b", '[{"a": 1'), ("e", "[]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            FL.read_json_list(spark, str(tmp_path / name), schema)
    (tmp_path / "g").write_text(' [{"a": 1}, {"a": 2}]')
    assert FL.read_json_list(spark, str(tmp_path / "g"), schema).count() == 2
