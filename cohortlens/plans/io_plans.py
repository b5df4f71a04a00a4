"""Registered cores of the readers and sinks (SRC-02..10, SNK-01..04) and of small
column operators (PRJ-11/20, AGG-23 totals, binary JON-09).

The file wrappers are thin; what they compute is run here on text and rows that
Spark derives from the given tables, with planted faults chosen by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import columns as C
from cohortlens.operators import evaluate as E
from cohortlens.operators import judge as J
from cohortlens.operators import runs as RU
from cohortlens.operators import scoring as S
from cohortlens.functions.keywords import ROUTINE_KEYWORDS, TREATMENT_KEYWORDS
from cohortlens.plans import fixtures as FX
from cohortlens.plans.dataset_plans import _hits
from cohortlens.plans.evaluation_plans import BY, bscores, cases3
from cohortlens.plans.oracle_views import with_views
from cohortlens.plans.registry import query
from cohortlens.plans.run_plans import _STEPS_SQL, steps
from cohortlens.sources import catalog as CAT
from cohortlens.sources import files as FILES
from cohortlens.sources import sinks as SNK
from cohortlens.session import checkpoint_dir

R = C.round6


# ---------------------------------------------------------------- SRC
@query("src_04_json_lines", """
  SELECT conv_id, turn, CASE WHEN conv_id % 10 <> 0 THEN role END AS role,
         CASE WHEN conv_id % 10 <> 0 THEN sha256(text) END AS text_hash, conv_id % 10 = 0 AS broken FROM conversations""")
def src_04(cdm):
    """Strict JSON lines: fields of every good line, broken lines (every tenth conversation is cut short) reported."""
    line = F.to_json(F.struct("role", "text"))
    lines = cdm.raw("conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 10 == 0, F.substring(line, 1, 7)).otherwise(line).alias("line"))
    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    out = FILES.json_lines(lines, "line", schema)
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"), "broken")


@query("src_05_json_lists", """
  SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN role END AS role, sha256(text) AS text_hash FROM conversations""")
def src_05(cdm):
    """JSON lists written from all conversations and read back by byte ranges (every fourth role is null)."""
    rows = cdm.raw("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("role"), "text")
    folder = f"{checkpoint_dir(cdm.spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    SNK.write_json_lists(rows, folder, files=4)
    return FILES.read_json_list(cdm.spark, folder, rows.schema).select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


@query("src_06_split_violations", with_views("""
  SELECT sample_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_text' WHEN doc_id % 7 = 0 THEN 'missing_label'
                         ELSE 'label_not_allowed' END AS violation
  FROM samples3 WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0""", "samples3"))
def src_06(cdm):
    """Samples of a split payload without text, without label or with a label that is not allowed (planted)."""
    k = F.col("doc_id")
    s = FX.samples3(cdm).select(
        "sample_id", F.when(k % 11 != 0, F.col("text")).alias("text"),
        F.when(k % 7 == 0, F.lit(None).cast("int")).when(k % 5 == 0, F.lit(9)).otherwise(F.col("label")).alias("label"))
    return FILES.split_violations(s, [0, 1, 2]).select("sample_id", "violation")


@query("src_08_metric_rows", """
  SELECT doc_id, 'quality' AS metric, CAST(quality AS DOUBLE) AS value FROM labels
  UNION ALL SELECT doc_id, 'toxic_rate', toxic / 4.0 FROM labels""")
def src_08(cdm):
    """Numeric entries of metric JSON as rows; text entries are left out, flat and wrapped objects alike."""
    flat = F.to_json(F.struct(F.col("quality").alias("quality"), (F.col("toxic") / 4.0).alias("toxic_rate"),
                              F.lit("a note").alias("remark")))
    wrapped = F.concat(F.lit('{"metrics":'), flat, F.lit("}"))
    texts = cdm.raw("labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, flat).otherwise(wrapped).alias("value"))
    return FILES.flat_metrics(texts)


@query("src_09_log_metrics", """
  SELECT CAST(doc_id AS VARCHAR) AS source, 'BASE MODEL' AS section, 'f1' AS metric, CAST(quality + 0.25 AS DOUBLE) AS value FROM labels
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'FINE-TUNED MODEL', 'roc_auc', CAST(toxic + 0.5 AS DOUBLE) FROM labels""")
def src_09(cdm):
    """Metrics per model section of evaluation logs; the comparison block belongs to no model."""
    q, t = [(F.col(c) + x).cast("double").cast("string") for c, x in (("quality", 0.25), ("toxic", 0.5))]
    log = F.concat(F.lit("started\nBASE MODEL Results:\n  F1 : "), q, F.lit("\nFINE-TUNED MODEL Results:\n  ROC AUC: "), t,
                   F.lit("\n======\nCOMPARISON\n  F1 : 0.9\n"))
    return FILES.extract_log_metrics(cdm.raw("labels").select(F.col("doc_id").cast("string").alias("source"),
                                                              log.alias("value")))


@query("src_10_checksums", """
  SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS length FROM pages""")
def src_10(cdm):
    """SHA-256 and byte length of every page's content."""
    return FILES.checksums(cdm.raw("pages").select("page_id", "html"), "html")


@query("src_02_required_tables", """
  SELECT 'documents' AS table_name, true AS present, CAST(5 AS INTEGER) AS n_columns, CAST(count(*) AS BIGINT) AS n_rows FROM documents
  UNION ALL SELECT 'labels', true, 3, CAST(count(*) AS BIGINT) FROM labels
  UNION ALL SELECT 'person', false, NULL, NULL""")
def src_02(cdm):
    """Required tables of a folder: those that are missing (``person``), columns and rows of the others."""
    return CAT.table_report({n: cdm.raw(n) for n in ("documents", "labels")}, ["documents", "labels", "person"])


@query("src_03_table_list", " UNION ALL ".join(f"""
  SELECT '{t}' AS table_name, true AS present,
         (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns, CAST(count(*) AS BIGINT) AS n_rows FROM {t}"""
                                               for t in ("customer", "events", "nation", "orders", "region")))
def src_03(cdm):
    """Listed tables with their columns and rows."""
    names = ["customer", "events", "nation", "orders", "region"]
    return CAT.table_report(CAT.load_tables(cdm.spark, cdm.sf_dir, names, register=False), [])


@query("src_07_required_inputs", """
  WITH f AS (SELECT 'runs/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '/' || role || '.json' AS path,
                    role || '.json' AS name FROM conversations)
  SELECT w.name, CAST(count(f.path) AS BIGINT) AS n, min(f.path) AS path
  FROM (VALUES ('user.json'), ('assistant.json'), ('metrics.json')) w(name) LEFT JOIN f ON f.name = w.name GROUP BY 1""")
def src_07(cdm):
    """How often each required file name occurs among many paths (one of them nowhere)."""
    path = F.concat(F.lit("runs/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("/"),
                    F.col("role"), F.lit(".json"))
    return FILES.input_matches(cdm.raw("conversations").select(path.alias("path")),
                               ["user.json", "assistant.json", "metrics.json"])


@query("src_08_path_tags", """
  WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data/PIFU/' ELSE 'data/letters_base/' END
               || CASE doc_id % 5 WHEN 0 THEN 'challenge_base' WHEN 1 THEN 'external' WHEN 2 THEN 'Base' ELSE 'tuned' END
               || '_metrics.json' AS source FROM labels)
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pifu' ELSE 'original' END AS dataset,
         CASE WHEN doc_id % 5 IN (0, 2) THEN 'base' ELSE 'fine_tuned' END AS model,
         CASE doc_id % 5 WHEN 0 THEN 'challenge' WHEN 1 THEN 'external_test' ELSE 'test' END AS split FROM f""")
def src_08_tags(cdm):
    """Dataset, model and split of metric files, from their paths."""
    k3, k5 = F.col("doc_id") % 3, F.col("doc_id") % 5
    name = F.when(k5 == 0, "challenge_base").when(k5 == 1, "external").when(k5 == 2, "Base").otherwise("tuned")
    source = F.concat(F.when(k3 == 0, "data/PIFU/").otherwise("data/letters_base/"), name, F.lit("_metrics.json"))
    files = cdm.raw("labels").select("doc_id", source.alias("source"))
    return FILES.tag_paths(files, "source").select("doc_id", "dataset", "model", "split")


@query("src_09_log_bundles", """
  SELECT 'original' AS dataset, 'base' AS model, 'test' AS split, CAST(doc_id AS VARCHAR) AS source, 'f1' AS metric,
         CAST(quality + 0.25 AS DOUBLE) AS value FROM labels
  UNION ALL SELECT 'original', 'fine_tuned', 'test', CAST(doc_id AS VARCHAR), 'macro_f1', CAST(toxic + 0.5 AS DOUBLE) FROM labels""")
def src_09_bundles(cdm):
    """Tagged metrics of the two models in evaluation logs; the first of a repeated metric counts, other lines do not."""
    q, t = [(F.col(c) + x).cast("double").cast("string") for c, x in (("quality", 0.25), ("toxic", 0.5))]
    log = F.concat(F.lit("F1 : 0.1\nBASE MODEL Results:\n  F1 : "), q, F.lit(" (best)\n  F1 : 0.3\n  Loss : 2\nFINE-TUNED MODEL Results:\n"
                   "  Macro F1: "), t, F.lit("\nOTHER Results:\n  Recall : 1.0\n"))
    logs = cdm.raw("labels").select(F.col("doc_id").cast("string").alias("source"), log.alias("value"))
    return FILES.collect_log_metrics(logs)


# ---------------------------------------------------------------- SNK
@query("snk_02_case_rows", with_views("""
  SELECT sample_id, label_name, CASE WHEN doc_id % 3 = 0 THEN 'long text | checked' WHEN doc_id % 3 = 1 THEN 'checked' ELSE '' END AS flags
  FROM samples3""", "samples3"))
def snk_02(cdm):
    """Rows of a case file: a fixed column list, flags joined into one text."""
    k = F.col("doc_id") % 3
    flags = F.when(k == 0, F.array(F.lit("long text"), F.lit("checked"))).when(k == 1, F.array(F.lit("checked"))).otherwise(
        F.array().cast("array<string>"))
    return SNK.case_rows(FX.samples3(cdm).withColumn("flags", flags), ["sample_id", "label_name", "flags"])


@query("snk_01_manifest", with_views("""
  , s AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, label FROM samples3)
  SELECT split, CAST(sum(n) AS BIGINT) AS n_samples,
         string_agg(CAST(label AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY label) AS class_counts
  FROM (SELECT split, label, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1""", "samples3"))
def snk_01(cdm):
    """Manifest of written splits: samples and class counts."""
    s = FX.samples3(cdm).select(F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"), "label")
    m = SNK.split_manifest(s, {str(i): n for i, n in enumerate(C.LABEL_NAMES)})
    pairs = F.transform(F.array_sort(F.map_entries("class_counts")),
                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("split", "n_samples", F.array_join(pairs, ",").alias("class_counts"))


@query("snk_03_confusion_grid", with_views("""
  SELECT model, split, CASE true_label WHEN 0 THEN 'NOT_ELIGIBLE' WHEN 1 THEN 'BORDERLINE' ELSE 'ELIGIBLE' END AS "true/predicted",
         CAST(sum(n) FILTER (WHERE predicted_label = 0) AS BIGINT) AS "NOT_ELIGIBLE",
         CAST(sum(n) FILTER (WHERE predicted_label = 1) AS BIGINT) AS "BORDERLINE",
         CAST(sum(n) FILTER (WHERE predicted_label = 2) AS BIGINT) AS "ELIGIBLE"
  FROM conf3 GROUP BY model, split, true_label""", "conf3"))
def snk_03(cdm):
    """Confusion counts as the labelled grid that is written."""
    return SNK.confusion_grid(E.confusion(cases3(cdm), BY), BY, list(C.LABEL_NAMES))


@query("snk_04_nested_metrics", with_views("""
  SELECT o.model, o.split, round(o.accuracy, 6) AS accuracy, round(o.weighted_f1, 6) AS weighted_f1,
         u.unsafe_eligible_count::DOUBLE AS unsafe FROM ov3 o JOIN us3 u ON o.model = u.model AND o.split = u.split""",
                                           "ov3", "us3"))
def snk_04(cdm):
    """Metrics as one map per (model, split), as written to JSON; three of them read back."""
    m = SNK.nested_metrics(E.evaluate(cases3(cdm), BY), BY)
    at = lambda name: F.element_at("metrics", F.lit(name))
    return m.select(*BY, R(at("accuracy")).alias("accuracy"), R(at("weighted_f1")).alias("weighted_f1"),
                    at("unsafe_eligible_count").alias("unsafe"))


# ---------------------------------------------------------------- AGG-23 / PRJ-11 / PRJ-20 / JON-09
@query("agg_23_step_totals", f"""
  SELECT run_id, CAST(count(*) AS BIGINT) AS steps, round(sum(duration_seconds), 6) AS total_seconds
  FROM ({_STEPS_SQL}) WHERE status <> 'skipped' GROUP BY 1""")
def agg_23_totals(cdm):
    """Steps and seconds per run, skipped steps left out."""
    return RU.step_totals(steps(cdm)).withColumn("total_seconds", R("total_seconds"))


@query("prj_11_shortened", r"""
  SELECT doc_id, CASE WHEN length(t) <= 60 THEN t
      WHEN substr(t, 58, 1) = ' ' THEN rtrim(left(t, 57)) || '...'
      ELSE rtrim(regexp_replace(left(t, 57), '\S*$', '')) || '...' END AS short_text
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def prj_11_short(cdm):
    """Texts shortened to 60 characters at a word's end."""
    return cdm.raw("documents").select("doc_id", C.shorten("text", 60).alias("short_text"))


@query("prj_20_summed_logprobs", """
  SELECT doc_id, k AS candidate, -(doc_id % 7) - (n_chars % (k + 2)) / 2.0 - k AS score
  FROM documents, (VALUES (0), (1), (2)) c(k)""")
def prj_20_sums(cdm):
    """Candidate score: the sum of its tokens' log-probabilities."""
    number = lambda c: c.cast("double")
    tokens = F.array(*[F.array(number(-(F.col("doc_id") % 7)), -(F.col("n_chars") % (k + 2)) / 2.0, F.lit(-float(k)))
                       for k in range(3)])
    d = cdm.raw("documents").select("doc_id", F.posexplode(C.sum_logprobs(tokens)).alias("candidate", "score"))
    return d


@query("jon_09_compare_binary", with_views("""
  , c AS (SELECT model, split, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp,
                 count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
                 count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) AS n FROM bscores GROUP BY 1, 2),
  m AS (SELECT model, split, 'precision' AS metric, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS value FROM c
        UNION ALL SELECT model, split, 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END FROM c
        UNION ALL SELECT model, split, 'accuracy', (n - fp - fn) / n FROM c)
  SELECT b.split, b.metric, round(b.value, 6) AS base, round(t.value, 6) AS tuned, round(t.value - b.value, 6) AS delta
  FROM m b JOIN m t ON b.split = t.split AND b.metric = t.metric AND b.model = 'base' AND t.model = 'tuned'""", "bscores"))
def jon_09_binary(cdm):
    """Base against tuned model on the binary metrics at threshold 0.5."""
    cases = bscores(cdm).select(*BY, F.col("label").alias("true_label"),
                                (F.col("score") >= E.DEFAULT_THRESHOLD).cast("int").alias("predicted_label"))
    names = ["precision", "recall", "accuracy"]
    long = E.binary_suite(cases, BY).selectExpr(
        *BY, f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") AS (metric, value)")
    out = E.compare(long, ["split"])
    return out.select("split", "metric", R("base").alias("base"), R("tuned").alias("tuned"), R("delta").alias("delta"))


# ---------------------------------------------------------------- PRJ-12 / PRJ-22 / PRJ-25
@query("prj_12_clinical_labels", f"""
  SELECT doc_id, CAST({_hits(TREATMENT_KEYWORDS)} AS INTEGER) AS treatment_hits,
         CAST({_hits(ROUTINE_KEYWORDS)} AS INTEGER) AS routine_hits,
         CAST(CASE WHEN ({_hits(TREATMENT_KEYWORDS)}) > ({_hits(ROUTINE_KEYWORDS)}) THEN 1
                   WHEN ({_hits(ROUTINE_KEYWORDS)}) > ({_hits(TREATMENT_KEYWORDS)}) THEN 0 END AS INTEGER) AS label
  FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' {TREATMENT_KEYWORDS[0]}' WHEN doc_id % 3 = 1
                                    THEN ' {ROUTINE_KEYWORDS[0]}' ELSE '' END AS text FROM documents)""")
def prj_12_clinical(cdm):
    """Provisional label by the clinical keyword lists (one keyword planted in two of three documents)."""
    k = F.col("doc_id") % 3
    planted = (F.when(k == 0, f" {TREATMENT_KEYWORDS[0]}").when(k == 1, f" {ROUTINE_KEYWORDS[0]}").otherwise(""))
    d = cdm.raw("documents").select("doc_id", F.concat("text", planted).alias("text"))
    return d.select("doc_id", C.keyword_hits("text", TREATMENT_KEYWORDS).alias("treatment_hits"),
                    C.keyword_hits("text", ROUTINE_KEYWORDS).alias("routine_hits"),
                    C.provisional_label("text", TREATMENT_KEYWORDS, ROUTINE_KEYWORDS).alias("label"))


@query("prj_22_report_checks", with_views("""
  SELECT sample_id, model, concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'human_review_not_required' END,
                                     CASE WHEN doc_id % 9 = 0 THEN 'not_research_only' END) AS violations
  FROM cases3 WHERE doc_id % 6 = 0 OR doc_id % 9 = 0""", "cases3"))
def prj_22_reports(cdm):
    """Reports without the required human review or the research-only mark (planted)."""
    c = cases3(cdm).select("sample_id", "model", "requires_human_review",
                           (F.col("doc_id") % 6 != 0).alias("human_review_required"),
                           (F.col("doc_id") % 9 != 0).alias("research_use_only"))
    return S.check_reports(c).select("sample_id", "model", F.array_join("violations", ",").alias("violations"))


@query("prj_25_availability", with_views("""
  SELECT sample_id, model, doc_id % 8 <> 0 AND doc_id % 5 <> 0 AS explanation_available, doc_id % 7 <> 0 AS judge_available
  FROM cases3""", "cases3"))
def prj_25_availability(cdm):
    """Explanations and judgements that are real, by the texts that stand for missing ones."""
    k = F.col("doc_id")
    c = cases3(cdm).select(
        "sample_id", "model",
        F.when(k % 8 == 0, J.NO_EXPLANATION).when(k % 5 != 0, F.lit("A summary.")).alias("clinical_summary"),
        F.when(k % 7 == 0, J.NO_JUDGE + " timeout").otherwise("Well grounded.").alias("judge_summary"))
    return J.availability(c).select("sample_id", "model", "explanation_available", "judge_available")
