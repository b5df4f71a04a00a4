"""Registered streaming query (STR-01): the labelling stream over the given documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens.operators import scoring as S
from cohortlens.plans.evaluation_plans import stub_labeller
from cohortlens.plans.registry import query
from cohortlens.session import checkpoint_dir
from cohortlens.streaming import labelling as L


@query("str_01_label_stream", f"""
  WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS note_id, text, length(text) AS n FROM documents),
  g AS (SELECT DISTINCT note_id, n FROM d WHERE note_id IS NOT NULL AND text IS NOT NULL)
  SELECT note_id AS doc_id, CASE WHEN n % 13 = 0 OR n % 5 = 0 THEN 'unresolved' ELSE 'resolved' END AS status,
         CAST(CASE WHEN n % 13 <> 0 AND n % 5 <> 0 THEN n % 2 END AS INTEGER) AS label,
         CASE WHEN n % 13 = 0 THEN 'api_failure' WHEN n % 5 = 0 THEN 'labeller_uncertain' END AS reason,
         CAST(CASE WHEN n % 13 = 0 THEN {S.MAX_LABEL_ATTEMPTS} ELSE 1 END AS INTEGER) AS attempts FROM g
  UNION ALL
  SELECT doc_id, 'violation', NULL, CASE WHEN note_id IS NULL THEN 'missing_id' ELSE 'missing_text' END, NULL
  FROM d WHERE note_id IS NULL OR text IS NULL""")
def str_01(cdm):
    """Stream of all documents as letters (every 17th id is lost): results per note, and the rows without id or text."""
    docs = cdm.raw("documents").schema
    letters = (cdm.spark.readStream.schema(docs).parquet(f"{cdm.sf_dir}/documents.parquet*")  # a file or a folder
               .select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("doc_id")).alias("note_id"), "text"))
    folder = f"{checkpoint_dir(cdm.spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    L.label_letters(letters, f"{folder}/out", f"{folder}/progress", stub_labeller, base_wait=0).awaitTermination()
    done = L.read_results(cdm.spark, f"{folder}/out").select(
        F.col("note_id").alias("doc_id"), "status", "label", F.col("unresolved_reason").alias("reason"), "attempts")
    bad = L.read_violations(cdm.spark, f"{folder}/out").select(
        "doc_id", F.lit("violation").alias("status"), F.lit(None).cast("int").alias("label"), "reason",
        F.lit(None).cast("int").alias("attempts"))
    return done.unionByName(bad)
