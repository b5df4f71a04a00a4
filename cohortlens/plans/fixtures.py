"""Derived inputs built by Spark from the driver tables (FIXTURES §3), with
their DuckDB twins registered as oracle views.

letters        provisional-labelled notes, every non-null note with its whole text
relabel        labeller results: labels.quality for letters with a label row,
               unresolved otherwise (api_failure when note_id % 5 = 0)
samples3       three-class samples: labelled documents, truth toxic -> 0,
               quality -> 2, else 1
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.keywords import CORPUS_NEGATIVE, CORPUS_POSITIVE
from cohortlens.plans.oracle_views import register_view


def _hits_sql(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(instr(lower({col}), '{w.lower()}') > 0 AS INTEGER)"
                            for w in dict.fromkeys(words)) + ")"


def letters(cdm):
    n = cdm.note.filter(F.col("note_text").isNotNull())
    return n.select("note_id", "person_id", F.col("note_date").cast("string").alias("note_date"),
                    F.col("note_text").alias("text"),
                    C.provisional_label("note_text", CORPUS_POSITIVE, CORPUS_NEGATIVE).alias("label"))


register_view("letters", ["note"], f"""
  SELECT note_id, person_id, CAST(note_date AS VARCHAR) AS note_date, note_text AS text,
         CAST(CASE WHEN {_hits_sql('note_text', CORPUS_POSITIVE)} > {_hits_sql('note_text', CORPUS_NEGATIVE)} THEN 1
                   WHEN {_hits_sql('note_text', CORPUS_NEGATIVE)} > {_hits_sql('note_text', CORPUS_POSITIVE)} THEN 0
              END AS INTEGER) AS label
  FROM note WHERE note_text IS NOT NULL""")


def relabel_results(cdm):
    lab = cdm.raw("labels").select(F.col("doc_id").alias("note_id"), F.col("quality"))
    j = letters(cdm).select("note_id").join(lab, "note_id", "left")
    missing = F.col("quality").isNull()
    failed = missing & (F.col("note_id") % 5 == 0)
    return j.select("note_id", F.when(missing, "unresolved").otherwise("resolved").alias("status"),
                    F.col("quality").cast("int").alias("label"), failed.alias("label_failed"),
                    F.when(failed, "timeout").alias("error_type"))


register_view("relabel", ["letters"], """
  SELECT l.note_id, CASE WHEN lb.quality IS NULL THEN 'unresolved' ELSE 'resolved' END AS status,
         CAST(lb.quality AS INTEGER) AS label, (lb.quality IS NULL AND l.note_id % 5 = 0) AS label_failed,
         CASE WHEN lb.quality IS NULL AND l.note_id % 5 = 0 THEN 'timeout' END AS error_type
  FROM letters l LEFT JOIN labels lb ON l.note_id = lb.doc_id""")


def samples3(cdm):
    lab = cdm.raw("labels")
    docs = cdm.raw("documents").select("doc_id", "text", "n_chars")
    truth = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).cast("int")
    return (lab.join(docs, "doc_id", "inner")
            .select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "text", "n_chars",
                    truth.alias("label"), C.label_name(truth).alias("label_name"),
                    F.lit("documents").alias("source")))


register_view("samples3", [], """
  SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, d.doc_id, d.text, d.n_chars,
         CAST(CASE WHEN lb.toxic = 1 THEN 0 WHEN lb.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS label,
         CASE WHEN lb.toxic = 1 THEN 'NOT_ELIGIBLE' WHEN lb.quality = 1 THEN 'ELIGIBLE' ELSE 'BORDERLINE' END
           AS label_name, 'documents' AS source
  FROM labels lb JOIN documents d ON lb.doc_id = d.doc_id""")
