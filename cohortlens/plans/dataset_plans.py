"""Registered dataset-building queries (PRJ-09..18, WIN-07..13, JON-06..08, SET, AGG-20/24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.keywords import CORPUS_NEGATIVE, CORPUS_POSITIVE, CONDITION_SPECIALTY_MAP, \
    CORPUS_SPECIALTY_MAP
from cohortlens.operators import datasets as D
from cohortlens.operators import splits as SPL
from cohortlens.plans import fixtures as FX
from cohortlens.plans.oracle_views import with_views
from cohortlens.plans.registry import query

SEED = D.SEED
_KEY = "sha256('{seed}:' || CAST({col} AS VARCHAR))"


def _key(col: str, seed: int = SEED) -> str:
    return _KEY.format(seed=seed, col=col)


# ---------------------------------------------------------------- PRJ-09..18
@query("prj_09_text_hashes", """
  SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS norm_hash, sha256(text) AS raw_hash
  FROM documents""")
def prj_09(cdm):
    """Normalised (whitespace + case) and raw SHA-256 of every document."""
    d = cdm.raw("documents")
    return d.select("doc_id", C.norm_hash("text").alias("norm_hash"), C.raw_hash("text").alias("raw_hash"))


@query("prj_11_text_previews", """
  SELECT doc_id, sha256(left(text, 1000)) AS letter_hash, left(text, 200) AS preview,
         CASE WHEN length(text) > 32 THEN left(text, 32) || '…' ELSE text END AS short_label
  FROM documents""")
def prj_11(cdm):
    """Letter truncation (1000), 200-character preview and 32-character ellipsised label."""
    d = cdm.raw("documents")
    return d.select("doc_id", F.sha2(C.truncate("text", 1000), 256).alias("letter_hash"),
                    C.truncate("text", 200).alias("preview"), C.ellipsize("text", 32).alias("short_label"))


def _hits(words):
    return " + ".join(f"CAST(instr(lower(text), '{w}') > 0 AS INTEGER)" for w in dict.fromkeys(words))


@query("prj_12_provisional_labels", f"""
  SELECT doc_id, label, CASE WHEN label = 0 THEN 'routine_followup' WHEN label = 1 THEN 'treatment_event'
                             ELSE 'uncertain' END AS label_name
  FROM (SELECT doc_id, CAST(CASE WHEN ({_hits(CORPUS_POSITIVE)}) > ({_hits(CORPUS_NEGATIVE)}) THEN 1
                               WHEN ({_hits(CORPUS_NEGATIVE)}) > ({_hits(CORPUS_POSITIVE)}) THEN 0 END AS INTEGER) AS label
        FROM documents)""")
def prj_12(cdm):
    """Provisional label of every whole document: distinct positive minus negative keywords."""
    d = cdm.raw("documents")
    lab = C.provisional_label("text", CORPUS_POSITIVE, CORPUS_NEGATIVE)
    return d.select("doc_id", lab.alias("label")).withColumn("label_name", C.binary_label_name("label"))


def _route_sql(col: str, mapping) -> str:
    parts = []
    for spec, words in mapping:
        cond = " OR ".join(f"instr(lower({col}), '{w.lower()}') > 0" for w in words)
        parts.append(f"WHEN {cond} THEN '{spec}'")
    return "CASE " + " ".join(parts) + " END"


@query("prj_14_specialty_routing", with_views(f"""
  SELECT concept_id, concept_name, {_route_sql('concept_name', CONDITION_SPECIALTY_MAP)} AS specialty,
         {_route_sql('concept_name', CORPUS_SPECIALTY_MAP)} AS corpus_specialty
  FROM concept WHERE domain_id IN ('Condition', 'Drug')""", "concept"))
def prj_14(cdm):
    """Route condition / drug names to a specialty: first map entry with a contained keyword."""
    c = cdm.concept.filter(F.col("domain_id").isin("Condition", "Drug"))
    return c.select("concept_id", "concept_name",
                    C.route("concept_name", CONDITION_SPECIALTY_MAP).alias("specialty"),
                    C.route("concept_name", CORPUS_SPECIALTY_MAP).alias("corpus_specialty"))


_RAW_ANSWER = """CASE doc_id % 7 WHEN 0 THEN 'U' WHEN 1 THEN ' 1 ' WHEN 2 THEN '0' WHEN 3 THEN '2 - eligible'
  WHEN 4 THEN 'x' WHEN 5 THEN 'u' ELSE CAST(quality AS VARCHAR) END"""


@query("prj_15_label_parsers", f"""
  SELECT doc_id, raw,
         CAST(CASE upper(trim(raw)) WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'U' THEN NULL ELSE -1 END AS INTEGER) AS strict_label,
         CAST(CASE WHEN TRY_CAST(raw AS INTEGER) IN (0, 1) THEN TRY_CAST(raw AS INTEGER) END AS INTEGER) AS int01_label,
         CAST(CASE WHEN regexp_matches(trim(raw), '^[012]') THEN CAST(left(trim(raw), 1) AS INTEGER) ELSE 1 END AS INTEGER)
           AS generated_label,
         NOT regexp_matches(trim(raw), '^[012]') AS generated_invalid,
         CAST(starts_with(trim(raw), '1') AS INTEGER) AS binary_label
  FROM (SELECT doc_id, {_RAW_ANSWER} AS raw FROM labels)""")
def prj_15(cdm):
    """Label parsers: strict 0/1/U, integer 0/1 or null, leading-digit generated label, startswith-1."""
    lab = cdm.raw("labels")
    raw = F.expr(_RAW_ANSWER.replace("CAST(quality AS VARCHAR)", "CAST(quality AS STRING)"))
    d = lab.select("doc_id", raw.alias("raw"))
    g = C.parse_generated("raw")
    return d.select("doc_id", "raw", C.parse_strict("raw").alias("strict_label"),
                    C.parse_int01("raw").alias("int01_label"), g["label"].alias("generated_label"),
                    g["invalid"].alias("generated_invalid"), C.parse_binary("raw").alias("binary_label"))


@query("prj_16_challenge_labels", f"""
  SELECT doc_id, CASE WHEN is_stop IS TRUE AND event_type IS NOT DISTINCT FROM '{C.PIFU_EVENT}' THEN 'ELIGIBLE'
                      ELSE 'NOT_ELIGIBLE' END AS challenge_label
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS is_stop,
               CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '{C.PIFU_EVENT}' ELSE 'Treatment' END
                 AS event_type FROM documents)""")
def prj_16(cdm):
    """Challenge label: clock stop and the exact patient-initiated event type -> ELIGIBLE."""
    d = cdm.raw("documents")
    is_stop = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % 3 == 0)
    ev = (F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string"))
          .when(F.col("doc_id") % 2 == 0, F.lit(C.PIFU_EVENT)).otherwise(F.lit("Treatment")))
    return d.select("doc_id", C.challenge_label(is_stop, ev).alias("challenge_label"))


def _training_rows(cdm, unknown: bool = False):
    """Labelled documents in the nested shape of training rows; every 13th label is unknown on request."""
    d = cdm.raw("labels").join(cdm.raw("documents"), "doc_id")
    name = (F.when(F.col("toxic") == 1, "not_eligible").when(F.col("quality") == 1, "eligible").otherwise("borderline"))
    if unknown:
        name = F.when(F.col("doc_id") % 13 == 0, "unsure").otherwise(name)
    ident = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).otherwise(F.lit(""))
    return d.select("doc_id", F.col("text").alias("input"),
                    F.struct(F.struct(name.alias("eligibility")).alias("pifu_assessment")).alias("expected_output"),
                    F.create_map(F.lit("document_id"), ident, F.lit("lang"), F.col("lang")).alias("metadata"))


@query("prj_17_normalised_samples", f"""
  , t AS (SELECT d.doc_id, d.text, d.lang, d.source,
                 CASE WHEN lb.toxic = 1 THEN 0 WHEN lb.quality = 1 THEN 2 ELSE 1 END AS k
          FROM labels lb JOIN documents d ON lb.doc_id = d.doc_id),
  u AS (SELECT CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS VARCHAR)
                    ELSE left(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 16) END AS sample_id,
               text, k, 'pifu_synthetic_training' AS source, lang AS meta FROM t
        UNION ALL SELECT 'eval_' || CAST(doc_id AS VARCHAR), text, k, 'eval_sample_150_v3', lang FROM t
        UNION ALL SELECT CAST(doc_id AS VARCHAR), text, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END, 'edge_case', 'false'
                  FROM t)
  SELECT sample_id, sha256(text) AS text_hash, CAST(k AS INTEGER) AS label,
         CASE k WHEN 0 THEN 'NOT_ELIGIBLE' WHEN 1 THEN 'BORDERLINE' ELSE 'ELIGIBLE' END AS label_name, source, meta
  FROM u""".replace("  , t AS", "  WITH t AS", 1))
def prj_17(cdm):
    """Training, external-test and challenge rows -> one sample shape (id, text, label, source, metadata)."""
    rows = _training_rows(cdm)
    external = rows.select(F.col("doc_id").alias("_idx"), "input", "metadata",
                           F.col("expected_output.pifu_assessment.eligibility").alias("_class"))
    challenge = rows.select(F.col("doc_id").alias("document_id"), F.col("input").alias("document_content"),
                            (F.col("doc_id") % 2 == 0).alias("is_clock_stop"),
                            F.lit(C.PIFU_EVENT).alias("clock_stop_event_type"))
    out = None
    for part, field in ((D.training_samples(rows), "lang"), (D.external_samples(external), "lang"),
                        (D.challenge_samples(challenge, "edge_case"), "hard_negative")):
        part = part.select("sample_id", F.sha2("text", 256).alias("text_hash"), "label", "label_name", "source",
                           F.try_element_at("metadata", F.lit(field)).alias("meta"))
        out = part if out is None else out.unionByName(part)
    return out


@query("prj_17_unknown_labels", """
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'UNSURE' AS label_name
  FROM labels lb JOIN documents d ON lb.doc_id = d.doc_id WHERE d.doc_id % 13 = 0 AND d.doc_id % 4 <> 0""")
def prj_17_unknown(cdm):
    """Training rows with a label outside the label space (planted), by document id."""
    bad = D.unknown_labels(D.training_samples(_training_rows(cdm, unknown=True)))
    given = F.try_element_at("metadata", F.lit("document_id"))
    return bad.select(given.alias("doc_id"), "label_name").filter("doc_id <> ''")


_TEMPLATE = "Clinic letter:\n{text}\n\nReturn only 0, 1, or 2:"


@query("prj_18_render_prompt", """
  SELECT doc_id, CAST(length(p) AS INTEGER) AS prompt_chars, sha256(p) AS prompt_hash
  FROM (SELECT doc_id, replace('""" + _TEMPLATE.replace("\n", "\n") + """', '{text}', text) AS p FROM documents)""")
def prj_18(cdm):
    """Prompt rendered from a template for every document."""
    d = cdm.raw("documents").select("doc_id", C.render(_TEMPLATE, "text").alias("p"))
    return d.select("doc_id", F.length("p").alias("prompt_chars"), F.sha2("p", 256).alias("prompt_hash"))


# ---------------------------------------------------------------- WIN-12 / WIN-07 / WIN-08
@query("win_12_candidate_pool", with_views("""
  SELECT note_id, person_id, CAST(length(note_text) AS INTEGER) AS note_length FROM note
  WHERE length(note_text) BETWEEN 100 AND 2000""", "note"))
def win_12(cdm):
    """Candidate pool: all notes of 100..2000 characters, 50 at least."""
    pool = D.candidate_pool(cdm.note, at_least=50)
    return pool.select("note_id", "person_id", F.length("note_text").alias("note_length"))


@query("win_07_seeded_sample", with_views(f"""
  SELECT note_id, person_id, label FROM letters ORDER BY {_key('note_id')}, note_id LIMIT 50""", "letters"))
def win_07(cdm):
    """Reproducible sample of 50 letters (seeded hash order)."""
    return D.seeded_sample(FX.letters(cdm).select("note_id", "person_id", "label"), "note_id", SEED, 50)


@query("win_08_ordered_split", with_views(f"""
  SELECT note_id, CASE WHEN row_number() OVER (ORDER BY {_key('note_id')}, note_id)
                            <= floor((SELECT count(*) FROM letters) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM letters""", "letters"))
def win_08(cdm):
    """Ordered 80/20 split of all letters in seeded order (distributed rank)."""
    return D.ordered_split(FX.letters(cdm).select("note_id"), "note_id", SEED).select("note_id", "split")


# ---------------------------------------------------------------- JON-06 / SET-01
_NORM = "sha256(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))))"
_LINES = """(SELECT {id} AS id, {norm} AS line_hash FROM (SELECT {id}, unnest(string_split({t}, chr(10))) AS line FROM {tbl})
   WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '')"""


def _lines(tbl, id_, t):
    return _LINES.format(id=id_, t=t, tbl=tbl, norm=_NORM.format(c="line"))


@query("jon_06_remove_overlap_document", f"""
  SELECT doc_id FROM documents WHERE {_NORM.format(c='text')} NOT IN (SELECT {_NORM.format(c='text')} FROM benchmark)""")
def jon_06_doc(cdm):
    """Documents left after removing any whose normalised text is a benchmark text."""
    return D.remove_overlap(cdm.raw("documents"), cdm.raw("benchmark"), level="document").select("doc_id")


@query("jon_06_remove_overlap_line", f"""
  SELECT doc_id FROM documents WHERE doc_id NOT IN (
    SELECT id FROM {_lines('documents', 'doc_id', 'text')} WHERE line_hash IN (SELECT line_hash FROM {_lines('benchmark', 'item_id', 'text')}))""")
def jon_06_line(cdm):
    """Documents left after removing any sharing a normalised non-blank line with the benchmark."""
    return D.remove_overlap(cdm.raw("documents"), cdm.raw("benchmark"), level="line").select("doc_id")


@query("set_01_line_overlap", f"""
  SELECT line_hash FROM {_lines('documents', 'doc_id', 'text')}
  INTERSECT SELECT line_hash FROM {_lines('benchmark', 'item_id', 'text')}""")
def set_01(cdm):
    """Normalised line hashes shared by the documents and the benchmark."""
    a = D.line_hashes(cdm.raw("documents"), "doc_id", "text")
    b = D.line_hashes(cdm.raw("benchmark"), "item_id", "text")
    return D.overlap(a, b, "line_hash")


@query("set_02_concat_sources", """
  SELECT source, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT CAST(doc_id AS VARCHAR) AS sample_id, text, 'documents' AS source FROM documents
    UNION ALL SELECT 'bench_' || CAST(item_id AS VARCHAR), text, 'benchmark' FROM benchmark) GROUP BY 1""")
def set_02(cdm):
    """Concatenate two sample sources by column name, then count per source."""
    a = cdm.raw("documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text",
                                    F.lit("documents").alias("source"))
    b = cdm.raw("benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("sample_id"),
                                    "text", F.lit("benchmark").alias("source"))
    return D.concat(a, b).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_except_rows", """
  SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels""")
def set_03(cdm):
    """Documents without a label row (row-level set difference, duplicates respected)."""
    return D.except_rows(cdm.raw("documents").select("doc_id"), cdm.raw("labels").select("doc_id"))


@query("set_03_required_columns", with_views("""
  SELECT 'person_id' AS column_name, true AS present, CAST(count(*) FILTER (WHERE person_id IS NULL) AS BIGINT) AS n_null FROM letters
  UNION ALL SELECT 'label', true, CAST(count(*) FILTER (WHERE label IS NULL) AS BIGINT) FROM letters
  UNION ALL SELECT 'split', false, NULL""", "letters"))
def set_03_columns(cdm):
    """Columns that a split needs: which the letters lack, and the rows without a value in the others."""
    return D.required_columns(FX.letters(cdm), ["person_id", "label", "split"])


# ---------------------------------------------------------------- JON-07 / JON-08 / WIN-10 / WIN-11 / AGG-24
@query("jon_07_pending", with_views("""
  SELECT note_id FROM letters WHERE note_id NOT IN (SELECT note_id FROM relabel WHERE note_id % 3 <> 0)""",
                                    "letters", "relabel"))
def jon_07(cdm):
    """Letters still to label: those without a record in the checkpoint, resolved or not."""
    done = FX.relabel_results(cdm).filter("note_id % 3 <> 0")
    return D.pending(FX.letters(cdm), done, "note_id").select("note_id")


_RESOLVED_SQL = """SELECT l.note_id, l.person_id, l.note_date, CAST(r.label AS INTEGER) AS label,
         CASE WHEN r.label = 1 THEN 'treatment_event' ELSE 'routine_followup' END AS label_name,
         l.label AS original_label, (l.label IS NOT NULL AND r.label <> l.label) AS label_changed,
         false AS label_failed
  FROM letters l JOIN relabel r ON l.note_id = r.note_id WHERE r.status = 'resolved'"""


def _merge(cdm):
    return D.merge_labels(FX.letters(cdm), FX.relabel_results(cdm))


@query("jon_08_merge_resolved", with_views(_RESOLVED_SQL, "letters", "relabel"))
def jon_08_res(cdm):
    """Resolved letters: new label, original label and changed flag."""
    res, _ = _merge(cdm)
    return res.select("note_id", "person_id", "note_date", "label", "label_name", "original_label",
                      F.coalesce("label_changed", F.lit(False)).alias("label_changed"), "label_failed")


@query("jon_08_merge_unresolved", with_views("""
  SELECT l.note_id, l.label, r.label_failed, r.error_type,
         CASE WHEN r.label_failed THEN 'api_failure' ELSE 'labeller_uncertain' END AS unresolved_reason
  FROM letters l JOIN relabel r ON l.note_id = r.note_id WHERE r.status <> 'resolved'""", "letters", "relabel"))
def jon_08_unres(cdm):
    """Unresolved letters with their reason (api_failure / labeller_uncertain)."""
    _, un = _merge(cdm)
    return un.select("note_id", "label", "label_failed", "error_type", "unresolved_reason")


_GROUPED_SQL = f"""
  , resolved AS ({_RESOLVED_SQL}),
  groups AS (SELECT person_id, count(*) AS n, count(*) FILTER (WHERE label > 0) AS pos,
                    CAST(round(count(*) FILTER (WHERE label > 0) * 10 / count(*)) AS INTEGER) AS stratum,
                    {_key('person_id')} AS k FROM resolved GROUP BY person_id),
  tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(n) - sum(pos) AS BIGINT) AS neg FROM groups),
  heavy AS (SELECT person_id, g.n, g.pos, g.n - g.pos AS neg, row_number() OVER (ORDER BY g.n DESC, k) AS i
            FROM groups g, tot WHERE g.n * {SPL.HEAVY} > tot.n),
  -- Rows missing in test, validation and train (scaled by 40), after the first i heavy groups; p: positive, o: other.
  heavy_placed AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS person_id, CAST(NULL AS VARCHAR) AS split,
           8 * pos AS tp, 8 * neg AS t_o, 4 * pos AS vp, 4 * neg AS vo, 28 * pos AS rp, 28 * neg AS ro FROM tot
    UNION ALL
    SELECT i, person_id, split, tp - (CASE WHEN split = 'test' THEN 40 * gp ELSE 0 END), t_o - (CASE WHEN split = 'test' THEN 40 * gn ELSE 0 END),
           vp - (CASE WHEN split = 'validation' THEN 40 * gp ELSE 0 END), vo - (CASE WHEN split = 'validation' THEN 40 * gn ELSE 0 END),
           rp - (CASE WHEN split = 'train' THEN 40 * gp ELSE 0 END), ro - (CASE WHEN split = 'train' THEN 40 * gn ELSE 0 END)
    FROM (SELECT h.i, h.person_id, h.pos AS gp, h.neg AS gn, tp, t_o, vp, vo, rp, ro,
                 list_sort([
                   (greatest(0, 40 * h.pos - tp) - greatest(0, -tp) + greatest(0, 40 * h.neg - t_o) - greatest(0, -t_o),
                    -7 * (tp + t_o), 0, 'test'),
                   (greatest(0, 40 * h.pos - vp) - greatest(0, -vp) + greatest(0, 40 * h.neg - vo) - greatest(0, -vo),
                    -14 * (vp + vo), 1, 'validation'),
                   (greatest(0, 40 * h.pos - rp) - greatest(0, -rp) + greatest(0, 40 * h.neg - ro) - greatest(0, -ro),
                    -2 * (rp + ro), 2, 'train')])[1][4] AS split
          FROM heavy_placed p JOIN heavy h ON h.i = p.i + 1)),
  last AS (SELECT greatest(0, tp) AS tp, greatest(0, t_o) AS t_o, greatest(0, vp) AS vp, greatest(0, vo) AS vo,
                  greatest(0, rp) AS rp, greatest(0, ro) AS ro FROM heavy_placed ORDER BY i DESC LIMIT 1),
  shares AS (SELECT CASE WHEN tp + vp + rp > 0 THEN tp / CAST(tp + vp + rp AS DOUBLE) ELSE CAST(8 AS DOUBLE) / 40 END AS tp,
                    CASE WHEN t_o + vo + ro > 0 THEN t_o / CAST(t_o + vo + ro AS DOUBLE) ELSE CAST(8 AS DOUBLE) / 40 END AS t_o,
                    CASE WHEN tp + vp + rp > 0 THEN vp / CAST(tp + vp + rp AS DOUBLE) ELSE CAST(4 AS DOUBLE) / 40 END AS vp,
                    CASE WHEN t_o + vo + ro > 0 THEN vo / CAST(t_o + vo + ro AS DOUBLE) ELSE CAST(4 AS DOUBLE) / 40 END AS vo FROM last),
  light AS (SELECT g.person_id, g.n, g.stratum, 2 * sum(g.n) OVER (PARTITION BY g.stratum ORDER BY k, g.person_id) - g.n AS middle
            FROM groups g, tot WHERE g.n * {SPL.HEAVY} <= tot.n),
  strata AS (SELECT stratum, sum(g.n) AS rows_in, sum(g.pos) * any_value(s.tp) + (sum(g.n) - sum(g.pos)) * any_value(s.t_o) AS wt,
                    sum(g.pos) * any_value(s.vp) + (sum(g.n) - sum(g.pos)) * any_value(s.vo) AS wv
             FROM groups g, tot, shares s WHERE g.n * {SPL.HEAVY} <= tot.n GROUP BY stratum),
  once AS (SELECT coalesce(sum(n) FILTER (WHERE middle <= 2 * wt), 0) AS t,
                  coalesce(sum(n) FILTER (WHERE middle > 2 * wt AND middle <= 2 * (wt + wv)), 0) AS v
           FROM light JOIN strata USING (stratum)),
  wanted AS (SELECT sum(wt) AS t, sum(wv) AS v FROM strata),
  bounds AS (SELECT stratum, CASE WHEN place = 1 THEN wt - (once.t - wanted.t) ELSE wt END AS b1,
                    CASE WHEN place = 1 THEN wt + wv - (once.t - wanted.t) - (once.v - wanted.v) ELSE wt + wv END AS b2
             FROM (SELECT *, row_number() OVER (ORDER BY rows_in DESC, stratum) AS place FROM strata), once, wanted),
  assigned AS (SELECT person_id, split FROM heavy_placed WHERE i > 0
               UNION ALL SELECT person_id, CASE WHEN middle <= 2 * b1 THEN 'test' WHEN middle <= 2 * b2 THEN 'validation'
                                                ELSE 'train' END FROM light JOIN bounds USING (stratum)),
  split_rows AS (SELECT resolved.*, assigned.split FROM resolved JOIN assigned ON resolved.person_id = assigned.person_id)"""


def _grouped_sql(select: str) -> str:
    return with_views(_GROUPED_SQL + select, "letters", "relabel").replace("WITH", "WITH RECURSIVE", 1)


def grouped(cdm):
    res, _ = _merge(cdm)
    return D.grouped_split(res, "person_id", "label", SEED)


@query("win_10_grouped_split", _grouped_sql("\n  SELECT note_id, person_id, split FROM split_rows"))
def win_10(cdm):
    """Grouped stratified split of resolved letters: 1/5 of the rows to test, 1/8 of the rest to validation."""
    return grouped(cdm).select("note_id", "person_id", "split")


@query("win_11_person_leaks", _grouped_sql("""
  SELECT CAST(person_id AS VARCHAR) AS leak_key, CAST(count(DISTINCT split) AS BIGINT) AS n_splits,
         string_agg(DISTINCT split, ',' ORDER BY split) AS splits
  FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1"""))
def win_11_person(cdm):
    """Leakage check: persons in more than one split (must be empty)."""
    return D.leaks(grouped(cdm), F.col("person_id").cast("string"))


@query("win_11_text_leaks", _grouped_sql(f"""
  SELECT {_NORM.format(c='l.text')} AS leak_key, CAST(count(DISTINCT s.split) AS BIGINT) AS n_splits,
         string_agg(DISTINCT s.split, ',' ORDER BY s.split) AS splits
  FROM split_rows s JOIN letters l ON s.note_id = l.note_id GROUP BY 1 HAVING count(DISTINCT s.split) > 1"""))
def win_11_text(cdm):
    """Leakage check: normalised letter texts found in more than one split (exact copies across persons)."""
    g = grouped(cdm).select("note_id", "split").join(FX.letters(cdm).select("note_id", "text"), "note_id")
    return D.leaks(g, C.norm_hash("text"))


@query("agg_24_relabel_counts", _grouped_sql("""
  , un AS (SELECT r.* FROM letters l JOIN relabel r ON l.note_id = r.note_id WHERE r.status <> 'resolved')
  SELECT CAST(count(*) AS BIGINT) AS n_resolved, CAST(count(*) FILTER (WHERE label_changed) AS BIGINT) AS n_changed,
         CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_label_0,
         CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_label_1,
         CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
         CAST(count(*) FILTER (WHERE split = 'validation') AS BIGINT) AS n_validation,
         CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
         (SELECT CAST(count(*) AS BIGINT) FROM un) AS n_unresolved,
         (SELECT CAST(count(*) FILTER (WHERE label_failed) AS BIGINT) FROM un) AS n_failed,
         (SELECT CAST(count(*) FILTER (WHERE NOT label_failed) AS BIGINT) FROM un) AS n_uncertain
  FROM split_rows"""))
def agg_24(cdm):
    """Re-label accounting: changed, failed, uncertain, per class, split sizes."""
    res, un = _merge(cdm)
    split = D.grouped_split(res, "person_id", "label", SEED)
    return D.relabel_counts(split, un)


# ---------------------------------------------------------------- WIN-09 / AGG-20
_STRAT_SQL = f"""
  , s AS (SELECT * FROM samples3 WHERE {_NORM.format(c='text')} NOT IN (SELECT {_NORM.format(c='text')} FROM benchmark)),
  counts AS (SELECT label, count(*) AS n_class FROM s GROUP BY 1),
  tot AS (SELECT sum(n_class) AS n, ceil(sum(n_class) * CAST(0.1 AS DOUBLE)) AS n_test FROM counts),
  q AS (SELECT label, n_test * n_class / n AS exact, floor(n_test * n_class / n) AS fl FROM counts, tot),
  q2 AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY exact - fl DESC, label)
                                   <= (SELECT n_test FROM tot) - (SELECT sum(fl) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
  ranked AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {_key('sample_id')}, sample_id) AS r FROM s),
  split_rows AS (SELECT ranked.*, CASE WHEN r <= quota THEN 'validation' ELSE 'train' END AS split
                 FROM ranked JOIN q2 ON ranked.label = q2.label)"""


def stratified(cdm):
    pool = D.remove_overlap(FX.samples3(cdm), cdm.raw("benchmark"), level="document")
    return D.stratified_split(pool.select("sample_id", "label"), "sample_id", "label", 0.10, SEED,
                              least_rows=D.MIN_SPLIT_ROWS)


@query("win_09_stratified_split", with_views(_STRAT_SQL + "\n  SELECT sample_id, label, split FROM split_rows",
                                             "samples3"))
def win_09(cdm):
    """Stratified 90/10 train / validation split of the three-class samples (largest-remainder quotas)."""
    return stratified(cdm).select("sample_id", "label", "split")


@query("agg_20_class_counts", with_views(_STRAT_SQL + """
  SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM split_rows GROUP BY 1, 2""", "samples3"))
def agg_20(cdm):
    """Class counts per split."""
    return D.class_counts(stratified(cdm), ["split"])


# ---------------------------------------------------------------- WIN-13
@query("win_13_last_record", """
  SELECT conv_id, turn, role, sha256(text) AS text_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) WHERE rk = 1""")
def win_13(cdm):
    """Last record per key wins: the latest turn of every conversation log."""
    c = cdm.raw("conversations")
    last = D.last_record(c, "conv_id", "turn")
    return last.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))
