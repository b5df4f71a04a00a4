"""Registered data-quality queries (QLT-01..14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.keywords import CORPUS_SPECIALTY_MAP
from cohortlens.operators import quality as Q
from cohortlens.plans.oracle_views import register_view, with_views
from cohortlens.plans.registry import query

R = C.round6
_KEYS = {"condition_occurrence": "condition_concept_id", "drug_exposure": "drug_concept_id",
         "measurement": "measurement_concept_id", "person": "race_concept_id", "visit_occurrence": "visit_concept_id"}


@query("qlt_01_unmapped_rates", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, CAST(count(*) AS BIGINT) AS rows,"
    f" CAST(count(*) FILTER (WHERE {k} = 0) AS BIGINT) AS unmapped,"
    f" round(count(*) FILTER (WHERE {k} = 0) / count(*), 6) AS unmapped_rate FROM {t}" for t, k in _KEYS.items()),
    *_KEYS))
def qlt_01(cdm):
    """Unmapped (concept id 0) count and rate per CDM table."""
    return Q.concept_profile(cdm.tables(), _KEYS).withColumn("unmapped_rate", R("unmapped_rate"))


@query("qlt_01_source_fallback", with_views("""
  SELECT t.condition_occurrence_id, CASE WHEN t.condition_concept_id = 0 THEN t.condition_source_value
                                         ELSE c.concept_name END AS display_name
  FROM condition_occurrence t LEFT JOIN concept c ON t.condition_concept_id = c.concept_id""",
                                             "condition_occurrence", "concept"))
def qlt_01_fallback(cdm):
    """Display name of every condition: source value when the concept is unmapped."""
    from cohortlens.operators.profile import with_concept
    named = with_concept(cdm.condition_occurrence, "condition_concept_id", cdm.concept, "concept_name")
    return named.select("condition_occurrence_id",
                        Q.display_name("condition_concept_id", "concept_name", "condition_source_value")
                        .alias("display_name"))


_CONST = {"note": ["note_type_concept_id", "note_class_concept_id"], "visit_occurrence": ["visit_concept_id",
          "visit_source_value"], "condition_occurrence": ["condition_type_concept_id", "condition_concept_id"]}


@query("qlt_02_constant_columns", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values,"
    f" count(DISTINCT {c}) = 1 AS is_constant FROM {t}" for t, cols in _CONST.items() for c in cols), *_CONST))
def qlt_02(cdm):
    """Label columns with one value over all rows (constant-column artefact)."""
    return Q.constant_columns(cdm.tables(), _CONST)


_NULLS = {"condition_occurrence": ["condition_end_date"], "drug_exposure": ["drug_exposure_end_date", "days_supply",
          "quantity"], "measurement": ["value_as_number", "range_low", "range_high"]}


@query("qlt_03_null_rates", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)"
    f" AS null_rate FROM {t}" for t, cols in _NULLS.items() for c in cols), *_NULLS))
def qlt_03(cdm):
    """Null-rate profile of end dates, days_supply, quantity, values and reference ranges."""
    return Q.null_rates(cdm.tables(), _NULLS).withColumn("null_rate", R("null_rate"))


def _route_sql(col, mapping):
    parts = []
    for spec, words in mapping:
        cond = " OR ".join(f"instr(lower({col}), '{w.lower()}') > 0" for w in words)
        parts.append(f"WHEN {cond} THEN '{spec}'")
    return f"CASE WHEN instr(lower({col}), 'cirrhosis') > 0 THEN 'gastroenterology' " + " ".join(parts) + " END"


register_view("person_flags", ["person", "condition_occurrence", "drug_exposure", "visit_occurrence", "note",
                               "measurement", "concept"], f"""
  SELECT p.person_id,
         CAST(coalesce(c.n_conditions, 0) AS BIGINT) AS n_conditions,
         CAST(coalesce(c.n_active_conditions, 0) AS BIGINT) AS n_active_conditions,
         CAST(coalesce(d.n_drug_exposures, 0) AS BIGINT) AS n_drug_exposures,
         CAST(coalesce(d.n_single_administrations, 0) AS BIGINT) AS n_single_administrations,
         CAST(coalesce(v.n_visits, 0) AS BIGINT) AS n_visits,
         CAST(coalesce(v.max_visits_per_year, 0) AS BIGINT) AS max_visits_per_year,
         CAST(coalesce(n.n_notes, 0) AS BIGINT) AS n_notes,
         CAST(coalesce(m.n_trendable_measurements, 0) AS BIGINT) AS n_trendable_measurements,
         coalesce(c.n_conditions, 0) = 0 AND (coalesce(v.n_visits, 0) > 1 OR coalesce(n.n_notes, 0) > 1) AS coding_gap,
         coalesce(v.n_visits, 0) = 0 AS insufficient_history,
         p.race_concept_id = 0 OR p.ethnicity_concept_id = 0 AS unmapped_demographics,
         coalesce(c.active_unknown, false) AS active_comorbidity_unknown,
         coalesce(d.med_unknown, false) AS medication_status_unknown,
         coalesce(c.n_active_conditions, 0) >= 3 AS multimorbidity,
         coalesce(d.repeated, false) AS repeated_courses,
         coalesce(d.only_single, false) AS only_single_administrations,
         coalesce(v.n_visits, 0) > 0 AND coalesce(v.max_visits_per_year, 0) < 5 AS low_visit_frequency,
         coalesce(v.n_visits, 0) < (SELECT median(coalesce(v2.n, 0)) FROM person p2
                                    LEFT JOIN (SELECT person_id, count(*) AS n FROM visit_occurrence GROUP BY 1) v2
                                    ON p2.person_id = v2.person_id) AS sparse_visits,
         coalesce(m.n_trendable_measurements, 0) > 0 AS trend_possible,
         CAST(coalesce(s.n_specialties, 0) AS BIGINT) AS n_specialties,
         coalesce(s.n_specialties, 0) > 1 AS multi_specialty
  FROM person p
  LEFT JOIN (SELECT person_id, count(*) AS n_conditions, bool_or(condition_end_date IS NULL) AS active_unknown,
                    count(DISTINCT CASE WHEN condition_end_date IS NULL THEN condition_concept_id END) AS n_active_conditions
             FROM condition_occurrence GROUP BY 1) c ON p.person_id = c.person_id
  LEFT JOIN (SELECT person_id, sum(courses) AS n_drug_exposures, sum(single) AS n_single_administrations,
                    bool_or(courses > 1) AS repeated, bool_and(all_single) AS only_single, bool_or(open) AS med_unknown
             FROM (SELECT person_id, drug_concept_id, count(*) AS courses,
                          count(*) FILTER (WHERE drug_exposure_start_date = drug_exposure_end_date) AS single,
                          bool_and(drug_exposure_start_date IS NOT DISTINCT FROM drug_exposure_end_date) AS all_single,
                          bool_or(drug_exposure_end_date IS NULL) AS open
                   FROM drug_exposure GROUP BY 1, 2) GROUP BY 1) d ON p.person_id = d.person_id
  LEFT JOIN (SELECT person_id, sum(n) AS n_visits, max(n) AS max_visits_per_year
             FROM (SELECT person_id, year(visit_start_date) AS y, count(*) AS n FROM visit_occurrence GROUP BY 1, 2)
             GROUP BY 1) v ON p.person_id = v.person_id
  LEFT JOIN (SELECT person_id, count(*) AS n_notes FROM note GROUP BY 1) n ON p.person_id = n.person_id
  LEFT JOIN (SELECT person_id, count(*) FILTER (WHERE k >= 2) AS n_trendable_measurements
             FROM (SELECT person_id, measurement_concept_id, count(DISTINCT measurement_date) AS k FROM measurement
                   WHERE value_as_number IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m ON p.person_id = m.person_id
  LEFT JOIN (SELECT person_id, count(DISTINCT s) AS n_specialties
             FROM (SELECT co.person_id, {_route_sql('cn.concept_name', CORPUS_SPECIALTY_MAP)} AS s
                   FROM condition_occurrence co LEFT JOIN concept cn ON co.condition_concept_id = cn.concept_id
                   WHERE co.condition_concept_id <> 0) WHERE s IS NOT NULL GROUP BY 1) s ON p.person_id = s.person_id""")


@query("qlt_04_14_person_flags", with_views("SELECT * FROM person_flags", "person_flags"))
def qlt_person(cdm):
    """Per-person suitability flags: coding gap, insufficient history, unmapped demographics,
    unknown activity / medication status, multimorbidity, single administrations and repeated courses,
    low / sparse visit frequency, multi-specialty conditions, trend possible."""
    return Q.person_flags(cdm.tables(), CORPUS_SPECIALTY_MAP)


@query("qlt_13_coverage", with_views("""
  SELECT CAST(count(*) AS BIGINT) AS persons,
         round(avg(CASE WHEN n_notes > 0 THEN 1.0 ELSE 0.0 END), 6) AS note_coverage,
         round(avg(CASE WHEN person_id IN (SELECT person_id FROM measurement) THEN 1.0 ELSE 0.0 END), 6)
           AS measurement_coverage,
         round(avg(CASE WHEN n_conditions = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_condition_share
  FROM person_flags""", "person_flags"))
def qlt_13(cdm):
    """Cohort shares with notes, with measurements, and with zero conditions."""
    flags = Q.person_flags(cdm.tables())
    out = Q.coverage(flags, cdm.tables())
    return out.select("persons", *[R(c).alias(c) for c in ("note_coverage", "measurement_coverage",
                                                           "zero_condition_share")])


@query("qlt_flag_counts", with_views("""
  SELECT flag, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS persons FROM (
    SELECT * FROM (SELECT coding_gap, insufficient_history, unmapped_demographics, active_comorbidity_unknown,
                          medication_status_unknown, multimorbidity, repeated_courses, only_single_administrations,
                          low_visit_frequency, sparse_visits, trend_possible, multi_specialty FROM person_flags)
    UNPIVOT (v FOR flag IN (coding_gap, insufficient_history, unmapped_demographics, active_comorbidity_unknown,
                            medication_status_unknown, multimorbidity, repeated_courses, only_single_administrations,
                            low_visit_frequency, sparse_visits, trend_possible, multi_specialty))) GROUP BY 1""",
                                     "person_flags"))
def qlt_counts(cdm):
    """Persons raising each suitability flag."""
    flags = Q.person_flags(cdm.tables(), CORPUS_SPECIALTY_MAP)
    names = ["coding_gap", "insufficient_history", "unmapped_demographics", "active_comorbidity_unknown",
             "medication_status_unknown", "multimorbidity", "repeated_courses", "only_single_administrations",
             "low_visit_frequency", "sparse_visits", "trend_possible", "multi_specialty"]
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    long = flags.selectExpr(f"stack({len(names)}, {stack}) AS (flag, v)")
    return long.groupBy("flag").agg(F.count_if("v").alias("persons"))
