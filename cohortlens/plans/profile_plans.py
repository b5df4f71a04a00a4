"""Registered cohort-profile queries (SRC-01, JON-02..05/10, AGG-01..19/26,
PRJ-03..08/13/27) with their DuckDB oracle twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.keywords import CORPUS_TOPICS, NOTE_TOPICS
from cohortlens.operators import profile as P
from cohortlens.plans.oracle_views import with_views
from cohortlens.plans.registry import query
from cohortlens.sources.catalog import load_tables

R = C.round6

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()
DOMAINS = [("Conditions", "condition_occurrence"), ("Medications", "drug_exposure"),
           ("Visits", "visit_occurrence"), ("Procedures", "procedure_occurrence"),
           ("Measurements", "measurement"), ("Observations", "observation"), ("Notes", "note")]


def _named(cdm, table, key, fallback):
    return P.with_concept(cdm[table], key, cdm.concept, fallback=fallback)


def persons_with_bands(cdm):
    demo = P.demographic_labels(cdm.person, cdm.concept)
    return demo.withColumn("age_group", C.age_band("age"))


# ---------------------------------------------------------------- SRC-01 / AGG-01
@query("src_01_load_tables", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, count(*) > 0 AS non_empty FROM {t}"
    for t in RAW_TABLES) + ")")
def src_01(cdm):
    """Every Parquet file of the folder as a named table, with row counts."""
    tables = load_tables(cdm.spark, cdm.sf_dir, RAW_TABLES, register=False)
    return P.table_overview(tables)


_CDM = ["person", "concept", "condition_occurrence", "drug_exposure", "visit_occurrence",
        "measurement", "observation", "procedure_occurrence", "note"]


@query("agg_01_table_overview", with_views("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, count(*) > 0 AS non_empty FROM {t}"
    for t in _CDM) + ")", *_CDM))
def agg_01(cdm):
    """Row count of every CDM table, largest first."""
    return P.table_overview(cdm.tables())


# ---------------------------------------------------------------- JON-02 / PRJ-05
_DEMO_SQL = """
  SELECT p.person_id, g.concept_name AS gender, r.concept_name AS race, e.concept_name AS ethnicity,
         2024 - p.year_of_birth AS age
  FROM person p
  LEFT JOIN (SELECT * FROM concept WHERE domain_id = 'Gender') g ON p.gender_concept_id = g.concept_id
  LEFT JOIN (SELECT * FROM concept WHERE domain_id = 'Race') r ON p.race_concept_id = r.concept_id
  LEFT JOIN (SELECT * FROM concept WHERE domain_id = 'Ethnicity') e ON p.ethnicity_concept_id = e.concept_id"""


@query("jon_02_demographics", with_views(_DEMO_SQL, "person", "concept"))
def jon_02(cdm):
    """Gender / race / ethnicity names and approximate age of every person."""
    return P.demographic_labels(cdm.person, cdm.concept).select(
        "person_id", "gender", "race", "ethnicity", "age")


_AGE_BAND_SQL = """CASE WHEN age <= 17 THEN '0–17' WHEN age <= 29 THEN '18–29' WHEN age <= 44 THEN '30–44'
  WHEN age <= 59 THEN '45–59' WHEN age <= 74 THEN '60–74' WHEN age IS NOT NULL THEN '75+' END"""


@query("prj_06_age_bands", with_views(f"""
  SELECT {_AGE_BAND_SQL} AS age_group, CAST(count(*) AS BIGINT) AS persons
  FROM (SELECT 2024 - year_of_birth AS age FROM person) GROUP BY 1""", "person"))
def prj_06(cdm):
    """Persons per right-closed age band (null age kept as its own group)."""
    return (cdm.person.select(C.age_band(C.age("year_of_birth")).alias("age_group"))
            .groupBy("age_group").agg(F.count(F.lit(1)).alias("persons")))


# ---------------------------------------------------------------- AGG-02..04
@query("agg_02_null_profile", with_views("""
  SELECT 'drug_exposure' AS table_name, column_name, null_count, row_count,
         round(null_count / row_count, 6) AS null_rate
  FROM (SELECT CAST(count(*) AS BIGINT) AS row_count,
               CAST(count(*) FILTER (WHERE drug_exposure_end_date IS NULL) AS BIGINT) AS a,
               CAST(count(*) FILTER (WHERE days_supply IS NULL) AS BIGINT) AS b,
               CAST(count(*) FILTER (WHERE quantity IS NULL) AS BIGINT) AS c FROM drug_exposure)
  UNPIVOT (null_count FOR column_name IN (a AS 'drug_exposure_end_date', b AS 'days_supply', c AS 'quantity'))""",
                                        "drug_exposure"))
def agg_02(cdm):
    """Null counts and rates of the sparse drug-exposure columns."""
    out = P.null_profile(cdm.drug_exposure, ["drug_exposure_end_date", "days_supply", "quantity"], "drug_exposure")
    return out.withColumn("null_rate", R("null_rate"))


@query("agg_03_age_describe", with_views("""
  SELECT CAST(count(age) AS BIGINT) AS n, CAST(min(age) AS DOUBLE) AS min, CAST(max(age) AS DOUBLE) AS max,
         round(avg(age), 6) AS mean, round(median(age), 6) AS median
  FROM (SELECT CAST(2024 - year_of_birth AS DOUBLE) AS age FROM person)""", "person"))
def agg_03(cdm):
    """min / max / mean / median of age, nulls left out."""
    out = P.describe(cdm.person.select(C.age("year_of_birth").alias("age")), "age")
    return out.select("n", "min", "max", R("mean").alias("mean"), R("median").alias("median"))


@query("agg_04_gender_share", with_views(f"""
  SELECT gender, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM ({_DEMO_SQL}) GROUP BY gender""", "person", "concept"))
def agg_04(cdm):
    """Gender value counts with share of all persons (unmapped kept as null)."""
    demo = P.demographic_labels(cdm.person, cdm.concept)
    return P.value_share(demo, "gender").withColumn("share", R("share"))


# ---------------------------------------------------------------- AGG-05 / AGG-09
def _hist_sql(source: str, group: str, bins: int) -> str:
    return f"""
  m AS ({source}),
  r AS (SELECT {group}, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                        CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
        FROM m GROUP BY {group}),
  b AS (SELECT m.{group}, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin
        FROM m JOIN r ON m.{group} = r.{group}),
  cnt AS (SELECT {group}, bin, count(*) AS n FROM b GROUP BY ALL),
  grid AS (SELECT {group}, lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM r)
  SELECT g.{group}, g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS bin_start,
         round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_end, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM grid g LEFT JOIN cnt c ON g.{group} = c.{group} AND g.bin = c.bin"""


_MEAS_NAMED = """SELECT coalesce(c.concept_name, 'Unmapped measurement') AS concept_name,
         value_as_number AS v, measurement_id, unit_source_value, range_low, range_high
  FROM measurement m LEFT JOIN concept c ON m.measurement_concept_id = c.concept_id"""


def _round_hist(df):
    return df.withColumn("bin_start", R("bin_start")).withColumn("bin_end", R("bin_end"))


@query("agg_05_measurement_histogram", with_views(",\n" + _hist_sql(
    f"SELECT concept_name, v FROM ({_MEAS_NAMED}) WHERE v IS NOT NULL AND NOT isnan(v)", "concept_name", 40),
    "measurement", "concept"))
def agg_05(cdm):
    """40-bin equal-width histogram of measurement values per measurement type."""
    named = _named(cdm, "measurement", "measurement_concept_id", C.UNMAPPED_MEASUREMENT)
    return _round_hist(P.histogram(named, "value_as_number", 40, ["concept_name"]))


@query("agg_05_age_unit_histogram", with_views("""
  , a AS (SELECT CAST(2024 - year_of_birth AS BIGINT) AS age FROM person WHERE year_of_birth IS NOT NULL),
  r AS (SELECT min(age) AS lo, max(age) AS hi FROM a),
  c AS (SELECT age AS value, count(*) AS n FROM a GROUP BY 1)
  SELECT CAST(g.value AS BIGINT) AS value, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT unnest(range(lo, hi + 1)) AS value FROM r) g LEFT JOIN c ON g.value = c.value""", "person"))
def agg_05_unit(cdm):
    """Unit-width (one year) age histogram, empty years included."""
    ages = cdm.person.select(C.age("year_of_birth").alias("age"))
    return P.unit_histogram(ages, "age").select("value", "n")


@query("agg_09_fenced_histogram", with_views(f"""
  , named AS ({_MEAS_NAMED}),
  numeric AS (SELECT * FROM named WHERE v IS NOT NULL),
  top8 AS (SELECT concept_name FROM numeric GROUP BY 1 ORDER BY count(measurement_id) DESC, concept_name LIMIT 8),
  q AS (SELECT concept_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
        FROM numeric WHERE concept_name IN (SELECT concept_name FROM top8) GROUP BY 1),
  fenced AS (SELECT n.concept_name, n.v FROM numeric n JOIN q ON n.concept_name = q.concept_name
             WHERE q3 - q1 <= 0 OR n.v BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)),"""
    + _hist_sql("SELECT concept_name, v FROM fenced", "concept_name", 40), "measurement", "concept"))
def agg_09(cdm):
    """Top-8 numeric measurement types, 3xIQR fence per type, then 40-bin histograms."""
    named = _named(cdm, "measurement", "measurement_concept_id", C.UNMAPPED_MEASUREMENT)
    numeric = named.filter(F.col("value_as_number").isNotNull())
    top = P.top_measurements(named, 8)
    fenced = P.iqr_fence(P.keep_top(numeric, top, "concept_name"), "value_as_number", ["concept_name"])
    return _round_hist(P.histogram(fenced, "value_as_number", 40, ["concept_name"]))


# ---------------------------------------------------------------- AGG-06
def _epp_sql(label, table):
    return (f"SELECT '{label}' AS domain, CAST(sum(n) AS BIGINT) AS total_events, CAST(count(*) AS BIGINT) AS n_persons,"
            f" round(median(n), 6) AS median_per_person, round(avg(n), 6) AS mean_per_person,"
            f" CAST(max(n) AS BIGINT) AS max_per_person FROM (SELECT person_id, count(*) AS n FROM {table} GROUP BY 1)")


@query("agg_06_events_per_person", with_views(" UNION ALL ".join(_epp_sql(l, t) for l, t in DOMAINS),
                                              *[t for _, t in DOMAINS]))
def agg_06(cdm):
    """Events per patient in seven domains: total, median, mean, max."""
    out = P.events_per_person({label: cdm[t] for label, t in DOMAINS})
    return (out.withColumn("median_per_person", R("median_per_person"))
            .withColumn("mean_per_person", R("mean_per_person")))


# ---------------------------------------------------------------- AGG-07
def _top_sql(table, key, id_col, count_name, fallback, n):
    return with_views(f"""
  SELECT coalesce(c.concept_name, '{fallback}') AS concept_name,
         CAST(count(t.{id_col}) AS BIGINT) AS {count_name},
         CAST(count(DISTINCT t.person_id) AS BIGINT) AS patient_count
  FROM {table} t LEFT JOIN concept c ON t.{key} = c.concept_id
  GROUP BY 1 ORDER BY patient_count DESC, {count_name} DESC, concept_name LIMIT {n}""", table, "concept")


@query("agg_07_top_medications", _top_sql("drug_exposure", "drug_concept_id", "drug_exposure_id",
                                          "exposure_count", C.UNMAPPED_MEDICATION, 20))
def agg_07_meds(cdm):
    """Top-20 medications by distinct patients, then exposures."""
    return P.top_by_persons(cdm.drug_exposure, "drug_concept_id", cdm.concept, "drug_exposure_id",
                            C.UNMAPPED_MEDICATION, 20, "exposure_count")


@query("agg_07_top_conditions", _top_sql("condition_occurrence", "condition_concept_id",
                                         "condition_occurrence_id", "occurrence_count", C.UNMAPPED_CONDITION, 20))
def agg_07_conds(cdm):
    """Top-20 conditions by distinct patients, then occurrences."""
    return P.top_by_persons(cdm.condition_occurrence, "condition_concept_id", cdm.concept, "condition_occurrence_id",
                            C.UNMAPPED_CONDITION, 20, "occurrence_count")


# ---------------------------------------------------------------- AGG-08 / AGG-10
@query("agg_08_top_measurements", with_views(f"""
  SELECT concept_name, CAST(count(measurement_id) AS BIGINT) AS count FROM ({_MEAS_NAMED})
  WHERE v IS NOT NULL GROUP BY 1 ORDER BY count DESC, concept_name LIMIT 8""", "measurement", "concept"))
def agg_08(cdm):
    """Eight most recorded numeric measurement types."""
    return P.top_measurements(_named(cdm, "measurement", "measurement_concept_id", C.UNMAPPED_MEASUREMENT), 8)


@query("agg_08_measurement_totals", with_views(f"""
  SELECT CAST(count(*) AS BIGINT) AS numeric_records, CAST(count(DISTINCT concept_name) AS BIGINT) AS measurement_types
  FROM ({_MEAS_NAMED}) WHERE v IS NOT NULL""", "measurement", "concept"))
def agg_08_totals(cdm):
    """Numeric measurement records and distinct numeric types."""
    return P.measurement_totals(_named(cdm, "measurement", "measurement_concept_id", C.UNMAPPED_MEASUREMENT))


@query("agg_10_modal_unit", with_views(f"""
  SELECT concept_name, unit_source_value AS modal_unit_source_value FROM (
    SELECT concept_name, unit_source_value,
           row_number() OVER (PARTITION BY concept_name ORDER BY count(*) DESC, unit_source_value) AS rk
    FROM ({_MEAS_NAMED}) WHERE v IS NOT NULL AND unit_source_value IS NOT NULL AND trim(unit_source_value) <> ''
    GROUP BY 1, 2) WHERE rk = 1""", "measurement", "concept"))
def agg_10(cdm):
    """Most frequent non-blank unit per numeric measurement type (ties -> lowest)."""
    named = _named(cdm, "measurement", "measurement_concept_id", C.UNMAPPED_MEASUREMENT)
    return P.modal_value(named.filter(F.col("value_as_number").isNotNull()), "unit_source_value", ["concept_name"])


# ---------------------------------------------------------------- AGG-11/12 JON-04
_COND_PER_PERSON = """SELECT p.person_id, CAST(coalesce(c.n, 0) AS BIGINT) AS condition_count
  FROM person p LEFT JOIN (SELECT person_id, count(DISTINCT condition_concept_id) AS n FROM condition_occurrence
                           WHERE condition_concept_id IS NOT NULL AND condition_concept_id <> 0 GROUP BY 1) c
  ON p.person_id = c.person_id"""


def conditions_per_person(cdm):
    return P.with_counts(cdm.person.select("person_id"),
                         P.distinct_per_person(cdm.condition_occurrence, "condition_concept_id"),
                         "person_id", "condition_count")


@query("agg_11_conditions_per_person", with_views(_COND_PER_PERSON, "person", "condition_occurrence"))
def agg_11(cdm):
    """Distinct mapped conditions of every person (0 when none)."""
    return conditions_per_person(cdm)


@query("agg_12_condition_bands", with_views(f"""
  , bands AS (SELECT * FROM (VALUES (0, '0 conditions'), (1, '1 condition'), (2, '2 conditions'),
        (3, '3–4 conditions'), (4, '5–9 conditions'), (5, '10+ conditions')) t(band_order, band)),
  cp AS ({_COND_PER_PERSON}),
  b AS (SELECT CASE WHEN condition_count = 0 THEN '0 conditions' WHEN condition_count = 1 THEN '1 condition'
                    WHEN condition_count = 2 THEN '2 conditions' WHEN condition_count BETWEEN 3 AND 4 THEN '3–4 conditions'
                    WHEN condition_count BETWEEN 5 AND 9 THEN '5–9 conditions' ELSE '10+ conditions' END AS band FROM cp)
  SELECT CAST(band_order AS INTEGER) AS band_order, bands.band,
         CAST(coalesce(n, 0) AS BIGINT) AS patient_count,
         round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM cp), 6) AS percent
  FROM bands LEFT JOIN (SELECT band, count(*) AS n FROM b GROUP BY 1) x ON bands.band = x.band"""
                                            , "person", "condition_occurrence"))
def agg_12(cdm):
    """Patients per distinct-condition band with percent of the cohort."""
    return P.band_share(conditions_per_person(cdm), "condition_count").withColumn("percent", R("percent"))


# ---------------------------------------------------------------- AGG-13 JON-05 JON-10
@query("agg_13_age_condition_matrix", with_views(f"""
  , demo AS ({_DEMO_SQL}),
  pb AS (SELECT person_id, {_AGE_BAND_SQL} AS age_group FROM demo),
  named AS (SELECT co.person_id, c.concept_name, pb.age_group FROM condition_occurrence co
            LEFT JOIN concept c ON co.condition_concept_id = c.concept_id
            LEFT JOIN pb ON co.person_id = pb.person_id
            WHERE co.condition_concept_id IS NOT NULL AND co.condition_concept_id <> 0),
  ok AS (SELECT * FROM named WHERE concept_name IS NOT NULL AND age_group IS NOT NULL),
  top AS (SELECT concept_name, row_number() OVER (ORDER BY count(DISTINCT person_id) DESC, concept_name) AS name_rank
          FROM ok GROUP BY 1 ORDER BY name_rank LIMIT 10),
  bands AS (SELECT * FROM (VALUES (0, '0–17'), (1, '18–29'), (2, '30–44'), (3, '45–59'), (4, '60–74'), (5, '75+'))
            t(band_order, age_group)),
  cells AS (SELECT age_group, concept_name, count(DISTINCT person_id) AS n FROM ok GROUP BY 1, 2)
  SELECT CAST(b.band_order AS INTEGER) AS band_order, b.age_group, CAST(t.name_rank AS INTEGER) AS name_rank,
         t.concept_name, CAST(coalesce(cells.n, 0) AS BIGINT) AS patient_count
  FROM top t JOIN bands b ON TRUE
  LEFT JOIN cells ON cells.age_group = b.age_group AND cells.concept_name = t.concept_name""",
                                                 "person", "concept", "condition_occurrence"))
def agg_13(cdm):
    """Age band x top-10 condition matrix of distinct patients, zero-filled."""
    valid = cdm.condition_occurrence.filter(F.col("condition_concept_id").isNotNull()
                                            & (F.col("condition_concept_id") != 0))
    bands = cdm.person.select("person_id", C.age_band(C.age("year_of_birth")).alias("age_group"))
    out = P.band_matrix(valid, "condition_concept_id", cdm.concept, bands, 10)
    return out.withColumn("name_rank", F.col("name_rank").cast("int"))


# ---------------------------------------------------------------- AGG-14 / AGG-15 / PRJ-04
@query("agg_14_supply_summary", with_views("""
  , s AS (SELECT CAST(days_supply AS DOUBLE) AS d FROM drug_exposure WHERE days_supply IS NOT NULL AND days_supply > 0),
  cap AS (SELECT quantile_cont(d, 0.99) AS cap_value FROM s)
  SELECT CAST((SELECT count(*) FROM drug_exposure) AS BIGINT) AS exposures,
         CAST((SELECT count(*) FROM s) AS BIGINT) AS with_supply,
         round((SELECT cap_value FROM cap), 6) AS cap_value,
         CAST(count(*) AS BIGINT) AS n_below_cap, round(median(d), 6) AS median_days, round(avg(d), 6) AS mean_days,
         round((SELECT count(*) FROM s) * 100.0 / (SELECT count(*) FROM drug_exposure), 6) AS coverage_pct
  FROM s WHERE d <= (SELECT cap_value FROM cap)""", "drug_exposure"))
def agg_14(cdm):
    """Days-supply coverage, p99 cap and median / mean below the cap."""
    out = P.supply_summary(cdm.drug_exposure)
    return out.select("exposures", "with_supply", R("cap_value").alias("cap_value"), "n_below_cap",
                      R("median_days").alias("median_days"), R("mean_days").alias("mean_days"),
                      R("coverage_pct").alias("coverage_pct"))


@query("agg_15_supply_by_drug", with_views("""
  SELECT coalesce(c.concept_name, 'Unmapped medication') AS concept_name, CAST(count(*) AS BIGINT) AS record_count,
         round(median(CAST(days_supply AS DOUBLE)), 6) AS median_days, round(avg(days_supply), 6) AS mean_days
  FROM drug_exposure d LEFT JOIN concept c ON d.drug_concept_id = c.concept_id
  WHERE days_supply IS NOT NULL AND days_supply > 0
  GROUP BY 1 ORDER BY record_count DESC, concept_name LIMIT 10""", "drug_exposure", "concept"))
def agg_15(cdm):
    """Per-medication days-supply record count, median and mean; top 10."""
    named = _named(cdm, "drug_exposure", "drug_concept_id", C.UNMAPPED_DRUG_DURATION)
    out = P.supply_by_drug(named, 10)
    return out.withColumn("median_days", R("median_days")).withColumn("mean_days", R("mean_days"))


_SUPPLY_TEXT = """CASE k WHEN 0 THEN 'n/a' WHEN 1 THEN '-3' WHEN 2 THEN '0' WHEN 3 THEN '12 days' WHEN 4 THEN ''
         ELSE ' ' || CAST(days_supply AS VARCHAR) || ' ' END"""


@query("prj_04_positive_supply", with_views(f"""
  SELECT drug_exposure_id, days_supply_clean FROM (
    SELECT drug_exposure_id, TRY_CAST({_SUPPLY_TEXT} AS DOUBLE) AS days_supply_clean
    FROM (SELECT *, hash_key % 9 AS k FROM (SELECT *, CAST(days_supply AS BIGINT) + person_id AS hash_key FROM drug_exposure)))
  WHERE days_supply_clean > 0""", "drug_exposure"))
def prj_04(cdm):
    """Days of supply from text, positive numbers only; words, blanks, zeros and negative numbers are planted."""
    k = (F.col("days_supply").cast("long") + F.col("person_id")) % 9
    text = (F.when(k == 0, "n/a").when(k == 1, "-3").when(k == 2, "0").when(k == 3, "12 days").when(k == 4, "")
            .otherwise(F.concat(F.lit(" "), F.col("days_supply").cast("string"), F.lit(" "))))
    raw = cdm.drug_exposure.select("drug_exposure_id", text.alias("days_supply"))
    return P.coerce_positive(raw, "days_supply").select("drug_exposure_id", "days_supply_clean")


_BAD_DATES = """CASE {k} % 10 WHEN 0 THEN 'not a date' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '' ELSE CAST({d} AS VARCHAR) END"""


@query("prj_03_coerce_dates", with_views(f"""
  SELECT 'note' AS table_name, note_id AS row_id, CAST(TRY_CAST({_BAD_DATES.format(k='note_id', d='note_date')} AS DATE) AS VARCHAR) AS date FROM note
  UNION ALL
  SELECT 'measurement', measurement_id, CAST(TRY_CAST({_BAD_DATES.format(k='measurement_id', d='measurement_date')} AS DATE) AS VARCHAR)
  FROM measurement""", "note", "measurement"))
def prj_03(cdm):
    """Date columns of the clinical tables from text: words, impossible days and blanks (planted) become null."""
    out, tables = None, {}
    for name, key in (("note", "note_id"), ("measurement", "measurement_id")):
        k, date = F.col(key) % 10, P.DATE_COLUMNS[name]
        text = (F.when(k == 0, "not a date").when(k == 1, "2024-02-30").when(k == 2, "")
                .otherwise(F.col(date).cast("string")))
        tables[name] = cdm[name].select(F.col(key).alias("row_id"), text.alias(date))
    for name, df in P.coerce_table_dates(tables).items():
        part = df.select(F.lit(name).alias("table_name"), "row_id", F.col(P.DATE_COLUMNS[name]).cast("string").alias("date"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- AGG-16 / AGG-17 / AGG-26 / PRJ-10
_NOTE_FEATURES = """SELECT n.*, length(note_text) AS note_length,
       len(list_filter(regexp_split_to_array(note_text, '\\s+'), lambda w: w <> '')) AS word_count,
       coalesce(c.concept_name, 'Unmapped note type') AS note_type, year(note_date) AS note_year
  FROM note n LEFT JOIN concept c ON n.note_type_concept_id = c.concept_id"""


@query("agg_16_note_summary", with_views(f"""
  , f AS ({_NOTE_FEATURES}),
  pp AS (SELECT person_id, count(*) AS k FROM f GROUP BY 1)
  SELECT CAST(count(*) AS BIGINT) AS notes, CAST(count(DISTINCT person_id) AS BIGINT) AS patients,
         round(avg(note_length), 6) AS mean_chars, round(median(note_length), 6) AS median_chars,
         CAST(max(note_length) AS BIGINT) AS max_chars, round(avg(word_count), 6) AS mean_words,
         round(median(word_count), 6) AS median_words, CAST(max(word_count) AS BIGINT) AS max_words,
         round((SELECT avg(k) FROM pp), 6) AS mean_notes_per_patient,
         round((SELECT median(k) FROM pp), 6) AS median_notes_per_patient,
         CAST((SELECT max(k) FROM pp) AS BIGINT) AS max_notes_per_patient
  FROM f""", "note", "concept"))
def agg_16(cdm):
    """Note corpus summary: notes, patients, character / word statistics, notes per patient."""
    out = P.note_summary(P.note_features(cdm.note, cdm.concept))
    cols = []
    for name, typ in out.dtypes:
        cols.append(R(name).alias(name) if typ == "double" else F.col(name).cast("long").alias(name)
                    if typ in ("int", "bigint") else F.col(name))
    return out.select(*cols)


@query("agg_16_note_types", with_views(f"""
  SELECT note_type, CAST(count(*) AS BIGINT) AS notes FROM ({_NOTE_FEATURES})
  GROUP BY 1 ORDER BY notes DESC, note_type LIMIT 10""", "note", "concept"))
def agg_16_types(cdm):
    """Most frequent note types."""
    return P.note_types(P.note_features(cdm.note, cdm.concept))


@query("agg_17_notes_by_year", with_views(f"""
  SELECT CAST(note_year AS INTEGER) AS note_year, CAST(count(*) AS BIGINT) AS notes FROM ({_NOTE_FEATURES})
  WHERE note_year IS NOT NULL GROUP BY 1 ORDER BY 1""", "note", "concept"))
def agg_17(cdm):
    """Notes per calendar year."""
    return P.notes_by_year(P.note_features(cdm.note, cdm.concept))


@query("agg_26_note_type_distinct", with_views(f"""
  SELECT CAST(count(DISTINCT note_type) AS BIGINT) AS distinct_values FROM ({_NOTE_FEATURES})
  WHERE note_type <> 'Unmapped note type'""", "note", "concept"))
def agg_26(cdm):
    """Distinct mapped note types (1 means a constant, uninformative column)."""
    return P.distinct_values(P.note_features(cdm.note, cdm.concept), "note_type", C.UNMAPPED_NOTE_TYPE)


@query("prj_10_text_lengths", """
  SELECT doc_id, CAST(length(text) AS INTEGER) AS char_len,
         CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count
  FROM documents""")
def prj_10(cdm):
    """Character length and whitespace word count of every document."""
    d = cdm.raw("documents")
    return d.select("doc_id", C.char_len("text").alias("char_len"), C.word_count("text").alias("word_count"))


# ---------------------------------------------------------------- AGG-18 / PRJ-27
_RANGE_SQL = f"""SELECT *, CASE WHEN v < range_low THEN 'Low' WHEN v > range_high THEN 'High' ELSE 'Normal' END AS status
  FROM ({_MEAS_NAMED}) WHERE v IS NOT NULL AND range_low IS NOT NULL AND range_high IS NOT NULL AND range_low <= range_high"""


@query("prj_27_range_status", with_views(f"""
  SELECT status, CAST(count(*) AS BIGINT) AS n FROM ({_RANGE_SQL}) GROUP BY 1""", "measurement", "concept"))
def prj_27(cdm):
    """Reference-range status Low / High / Normal of every checkable measurement."""
    return P.range_checked(cdm.measurement).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_18_abnormal_rates", with_views(f"""
  SELECT concept_name, CAST(count(measurement_id) AS BIGINT) AS total,
         CAST(count(*) FILTER (WHERE status = 'Low') AS BIGINT) AS n_low,
         CAST(count(*) FILTER (WHERE status = 'High') AS BIGINT) AS n_high,
         round(avg(CASE WHEN status <> 'Normal' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_abnormal
  FROM ({_RANGE_SQL}) GROUP BY 1 ORDER BY pct_abnormal DESC, total DESC, concept_name LIMIT 10""",
                                           "measurement", "concept"))
def agg_18(cdm):
    """Per-measurement low / high counts and % outside the reference range; top 10."""
    checked = P.with_concept(P.range_checked(cdm.measurement), "measurement_concept_id", cdm.concept,
                             fallback=C.UNMAPPED_MEASUREMENT)
    return P.abnormal_rates(checked, 10).withColumn("pct_abnormal", R("pct_abnormal"))


@query("agg_18_abnormal_overall", with_views(f"""
  SELECT CAST(count(*) AS BIGINT) AS with_range, CAST(count(*) FILTER (WHERE status <> 'Normal') AS BIGINT) AS abnormal,
         round(avg(CASE WHEN status <> 'Normal' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_abnormal
  FROM ({_RANGE_SQL})""", "measurement", "concept"))
def agg_18_overall(cdm):
    """Overall share of values outside the reference range."""
    return P.abnormal_overall(P.range_checked(cdm.measurement)).withColumn("pct_abnormal", R("pct_abnormal"))


# ---------------------------------------------------------------- PRJ-13 / AGG-19
def _topic_sql(topics: dict[str, list[str]]) -> str:
    def cond(words):
        return "(" + " OR ".join("instr(low, '" + w.lower().replace("'", "''") + "') > 0" for w in words) + ")"
    flags = ",\n ".join(f"{cond(ws)} AS \"{name}\"" for name, ws in topics.items())
    names = list(topics)
    anyx = " OR ".join(f'"{n}"' for n in names)
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS topic, CAST(count(*) FILTER (WHERE \"{n}\") AS BIGINT) AS matches FROM fl" for n in names)
    return with_views(f"""
  , fl AS (SELECT {flags} FROM (SELECT coalesce(lower(note_text), '') AS low FROM note)),
  tot AS (SELECT count(*) AS n FROM fl),
  r AS ({rows}
         UNION ALL SELECT 'Any category', CAST(count(*) FILTER (WHERE {anyx}) AS BIGINT) FROM fl
         UNION ALL SELECT 'No category', CAST(count(*) FILTER (WHERE NOT ({anyx})) AS BIGINT) FROM fl)
  SELECT topic, matches, round(matches * 100.0 / (SELECT n FROM tot), 6) AS percent FROM r""", "note")


def _topic_query(cdm, topics):
    flags = C.topic_flags(cdm.note.select("note_id", "note_text"), "note_text", topics)
    return P.topic_shares(flags, list(topics)).withColumn("percent", R("percent"))


@query("agg_19_topic_shares", _topic_sql(NOTE_TOPICS))
def agg_19(cdm):
    """Clinical keyword topics over all notes: matches and share, any / no match."""
    return _topic_query(cdm, NOTE_TOPICS)


@query("prj_13_corpus_topics", _topic_sql(CORPUS_TOPICS))
def prj_13(cdm):
    """Multi-label keyword flags with a corpus-word topic dictionary (non-exclusive)."""
    return _topic_query(cdm, CORPUS_TOPICS)
