"""Data-quality and suitability rules at cohort scale (QLT-01..14).

Table-level profiles are one aggregate pass per table. Person-level flags are
per-person aggregates of each fact table (each the size of the cohort, not of
the facts) joined on person_id onto the full person list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators.dist import count_quantiles
from cohortlens.session import bounded_broadcast, checkpoint_dir

# Rule thresholds.
MULTIMORBIDITY_MIN = 3
LOW_VISITS_PER_YEAR = 5
TREND_MIN_VALUES = 2
CIRRHOSIS_WORD = "cirrhosis"
CIRRHOSIS_SPECIALTY = "gastroenterology"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# QLT-01 -----------------------------------------------------------------------
def concept_profile(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Unmapped (concept id 0) count and rate per table."""
    parts = []
    for table, key in keys.items():
        parts.append(tables[table].agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key) == 0).alias("unmapped"))
                     .select(F.lit(table).alias("table_name"), F.lit(key).alias("column_name"), "rows", "unmapped",
                             F.try_divide(F.col("unmapped"), F.col("rows")).alias("unmapped_rate")))
    return _union(parts)


def display_name(concept_id: str, name: str, source_value: str) -> F.Column:
    """Unmapped concept -> the source value is the only label."""
    return F.when(F.col(concept_id) == 0, F.col(source_value)).otherwise(F.col(name))


# QLT-02 -----------------------------------------------------------------------
def constant_columns(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Columns with a single non-null value over all rows (uninformative artefacts)."""
    parts = []
    for table, cols in columns.items():
        agg = tables[table].agg(*[F.countDistinct(c).alias(c) for c in cols])
        stack = ", ".join(f"'{c}', `{c}`" for c in cols)
        parts.append(agg.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, distinct_values)")
                     .select(F.lit(table).alias("table_name"), "column_name", "distinct_values",
                             (F.col("distinct_values") == 1).alias("is_constant")))
    return _union(parts)


# QLT-03 -----------------------------------------------------------------------
def null_rates(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    parts = []
    for table, cols in columns.items():
        agg = tables[table].agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
        stack = ", ".join(f"'{c}', `{c}`" for c in cols)
        parts.append(agg.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, null_rate)")
                     .select(F.lit(table).alias("table_name"), "column_name", "null_rate"))
    return _union(parts)


# QLT-04..12 / 14 ----------------------------------------------------------------
def person_flags(tables: dict[str, DataFrame], specialty_map=None) -> DataFrame:
    """One row per person with the suitability flags as columns."""
    person = tables["person"].select("person_id", "race_concept_id", "ethnicity_concept_id")
    cond = tables["condition_occurrence"]
    drug = tables["drug_exposure"]
    visit = tables["visit_occurrence"]
    note = tables["note"]
    meas = tables["measurement"]

    c_agg = cond.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.bool_or(F.col("condition_end_date").isNull()).alias("active_comorbidity_unknown"),
        F.countDistinct(F.when(F.col("condition_end_date").isNull(), F.col("condition_concept_id")))
        .alias("n_active_conditions"))
    per_drug = drug.groupBy("person_id", "drug_concept_id").agg(
        F.count(F.lit(1)).alias("_courses"),
        F.count_if(F.col("drug_exposure_start_date") == F.col("drug_exposure_end_date")).alias("_single"),
        F.bool_and(F.col("drug_exposure_start_date").eqNullSafe(F.col("drug_exposure_end_date"))).alias("_all_single"),
        F.bool_or(F.col("drug_exposure_end_date").isNull()).alias("_open"))
    d_agg = per_drug.groupBy("person_id").agg(
        F.sum("_courses").alias("n_drug_exposures"), F.sum("_single").alias("n_single_administrations"),
        F.bool_or(F.col("_courses") > 1).alias("repeated_courses"),
        F.bool_and("_all_single").alias("only_single_administrations"),
        F.bool_or("_open").alias("medication_status_unknown"))
    per_year = visit.groupBy("person_id", F.year("visit_start_date").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    v_agg = per_year.groupBy("person_id").agg(F.sum("_n").alias("n_visits"), F.max("_n").alias("max_visits_per_year"))
    # The median over all persons needs their visit counts only; those are counted once for it and for the flags.
    checkpoint_dir(person.sparkSession)
    v_agg = v_agg.checkpoint(eager=True)
    counted = person.select("person_id").join(v_agg, "person_id", "left").groupBy(
        F.coalesce("n_visits", F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("persons"))
    median_visits = count_quantiles(counted, [], "n", "persons", {"m": 0.5}).first()[0]  # one number
    n_agg = note.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_notes"))
    per_type = meas.filter(F.col("value_as_number").isNotNull()).groupBy("person_id", "measurement_concept_id").agg(
        F.countDistinct("measurement_date").alias("_dates"))
    m_agg = per_type.groupBy("person_id").agg(
        F.count_if(F.col("_dates") >= TREND_MIN_VALUES).alias("n_trendable_measurements"))

    out = person
    for agg in (c_agg, d_agg, v_agg, n_agg, m_agg):
        out = out.join(agg, "person_id", "left")
    zero = ["n_conditions", "n_active_conditions", "n_drug_exposures", "n_single_administrations", "n_visits",
            "max_visits_per_year", "n_notes", "n_trendable_measurements"]
    out = out.fillna(0, subset=zero)
    out = out.select(
        "person_id", *[F.col(c).cast("long").alias(c) for c in zero],
        ((F.col("n_conditions") == 0) & ((F.col("n_visits") > 1) | (F.col("n_notes") > 1))).alias("coding_gap"),
        (F.col("n_visits") == 0).alias("insufficient_history"),
        ((F.col("race_concept_id") == 0) | (F.col("ethnicity_concept_id") == 0)).alias("unmapped_demographics"),
        F.coalesce("active_comorbidity_unknown", F.lit(False)).alias("active_comorbidity_unknown"),
        F.coalesce("medication_status_unknown", F.lit(False)).alias("medication_status_unknown"),
        (F.col("n_active_conditions") >= MULTIMORBIDITY_MIN).alias("multimorbidity"),
        F.coalesce("repeated_courses", F.lit(False)).alias("repeated_courses"),
        F.coalesce("only_single_administrations", F.lit(False)).alias("only_single_administrations"),
        ((F.col("n_visits") > 0) & (F.col("max_visits_per_year") < LOW_VISITS_PER_YEAR)).alias("low_visit_frequency"),
        (F.col("n_visits") < F.lit(median_visits).cast("double")).alias("sparse_visits"),
        (F.col("n_trendable_measurements") > 0).alias("trend_possible"))
    if specialty_map is not None:
        # The keyword lists run once per vocabulary entry, not per fact row.
        routed = (tables["concept"].select(F.col("concept_id").alias("_cid"),
                                           specialty(F.col("concept_name"), specialty_map).alias("_s"))
                  .filter("_s IS NOT NULL AND _cid <> 0"))
        spec = cond.select("person_id", "condition_concept_id").join(
            bounded_broadcast(routed), F.col("condition_concept_id") == F.col("_cid"))
        s_agg = spec.groupBy("person_id").agg(F.countDistinct("_s").alias("n_specialties"))
        out = (out.join(s_agg, "person_id", "left").fillna(0, subset=["n_specialties"])
               .withColumn("multi_specialty", F.col("n_specialties") > 1))
    return out


def specialty(name: F.Column, specialty_map) -> F.Column:
    """QLT-12 routing with the hard rule: cirrhosis always routes to gastroenterology."""
    return F.when(F.lower(name).contains(CIRRHOSIS_WORD), F.lit(CIRRHOSIS_SPECIALTY)).otherwise(
        C.route(name, specialty_map))


# QLT-13 -----------------------------------------------------------------------
def coverage(flags: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Shares of the cohort with notes, with measurements, and with zero conditions."""
    has_meas = tables["measurement"].select("person_id").distinct().withColumn("_m", F.lit(1))
    j = flags.join(has_meas, "person_id", "left")
    return j.agg(F.count(F.lit(1)).alias("persons"),
                 F.avg((F.col("n_notes") > 0).cast("double")).alias("note_coverage"),
                 F.avg(F.col("_m").isNotNull().cast("double")).alias("measurement_coverage"),
                 F.avg((F.col("n_conditions") == 0).cast("double")).alias("zero_condition_share"))
