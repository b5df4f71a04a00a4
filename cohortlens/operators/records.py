"""Patient records for whole cohorts (JON-01, WIN-01, WIN-02, WIN-14, PRJ-01, PRJ-02).

The reference answers one patient per call; here one job serves a cohort:
the id set is a DataFrame, the facts are semi-joined to it (a broadcast when
the id set is proven small, else a shuffle semi join) and named by a bounded
broadcast of the concept vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import clamp_limit
from cohortlens.operators.dist import rank_within, top_k_per_group
from cohortlens.operators.profile import with_concept
from cohortlens.session import bounded_broadcast

# Limit caps of the query layer and of the service layer.
QUERY_LIMIT_MAX = 1000
SERVICE_LIMIT_MAX = 100
DEFAULT_MEASUREMENT_LIMIT = 50

# Columns returned per domain (source column, output name).
DOMAIN_SPECS = {
    "conditions": ("condition_occurrence", "condition_concept_id", "condition_name", "condition_start_date",
                   "condition_occurrence_id",
                   ["condition_occurrence_id", "condition_concept_id", "condition_name", "condition_start_date",
                    "condition_end_date", "condition_type_concept_id"]),
    "medications": ("drug_exposure", "drug_concept_id", "drug_name", "drug_exposure_start_date",
                    "drug_exposure_id",
                    ["drug_exposure_id", "drug_concept_id", "drug_name", "drug_exposure_start_date",
                     "drug_exposure_end_date", "quantity", "days_supply"]),
    "visits": ("visit_occurrence", "visit_concept_id", "visit_type", "visit_start_date", "visit_occurrence_id",
               ["visit_occurrence_id", "visit_concept_id", "visit_type", "visit_start_date", "visit_end_date",
                "care_site_id"]),
    "measurements": ("measurement", "measurement_concept_id", "measurement_name", "measurement_date",
                     "measurement_id",
                     ["measurement_id", "measurement_concept_id", "measurement_name", "measurement_date",
                      "value_as_number", "unit_source_value", "range_low", "range_high"]),
    "observations": ("observation", "observation_concept_id", "observation_name", "observation_date",
                     "observation_id",
                     ["observation_id", "observation_concept_id", "observation_name", "observation_date",
                      "value_as_string", "value_as_number"]),
    "procedures": ("procedure_occurrence", "procedure_concept_id", "procedure_name", "procedure_date",
                   "procedure_occurrence_id",
                   ["procedure_occurrence_id", "procedure_concept_id", "procedure_name", "procedure_date",
                    "procedure_type_concept_id"]),
    "notes": ("note", None, None, "note_date", "note_id",
              ["note_id", "note_date", "note_type_concept_id", "note_class_concept_id", "note_title", "note_text"]),
}


# PRJ-01 -----------------------------------------------------------------------
def valid_ids(df: DataFrame, col: str = "person_id") -> DataFrame:
    """Rows with a positive id."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) > 0))


def invalid_ids(df: DataFrame, col: str = "person_id") -> DataFrame:
    """Violation report: rows whose id is null or not positive."""
    return df.filter(F.col(col).isNull() | (F.col(col) <= 0))


# WIN-02 -----------------------------------------------------------------------
def first_ids(person: DataFrame, n: int = 20, maximum: int = SERVICE_LIMIT_MAX) -> DataFrame:
    """First ``n`` person ids in order (n clamped to 1..maximum); a TakeOrderedAndProject."""
    return person.select("person_id").orderBy("person_id").limit(clamp_limit(n, maximum))


def _cohort(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    if ids is None:
        return df
    return df.join(bounded_broadcast(valid_ids(ids.select("person_id"))), "person_id", "left_semi")


# WIN-14 -----------------------------------------------------------------------
def newest_first(df: DataFrame, date: str, tie: str) -> DataFrame:
    return df.orderBy("person_id", F.col(date).desc_nulls_last(), F.col(tie))


# WIN-01 -----------------------------------------------------------------------
def newest(df: DataFrame, date: str, tie: str, n: int, key: str = "person_id", salted: bool = True) -> DataFrame:
    """Newest ``n`` rows per key (salted two-stage top-k: a patient with a
    third of all rows is still ranked by many tasks).

    ``salted=False`` is for facts that are laid out by person already: no row
    moves, and every task keeps the newest ``n`` of its persons.
    """
    return top_k_per_group(df, [key], [F.col(date).desc_nulls_last(), F.col(tie)], n, salt_by=tie if salted else None,
                           out="_rn").drop("_rn")


# JON-01 -----------------------------------------------------------------------
def history(tables, domain: str, ids: DataFrame | None = None, limit: int | None = None,
            sort: bool = True, laid_out: bool = False) -> DataFrame:
    """One domain history for every person in ``ids`` (all persons when None).

    ``sort`` orders the whole result newest first per person, for an answer
    that is shown; cohort-wide results leave it out and take the place of a row
    from ``newest_rank``. ``laid_out`` says that the tables come from
    ``sources.layout``: their facts are not moved then.
    """
    table, key, name, date, tie, cols = DOMAIN_SPECS[domain]
    facts = _cohort(tables[table], ids)
    if key is not None:
        facts = with_concept(facts, key, tables["concept"], name)
    facts = facts.select("person_id", *cols)
    if limit is not None:
        if not 1 <= limit <= QUERY_LIMIT_MAX:
            raise ValueError(f"limit {limit} is outside 1..{QUERY_LIMIT_MAX}; leave it out for the whole history")
        facts = newest(facts, date, tie, limit, salted=not laid_out)
    return newest_first(facts, date, tie) if sort else facts


def newest_rank(tables, domain: str, ids: DataFrame | None = None) -> DataFrame:
    """The domain's rows with ``newest_rank``, their place in the newest-first order of their person.

    A distributed rank: a person with a large part of all rows is ranked by many tasks.
    """
    table, _, _, date, tie, _ = DOMAIN_SPECS[domain]
    facts = _cohort(tables[table], ids).select("person_id", date, tie)
    ranked = rank_within(facts, ["person_id"], [F.col(date).desc_nulls_last(), F.col(tie)], "newest_rank")
    return ranked.withColumn("newest_rank", F.col("newest_rank").cast("long"))


def person_record(tables, ids: DataFrame) -> DataFrame:
    """Person rows of the id set."""
    return _cohort(tables["person"], ids).select(
        "person_id", "year_of_birth", "gender_concept_id", "race_concept_id", "ethnicity_concept_id")


def missing_persons(tables, ids: DataFrame) -> DataFrame:
    """Ids without a person row (the reference raises for these)."""
    return ids.select("person_id").distinct().join(tables["person"].select("person_id"), "person_id", "left_anti")


# PRJ-02 -----------------------------------------------------------------------
def to_record_json(df: DataFrame, key: str) -> DataFrame:
    """JSON-safe export form: NaN -> null, dates as ISO text, nulls kept."""
    cols = []
    for name, typ in df.dtypes:
        c = F.col(name)
        if typ in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast(typ))
        elif typ == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif typ == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(name))
    return df.select(F.col(key), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record_json"))
