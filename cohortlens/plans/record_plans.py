"""Registered patient-record queries (JON-01, WIN-01/02/14, PRJ-01/02) for the whole cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import records as REC
from cohortlens.plans.oracle_views import with_views
from cohortlens.plans.registry import query


def dates_as_text(df):
    return df.select(*[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])


def _domain_sql(domain: str, limit: int | None = None) -> str:
    table, key, name, date, tie, cols = REC.DOMAIN_SPECS[domain]
    sel = []
    for c in cols:
        if c == name:
            sel.append(f"cn.concept_name AS {name}")
        elif c.endswith("_date"):
            sel.append(f"CAST(t.{c} AS VARCHAR) AS {c}")
        else:
            sel.append(f"t.{c}")
    join = f"LEFT JOIN concept cn ON t.{key} = cn.concept_id" if key else ""
    rank = ""
    outer_where = ""
    if limit is not None:
        rank = f", row_number() OVER (PARTITION BY t.person_id ORDER BY t.{date} DESC NULLS LAST, t.{tie}) AS rk"
        outer_where = f" WHERE rk <= {limit}"
    inner = (f"SELECT t.person_id, {', '.join(sel)}{rank} FROM {table} t {join} "
             f"WHERE t.person_id IN (SELECT person_id FROM person WHERE person_id > 0)")
    out_cols = ", ".join(["person_id"] + cols)
    views = [table, "person"] + (["concept"] if key else [])
    return with_views(f"SELECT {out_cols} FROM ({inner}){outer_where}", *views)


def _domain_query(domain: str, limit: int | None = None):
    def build(cdm):
        ids = cdm.person.select("person_id")
        return dates_as_text(REC.history(cdm.tables(), domain, ids, limit=limit, sort=False))
    build.__doc__ = f"{domain.capitalize()} history of every person, named by concept (win_14 has the order)."
    return build


for _domain in ["conditions", "medications", "visits", "measurements", "observations", "procedures", "notes"]:
    query(f"jon_01_{_domain}", _domain_sql(_domain))(_domain_query(_domain))

query("win_01_newest_measurements", _domain_sql("measurements", REC.DEFAULT_MEASUREMENT_LIMIT))(
    _domain_query("measurements", REC.DEFAULT_MEASUREMENT_LIMIT))


def _ranked_sql(domain: str) -> str:
    table, _, _, date, tie, _ = REC.DOMAIN_SPECS[domain]
    return with_views(f"""SELECT person_id, {tie}, CAST(row_number() OVER (PARTITION BY person_id
         ORDER BY {date} DESC NULLS LAST, {tie}) AS BIGINT) AS newest_rank FROM {table}
       WHERE person_id IN (SELECT person_id FROM person WHERE person_id > 0)""", table, "person")


@query("win_14_newest_rank", _ranked_sql("measurements"))
def win_14(cdm):
    """Place of every measurement in its person's history, newest first."""
    _, _, _, date, tie, _ = REC.DOMAIN_SPECS["measurements"]
    return REC.newest_rank(cdm.tables(), "measurements", cdm.person.select("person_id")).select(
        "person_id", tie, "newest_rank")


@query("jon_01_person", with_views("""
  SELECT person_id, year_of_birth, gender_concept_id, race_concept_id, ethnicity_concept_id FROM person
  WHERE person_id > 0""", "person"))
def jon_01_person(cdm):
    """Person record of every cohort member."""
    return REC.person_record(cdm.tables(), cdm.person.select("person_id"))


@query("jon_01_missing_persons", with_views("""
  SELECT DISTINCT o.person_id FROM (SELECT o_custkey + 1 AS person_id FROM orders) o
  WHERE o.person_id NOT IN (SELECT person_id FROM person)""", "person"))
def jon_01_missing(cdm):
    """Ids referenced by visits that have no person row (lookup errors)."""
    return REC.missing_persons(cdm.tables(), cdm.visit_occurrence.select("person_id"))


@query("win_02_first_ids", with_views("SELECT person_id FROM person ORDER BY person_id LIMIT 20", "person"))
def win_02(cdm):
    """First 20 patient ids in order (limit clamped to 1..100)."""
    return REC.first_ids(cdm.person, 20)


@query("prj_01_invalid_ids", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) FILTER (WHERE person_id IS NULL OR person_id <= 0) AS BIGINT)"
    f" AS invalid_ids, CAST(count(*) AS BIGINT) AS row_count FROM {t}"
    for t in ["person", "condition_occurrence", "drug_exposure", "visit_occurrence", "measurement", "note"]),
    "person", "condition_occurrence", "drug_exposure", "visit_occurrence", "measurement", "note"))
def prj_01(cdm):
    """Id validation report: non-positive or null person ids per table."""
    parts = []
    for t in ["person", "condition_occurrence", "drug_exposure", "visit_occurrence", "measurement", "note"]:
        df = cdm[t]
        parts.append(df.agg(F.count_if(F.col("person_id").isNull() | (F.col("person_id") <= 0)).alias("invalid_ids"),
                            F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("prj_02_record_json", with_views("""
  SELECT t.condition_occurrence_id,
         to_json({'condition_occurrence_id': t.condition_occurrence_id, 'condition_concept_id': t.condition_concept_id,
                  'condition_name': cn.concept_name,
                  'condition_start_date': strftime(t.condition_start_date, '%Y-%m-%d'),
                  'condition_end_date': strftime(t.condition_end_date, '%Y-%m-%d'),
                  'condition_type_concept_id': t.condition_type_concept_id}) AS record_json
  FROM condition_occurrence t LEFT JOIN concept cn ON t.condition_concept_id = cn.concept_id""",
                                        "condition_occurrence", "concept"))
def prj_02(cdm):
    """JSON-safe export records of every condition (ISO dates, explicit nulls)."""
    hist = REC.history(cdm.tables(), "conditions", None, sort=False).drop("person_id")
    return REC.to_record_json(hist, "condition_occurrence_id")
