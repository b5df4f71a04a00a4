"""The CDM views of ``cohortlens.sources.cdm`` written as DuckDB CTEs.

Oracle queries name the views they need; ``with_views`` prefixes exactly
those definitions (plus their dependencies) to the query text.
"""

from __future__ import annotations

_LINE_EVENTS = """
  SELECT li.*, o.o_custkey,
         concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS event_id,
         o.o_custkey + 1 AS person_id,
         CAST(l_shipdate AS DATE) AS start_date,
         CAST(l_quantity AS INTEGER) AS qty
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
"""

_EVENT_CONCEPT = """CAST(CASE event_type WHEN 'click' THEN 4001 WHEN 'error' THEN 4002
  WHEN 'purchase' THEN 4003 WHEN 'signup' THEN 4004 WHEN 'view' THEN 4005 ELSE 0 END AS BIGINT)"""

VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "person": ([], """
  SELECT c.c_custkey + 1 AS person_id,
         CAST(CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE 1930 + (c.c_custkey * 37) % 90 END AS INTEGER) AS year_of_birth,
         CAST(3000 + c.c_custkey % 3 AS BIGINT) AS gender_concept_id,
         CAST(CASE WHEN c.c_custkey % 11 = 0 THEN 0 ELSE 1000 + c.c_nationkey END AS BIGINT) AS race_concept_id,
         CAST(2000 + n.n_regionkey AS BIGINT) AS ethnicity_concept_id
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    "concept": ([], """
  SELECT CAST(1000 + n_nationkey AS BIGINT) AS concept_id, n_name AS concept_name, 'Race' AS domain_id FROM nation
  UNION ALL SELECT CAST(2000 + r_regionkey AS BIGINT), r_name, 'Ethnicity' FROM region
  UNION ALL SELECT * FROM (VALUES (CAST(3000 AS BIGINT), 'F', 'Gender'), (3001, 'M', 'Gender'),
        (9202, 'Outpatient Visit', 'Visit'), (5000, 'Outpatient note', 'Type Concept'),
        (4001, 'click', 'Measurement'), (4002, 'error', 'Measurement'), (4003, 'purchase', 'Measurement'),
        (4004, 'signup', 'Measurement'), (4005, 'view', 'Measurement')) t(concept_id, concept_name, domain_id)
  UNION ALL SELECT CAST(100000 + p_partkey AS BIGINT), p_name, 'Drug' FROM part WHERE p_partkey % 10 <> 0
  UNION ALL SELECT CAST(200000 + p_partkey AS BIGINT), concat_ws(' ', p_brand, p_type), 'Condition'
            FROM part WHERE p_partkey % 10 <> 0"""),
    "line_events": ([], _LINE_EVENTS),
    "drug_exposure": (["line_events"], """
  SELECT event_id AS drug_exposure_id, person_id,
         CAST(CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 100000 + l_partkey END AS BIGINT) AS drug_concept_id,
         start_date AS drug_exposure_start_date,
         CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber = 1 THEN start_date
              ELSE start_date + qty END AS drug_exposure_end_date,
         l_quantity AS quantity,
         CASE WHEN l_linenumber % 4 = 0 THEN qty END AS days_supply
  FROM line_events WHERE l_returnflag IN ('A', 'N')"""),
    "condition_occurrence": (["line_events"], """
  SELECT event_id AS condition_occurrence_id, person_id,
         CAST(CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 200000 + l_partkey END AS BIGINT) AS condition_concept_id,
         start_date AS condition_start_date,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE start_date + qty END AS condition_end_date,
         CAST(32020 AS BIGINT) AS condition_type_concept_id,
         'P' || CAST(l_partkey AS VARCHAR) AS condition_source_value
  FROM line_events WHERE l_returnflag = 'R'"""),
    "visit_occurrence": ([], """
  SELECT o_orderkey AS visit_occurrence_id, o_custkey + 1 AS person_id,
         CAST(9202 AS BIGINT) AS visit_concept_id, o_orderstatus AS visit_source_value,
         CAST(o_orderdate AS DATE) AS visit_start_date, CAST(o_orderdate AS DATE) AS visit_end_date,
         CAST(NULL AS BIGINT) AS care_site_id
  FROM orders"""),
    "measurement": ([], f"""
  SELECT event_id AS measurement_id, user_id + 1 AS person_id,
         {_EVENT_CONCEPT} AS measurement_concept_id,
         CAST(ts AS DATE) AS measurement_date,
         CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value_as_number,
         CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'mg' ELSE 'mmol' END AS unit_source_value,
         CAST(2.0 AS DOUBLE) AS range_low,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(10.0 AS DOUBLE) END AS range_high
  FROM events"""),
    "observation": ([], f"""
  SELECT event_id AS observation_id, user_id + 1 AS person_id,
         {_EVENT_CONCEPT} AS observation_concept_id, CAST(ts AS DATE) AS observation_date,
         props AS value_as_string, value AS value_as_number
  FROM events WHERE event_type = 'view'"""),
    "procedure_occurrence": ([], f"""
  SELECT event_id AS procedure_occurrence_id, user_id + 1 AS person_id,
         {_EVENT_CONCEPT} AS procedure_concept_id, CAST(ts AS DATE) AS procedure_date,
         CAST(6000 AS BIGINT) AS procedure_type_concept_id
  FROM events WHERE event_type = 'click'"""),
    "note": ([], """
  SELECT doc_id AS note_id, doc_id % 97 + 1 AS person_id,
         DATE '2010-01-01' + CAST(doc_id % 3000 AS INTEGER) AS note_date,
         CAST(5000 AS BIGINT) AS note_type_concept_id, CAST(5001 AS BIGINT) AS note_class_concept_id,
         source AS note_title, text AS note_text
  FROM documents"""),
}


def register_view(name: str, deps: list[str], body: str) -> None:
    """Add a derived oracle view (fixtures built from the CDM views)."""
    VIEW_SQL[name] = (deps, body)


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str) -> str:
    """Prefix the CTEs for ``names`` (and what they depend on) to ``sql``."""
    parts = [f"{n} AS ({VIEW_SQL[n][1]}\n)" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n" + sql
