"""CDM-shaped views over the driver's test tables.

The operators work on OMOP CDM tables (person, concept, condition_occurrence,
drug_exposure, visit_occurrence, measurement, observation,
procedure_occurrence, note). The test data is a TPC-H-like star schema plus
text tables, so this module derives CDM views from it with deterministic
integer expressions. The DuckDB oracle builds the same views from the same
expressions (``cohortlens.plans.oracle``), so both sides see identical input.

Nulls, zero ids and unmapped concepts are injected on purpose so the
unmapped / missing-data paths of every operator are exercised.

Everything is lazy. ``drug_exposure`` and ``condition_occurrence`` join
lineitem with orders on the order key (a shuffle join at scale); only the
columns a query needs survive column pruning.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Concept ids of the constant-valued CDM columns.
VISIT_CONCEPT_ID = 9202
NOTE_TYPE_CONCEPT_ID = 5000
NOTE_CLASS_CONCEPT_ID = 5001
CONDITION_TYPE_CONCEPT_ID = 32020
PROCEDURE_TYPE_CONCEPT_ID = 6000
# Measurement concept per event type, in alphabetical order.
EVENT_TYPE_CONCEPTS = [("click", 4001), ("error", 4002), ("purchase", 4003),
                       ("signup", 4004), ("view", 4005)]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "customer")
    n = raw(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    key = F.col("c_custkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select((key + 1).alias("person_id"),
                    F.when(key % 50 == 0, F.lit(None))
                    .otherwise(1930 + (key * 37) % 90).cast("int").alias("year_of_birth"),
                    (3000 + key % 3).cast("long").alias("gender_concept_id"),
                    F.when(key % 11 == 0, F.lit(0))
                    .otherwise(1000 + F.col("c_nationkey")).cast("long").alias("race_concept_id"),
                    (2000 + F.col("n_regionkey")).cast("long").alias("ethnicity_concept_id")))


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = raw(spark, sf_dir, "nation").select(
        (1000 + F.col("n_nationkey")).cast("long").alias("concept_id"),
        F.col("n_name").alias("concept_name"), F.lit("Race").alias("domain_id"))
    region = raw(spark, sf_dir, "region").select(
        (2000 + F.col("r_regionkey")).cast("long").alias("concept_id"),
        F.col("r_name").alias("concept_name"), F.lit("Ethnicity").alias("domain_id"))
    part = raw(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 != 0)
    drugs = part.select((100000 + F.col("p_partkey")).cast("long").alias("concept_id"),
                        F.col("p_name").alias("concept_name"), F.lit("Drug").alias("domain_id"))
    conditions = part.select((200000 + F.col("p_partkey")).cast("long").alias("concept_id"),
                             F.concat_ws(" ", "p_brand", "p_type").alias("concept_name"),
                             F.lit("Condition").alias("domain_id"))
    rows = ([(3000, "F", "Gender"), (3001, "M", "Gender"), (VISIT_CONCEPT_ID, "Outpatient Visit", "Visit"),
             (NOTE_TYPE_CONCEPT_ID, "Outpatient note", "Type Concept")]
            + [(cid, name, "Measurement") for name, cid in EVENT_TYPE_CONCEPTS])
    # A literal array exploded over a one-row range: unlike createDataFrame the
    # optimizer sees its (tiny) size, so the concept union stays broadcastable.
    fixed = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(cid).cast("long").alias("concept_id"), F.lit(name).alias("concept_name"),
                 F.lit(dom).alias("domain_id")) for cid, name, dom in rows])))
    return nation.unionByName(region).unionByName(fixed).unionByName(drugs).unionByName(conditions)


def _line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = raw(spark, sf_dir, "lineitem")
    o = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    qty = F.col("l_quantity").cast("int")
    start = F.col("l_shipdate").cast("date")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .withColumn("event_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey",
                                                "l_suppkey", qty.cast("string")))
            .withColumn("person_id", F.col("o_custkey") + 1)
            .withColumn("start_date", start)
            .withColumn("qty", qty))


def drug_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _line_events(spark, sf_dir).filter(F.col("l_returnflag").isin("A", "N"))
    end = (F.when(F.col("l_linestatus") == "F", F.lit(None).cast("date"))
           .when(F.col("l_linenumber") == 1, F.col("start_date"))
           .otherwise(F.date_add("start_date", F.col("qty"))))
    return ev.select(
        F.col("event_id").alias("drug_exposure_id"),
        "person_id",
        F.when(F.col("l_partkey") % 13 == 0, F.lit(0))
        .otherwise(100000 + F.col("l_partkey")).cast("long").alias("drug_concept_id"),
        F.col("start_date").alias("drug_exposure_start_date"),
        end.alias("drug_exposure_end_date"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") % 4 == 0, F.col("qty")).alias("days_supply"))


def condition_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _line_events(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    end = (F.when(F.col("l_linestatus") == "O", F.lit(None).cast("date"))
           .otherwise(F.date_add("start_date", F.col("qty"))))
    return ev.select(
        F.col("event_id").alias("condition_occurrence_id"),
        "person_id",
        F.when(F.col("l_partkey") % 13 == 0, F.lit(0))
        .otherwise(200000 + F.col("l_partkey")).cast("long").alias("condition_concept_id"),
        F.col("start_date").alias("condition_start_date"),
        end.alias("condition_end_date"),
        F.lit(CONDITION_TYPE_CONCEPT_ID).cast("long").alias("condition_type_concept_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("condition_source_value"))


def visit_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("visit_occurrence_id"),
                    (F.col("o_custkey") + 1).alias("person_id"),
                    F.lit(VISIT_CONCEPT_ID).cast("long").alias("visit_concept_id"),
                    F.col("o_orderstatus").alias("visit_source_value"),
                    day.alias("visit_start_date"), day.alias("visit_end_date"),
                    F.lit(None).cast("long").alias("care_site_id"))


def event_concept(event_type: Column) -> Column:
    expr = None
    for name, cid in EVENT_TYPE_CONCEPTS:
        expr = (F.when(event_type == name, F.lit(cid)) if expr is None
                else expr.when(event_type == name, F.lit(cid)))
    return expr.otherwise(F.lit(0)).cast("long")


def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("measurement_id"),
        (F.col("user_id") + 1).alias("person_id"),
        event_concept(et).alias("measurement_concept_id"),
        F.col("ts").cast("date").alias("measurement_date"),
        F.when(et == "signup", F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_as_number"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit("mg"))
        .otherwise(F.lit("mmol")).alias("unit_source_value"),
        F.lit(2.0).alias("range_low"),
        F.when(et == "error", F.lit(None).cast("double")).otherwise(F.lit(10.0)).alias("range_high"))


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return e.select(F.col("event_id").alias("observation_id"),
                    (F.col("user_id") + 1).alias("person_id"),
                    event_concept(F.col("event_type")).alias("observation_concept_id"),
                    F.col("ts").cast("date").alias("observation_date"),
                    F.col("props").alias("value_as_string"),
                    F.col("value").alias("value_as_number"))


def procedure_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return e.select(F.col("event_id").alias("procedure_occurrence_id"),
                    (F.col("user_id") + 1).alias("person_id"),
                    event_concept(F.col("event_type")).alias("procedure_concept_id"),
                    F.col("ts").cast("date").alias("procedure_date"),
                    F.lit(PROCEDURE_TYPE_CONCEPT_ID).cast("long").alias("procedure_type_concept_id"))


def note(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("note_id"),
                    (F.col("doc_id") % 97 + 1).alias("person_id"),
                    F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int"))
                    .alias("note_date"),
                    F.lit(NOTE_TYPE_CONCEPT_ID).cast("long").alias("note_type_concept_id"),
                    F.lit(NOTE_CLASS_CONCEPT_ID).cast("long").alias("note_class_concept_id"),
                    F.col("source").alias("note_title"),
                    F.col("text").alias("note_text"))


VIEWS = {
    "person": person, "concept": concept, "condition_occurrence": condition_occurrence,
    "drug_exposure": drug_exposure, "visit_occurrence": visit_occurrence,
    "measurement": measurement, "observation": observation,
    "procedure_occurrence": procedure_occurrence, "note": note,
}


class Cdm:
    """Lazily built CDM views for one data folder (each built once per object)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = VIEWS[name](self.spark, self.sf_dir)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in VIEWS}

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)
