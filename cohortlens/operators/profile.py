"""Cohort profile operators (AGG-01..19, AGG-26, JON-02..05, JON-10).

Every operator is ``DataFrame(s) -> DataFrame`` and lazy. Dimension joins go
through ``bounded_broadcast`` (a proven size bound, else a shuffle join);
distinct counts are planned by Spark as two-level partial aggregates, so a
hot key is split across tasks rather than collected in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators.dist import (checked_broadcast, count_quantiles, exact_medians, exact_quantiles,
                                       dist_rank, join_groups, rank_within, same_keys)
from cohortlens.session import bounded_broadcast, checkpoint_dir


def _with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    Equi-join on a constant key with the one-row side broadcast: the big side
    is never shuffled and no pair explosion is possible (the right side has
    exactly one row).
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(scalar.withColumn("_one", F.lit(1))), "_one", "left")
            .drop("_one"))


# PRJ-03 / PRJ-04 ----------------------------------------------------------------
# The date column of each clinical table.
DATE_COLUMNS = {
    "condition_occurrence": "condition_start_date", "drug_exposure": "drug_exposure_start_date",
    "visit_occurrence": "visit_start_date", "procedure_occurrence": "procedure_date",
    "measurement": "measurement_date", "observation": "observation_date", "note": "note_date"}


def coerce_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as dates; text that is no date or time becomes null. Columns that are not there are left out."""
    dates = {c: F.trim(F.col(c).cast("string")).try_cast("timestamp").cast("date") for c in cols if c in df.columns}
    return df.withColumns(dates) if dates else df


def coerce_table_dates(tables: dict[str, DataFrame], date_columns: dict[str, str] = DATE_COLUMNS) -> dict[str, DataFrame]:
    """Every table with its date column coerced; tables without an entry stay as they are."""
    return {name: coerce_dates(df, [date_columns[name]]) if name in date_columns else df for name, df in tables.items()}


def coerce_positive(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Rows whose ``col`` is a number above 0, as a double in ``out`` (default: ``<col>_clean``); bad text, NaN and
    nulls go."""
    out = out or f"{col}_clean"
    number = F.nanvl(F.trim(F.col(col).cast("string")).try_cast("double"), F.lit(None).cast("double"))
    return df.withColumn(out, number).filter(F.col(out) > 0)


# JON-03 / JON-02 ------------------------------------------------------------
def with_concept(df: DataFrame, key: str, concept: DataFrame, name: str = "concept_name",
                 fallback: str | None = None, domain: str | None = None) -> DataFrame:
    """Left join the concept name for ``key``; keep unmatched rows (fallback name)."""
    dim = concept
    if domain is not None:
        dim = dim.filter(F.col("domain_id") == domain)
    dim = dim.select(F.col("concept_id").alias("_cid"), F.col("concept_name").alias(name))
    out = df.join(bounded_broadcast(dim), F.col(key) == F.col("_cid"), "left").drop("_cid")
    if fallback is not None:
        out = out.withColumn(name, C.name_or(name, fallback))
    return out


def demographic_labels(person: DataFrame, concept: DataFrame) -> DataFrame:
    """JON-02: gender / race / ethnicity names from concepts of the matching domain."""
    out = with_concept(person, "gender_concept_id", concept, "gender", domain="Gender")
    out = with_concept(out, "race_concept_id", concept, "race", domain="Race")
    out = with_concept(out, "ethnicity_concept_id", concept, "ethnicity", domain="Ethnicity")
    return out.withColumn("age", C.age("year_of_birth"))


# JON-04 / JON-05 / JON-10 ---------------------------------------------------
def with_counts(base: DataFrame, counts: DataFrame, key: str, count_col: str) -> DataFrame:
    """Every base row with its count, missing -> 0."""
    return (base.join(counts, key, "left")
            .withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("long")))


def keep_top(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in a top-k list (k is small and fixed: broadcast)."""
    return df.join(F.broadcast(top.select(key).distinct()), key, "left_semi")


# AGG-01 -----------------------------------------------------------------------
def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, largest first (name breaks ties)."""
    parts = [df.select(F.lit(name).alias("table_name")).groupBy("table_name")
             .agg(F.count(F.lit(1)).alias("row_count")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("non_empty", F.col("row_count") > 0).orderBy(F.desc("row_count"), "table_name")


# AGG-02 -----------------------------------------------------------------------
def null_profile(df: DataFrame, cols: list[str], table_name: str = "") -> DataFrame:
    """Null count and null rate of each column, one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column_name, null_count)")
            .select(F.lit(table_name).alias("table_name"), "column_name",
                    F.col("null_count").cast("long").alias("null_count"),
                    F.col("_n").alias("row_count"),
                    F.try_divide(F.col("null_count"), F.col("_n")).alias("null_rate")))


# AGG-03 -----------------------------------------------------------------------
def describe(df: DataFrame, col: str, by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """min / max / mean / median, nulls and NaN left out; the median is exact unless ``approx``."""
    by = by or []
    data = df.select(*by, F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")).alias("_value"))
    aggs = [F.count("_value").alias("n"), F.min("_value").alias("min"), F.max("_value").alias("max"),
            F.avg("_value").alias("mean")]
    if approx:
        return data.groupBy(*by).agg(*aggs, F.percentile_approx("_value", 0.5, 10000).alias("median"))
    return join_groups(data.groupBy(*by).agg(*aggs), exact_quantiles(data, by, "_value", {"median": 0.5}), by)


# AGG-04 -----------------------------------------------------------------------
def value_share(df: DataFrame, col: str) -> DataFrame:
    """Value counts with their share of all rows; null counted as its own row."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (_with_scalar(counts, total)
            .withColumn("share", F.col("n") / F.col("_total")).drop("_total"))


# AGG-05 -----------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 40, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram between min and max of each group, last bin closed.

    All-equal groups get NumPy's [v - 0.5, v + 0.5] range. Every bin is
    returned, empty ones with count 0. Two passes: a min/max aggregate per
    group (tiny, broadcast back by group key) and one grouped count.
    """
    by = by or []
    v = F.col(col).cast("double")
    data = df.select(*by, v.alias("_v")).filter(F.abs("_v") < F.lit(float("inf")))
    rng = data.groupBy(*by).agg(F.min("_v").alias("_lo0"), F.max("_v").alias("_hi0"))
    rng = (rng.withColumn("lo", F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")))
              .withColumn("hi", F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")))
              .drop("_lo0", "_hi0"))
    rng = checked_broadcast(rng)  # one row per group; the values are not moved for a few hot groups
    joined = data.join(rng, by, "inner") if by else _with_scalar(data, rng)
    binned = joined.withColumn(
        "bin", F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                       F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, by + ["bin"], "left")
            .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def value_gaps(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(value, value_to, n): counts per integer value in order, and one row per run of absent values with n = 0.

    As many rows as the values that occur, at most twice: a value far away is a
    gap, not a row for each integer between. The running order of one group's
    distinct values comes from one global rank, so no group is ordered in one task.
    """
    by = by or []
    v = F.col(col).cast("long")
    counts = (df.select(*by, v.alias("value")).filter(F.col("value").isNotNull())
              .groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))
    placed = rank_within(counts, by, [F.col("value")], "_r") if by else dist_rank(counts, [F.col("value")], "_r")
    # The value before: the row of the place before, met by an equi-join on (group, place).
    before = placed.select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("value").alias("_last"),
                           (F.col("_r") + 1).alias("_next"))
    pairs = placed.join(before, [*same_keys(by, "_b_"), F.col("_r") == F.col("_next")])
    # (last + 1 does not overflow: it is below the value)
    gaps = pairs.filter(F.col("_last") < F.col("value") - 1).select(
        *by, (F.col("_last") + 1).alias("value"), (F.col("value") - 1).alias("value_to"), F.lit(0).cast("long").alias("n"))
    return placed.select(*by, "value", F.col("value").alias("value_to"), "n").unionByName(gaps)


#: Widest range that ``unit_histogram`` spells out, one row per integer.
DENSE_RANGE = 1_000_000


def unit_histogram(df: DataFrame, col: str, by: list[str] | None = None, dense_range: int = DENSE_RANGE) -> DataFrame:
    """Unit-width integer bins (counts per integer value), zero bins included.

    Gaps between values are spelled out as rows with n = 0, ``dense_range``
    integers at most each; a longer gap (a wild value) stays one row, which
    ``value_to`` ends. For every other row ``value_to`` is ``value``.
    """
    by = by or []
    rows = value_gaps(df, col, by)
    width = F.col("value_to").cast("decimal(20,0)") - F.col("value").cast("decimal(20,0)")  # may pass a long
    short = (F.col("n") == 0) & (width < dense_range)
    block = 4096  # two steps: a gap is rows of the result, but never one array
    blocks = rows.filter(short).select(*by, "value", "value_to", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(value_to - value) div {block}"))).alias("_b"))
    start = F.col("value") + F.col("_b") * block
    spelled = blocks.select(*by, F.explode(F.sequence(start, F.least(start + block - 1, F.col("value_to")))).alias("value"))
    spelled = spelled.select(*by, "value", F.col("value").alias("value_to"), F.lit(0).cast("long").alias("n"))
    return rows.filter(~short).unionByName(spelled)


# AGG-06 -----------------------------------------------------------------------
def events_per_person(domains: dict[str, DataFrame]) -> DataFrame:
    """Events per patient in each domain (patients with >= 1 event)."""
    out = None
    for name, df in domains.items():
        per = df.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("domain"), "n")
        out = per if out is None else out.unionByName(per)
    # One small number per patient and domain, read by the totals and by both passes of the median.
    checkpoint_dir(out.sparkSession)
    out = out.groupBy("domain", "n").agg(F.count(F.lit(1)).alias("_times")).checkpoint(eager=True)
    totals = out.groupBy("domain").agg(
        F.sum(F.col("n") * F.col("_times")).cast("long").alias("total_events"), F.sum("_times").alias("n_persons"),
        (F.sum(F.col("n") * F.col("_times")) / F.sum("_times")).alias("mean_per_person"),
        F.max("n").cast("long").alias("max_per_person"))
    middle = count_quantiles(out, ["domain"], "n", "_times", {"median_per_person": 0.5})
    return join_groups(totals, middle, ["domain"]).select(
        "domain", "total_events", "n_persons", "median_per_person", "mean_per_person", "max_per_person")


# AGG-07 -----------------------------------------------------------------------
def name_ids(concept: DataFrame, name: str = "concept_name") -> DataFrame:
    """(_cid, _nid, name): every concept with the smallest id that carries the same name."""
    named = concept.select(F.col("concept_id").alias("_cid"), F.col("concept_name").alias(name))
    first = named.groupBy(name).agg(F.min("_cid").alias("_nid"))
    return named.join(first, name)


def _counted_per_person(df: DataFrame, key: str, ids: DataFrame, id_col: str, person: str) -> DataFrame:
    """(_nid, person, _n): events reduced to numbers before any name is touched; unmatched keys have a null ``_nid``."""
    slim = df.select(F.col(key).alias("_key"), person, id_col)
    mapped = slim.join(bounded_broadcast(ids.select("_cid", "_nid")), F.col("_key") == F.col("_cid"), "left")
    return mapped.groupBy("_nid", person).agg(F.count(id_col).alias("_n"))


def top_by_persons(df: DataFrame, key: str, concept: DataFrame, id_col: str, fallback: str, n: int = 20,
                   count_name: str = "occurrence_count", person: str = "person_id") -> DataFrame:
    """Rank names by distinct patients, then occurrences; name breaks ties.

    Events are counted per (name id, person), then per name id; names join
    the few counted rows. Unmatched keys count under ``fallback``, which must
    not itself name a concept.
    """
    ids = name_ids(concept)
    agg = (_counted_per_person(df, key, ids, id_col, person).groupBy("_nid")
           .agg(F.sum("_n").alias(count_name), F.count(person).alias("patient_count")))
    names = ids.filter("_cid = _nid").select(F.col("_nid").alias("_id"), "concept_name")
    return (agg.join(names, F.col("_nid") == F.col("_id"), "left")
            .select(C.name_or("concept_name", fallback).alias("concept_name"), count_name, "patient_count")
            .orderBy(F.desc("patient_count"), F.desc(count_name), F.asc("concept_name")).limit(n))


# AGG-08 -----------------------------------------------------------------------
def top_measurements(named: DataFrame, n: int = 8, name: str = "concept_name") -> DataFrame:
    """Most recorded numeric measurement types."""
    numeric = named.filter(F.col("value_as_number").isNotNull())
    return (numeric.groupBy(name).agg(F.count("measurement_id").alias("count"))
            .orderBy(F.desc("count"), F.asc(name)).limit(n))


def measurement_totals(named: DataFrame, name: str = "concept_name") -> DataFrame:
    numeric = named.filter(F.col("value_as_number").isNotNull())
    return numeric.agg(F.count(F.lit(1)).alias("numeric_records"), F.countDistinct(name).alias("measurement_types"))


# AGG-09 -----------------------------------------------------------------------
def iqr_fence(df: DataFrame, col: str, by: list[str], k: float = 3.0, approx: bool = False) -> DataFrame:
    """Keep values within [q1 - k*iqr, q3 + k*iqr] of their group when iqr > 0.

    Quartiles are exact (linear interpolation, from value counts) unless
    ``approx``; one row per group is joined back, broadcast when counted small,
    so that a group holding most rows is not moved.
    """
    v = F.col(col)
    if approx:
        quart = (df.filter(v.isNotNull()).groupBy(*by).agg(F.percentile_approx(v, [0.25, 0.75], 10000).alias("_q"))
                 .select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3")))
    else:
        quart = exact_quantiles(df, by, col, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    keep = (iqr <= 0) | v.between(F.col("q1") - k * iqr, F.col("q3") + k * iqr)
    return df.filter(v.isNotNull()).join(checked_broadcast(quart), by, "inner").filter(keep).drop("q1", "q3")


# AGG-10 -----------------------------------------------------------------------
def modal_value(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Most frequent non-blank value per group; ties -> the lowest value.

    Two-level: counts per (group, value), then ``min_by`` per group, so no
    group's values are ever collected in one map.
    """
    v = F.col(col)
    counts = (df.filter(v.isNotNull() & (F.trim(v.cast("string")) != ""))
              .groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(f"modal_{col}"))


# AGG-11 -----------------------------------------------------------------------
def distinct_per_person(df: DataFrame, col: str, out: str = "condition_count") -> DataFrame:
    c = F.col(col)
    return df.filter(c.isNotNull() & (c != 0)).groupBy("person_id").agg(F.countDistinct(col).alias(out))


# AGG-12 -----------------------------------------------------------------------
def band_share(df: DataFrame, count_col: str) -> DataFrame:
    """Patients per count band with percent of all patients; empty bands kept."""
    spark = df.sparkSession
    banded = df.select(C.count_band(count_col).alias("band"))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("patient_count"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = C.count_band_frame(spark).join(F.broadcast(counts), "band", "left")
    out = _with_scalar(out, total)
    return out.select("band_order", "band", F.coalesce("patient_count", F.lit(0)).cast("long").alias("patient_count"),
                      (F.coalesce("patient_count", F.lit(0)) * 100.0 / F.col("_total")).alias("percent"))


# AGG-13 -----------------------------------------------------------------------
def band_matrix(events: DataFrame, key: str, concept: DataFrame, person_bands: DataFrame, n: int = 10) -> DataFrame:
    """Age band x top-n name matrix of distinct patients (long form, zero-filled).

    ``events`` has person_id and the concept ``key``; ``person_bands`` one
    row per person_id with age_group. One pass over the events: they become
    distinct (name id, person), then one row per name id with a count for
    each band, from which both the top list and the cells are read.
    """
    bands = [label for _, label in C.AGE_BANDS]
    ids = name_ids(concept).filter("concept_name IS NOT NULL")
    pairs = _counted_per_person(events, key, ids, key, "person_id").filter("_nid IS NOT NULL")
    banded = pairs.join(person_bands.filter("age_group IS NOT NULL"), "person_id")
    wide = banded.groupBy("_nid").agg(F.count(F.lit(1)).alias("_all"), *[
        F.count_if(F.col("age_group") == b).alias(f"_b{i}") for i, b in enumerate(bands)])
    names = ids.filter("_cid = _nid").select(F.col("_nid").alias("_id"), "concept_name")
    top = (wide.join(names, F.col("_nid") == F.col("_id"))
           .orderBy(F.desc("_all"), F.asc("concept_name")).limit(n)
           .withColumn("name_rank", F.row_number().over(Window.orderBy(F.desc("_all"), F.asc("concept_name")))))
    cells = F.array(*[F.struct(F.lit(b).alias("age_group"), F.col(f"_b{i}").alias("patient_count"))
                      for i, b in enumerate(bands)])
    return (top.select("concept_name", "name_rank", F.posexplode(cells).alias("band_order", "_c"))
            .select("band_order", "_c.age_group", "name_rank", "concept_name",
                    F.col("_c.patient_count").cast("long").alias("patient_count")))


# AGG-14 -----------------------------------------------------------------------
def supply_summary(drug: DataFrame, cap: float = 0.99) -> DataFrame:
    """Days-supply coverage and the distribution below the p99 cap."""
    d = F.col("days_supply").cast("double")
    valid = drug.filter(d.isNotNull() & (d > 0)).select(d.alias("d"))
    coverage = drug.agg(F.count(F.lit(1)).alias("exposures"),
                        F.count_if(d.isNotNull() & (d > 0)).alias("with_supply"))
    limit = exact_quantiles(valid, [], "d", {"cap_value": cap}).first()[0]  # one number
    below = valid.filter(F.col("d") <= F.lit(limit).cast("double"))
    stats = below.agg(F.count(F.lit(1)).alias("n_below_cap"), F.avg("d").alias("mean_days"))
    stats = _with_scalar(stats, exact_quantiles(below, [], "d", {"median_days": 0.5}))
    out = _with_scalar(coverage, stats.withColumn("cap_value", F.lit(limit).cast("double")))
    return out.withColumn("coverage_pct", F.try_divide(F.col("with_supply") * 100.0, F.col("exposures")))


# AGG-15 -----------------------------------------------------------------------
def supply_by_drug(named_drug: DataFrame, n: int = 10, name: str = "concept_name") -> DataFrame:
    d = F.col("days_supply").cast("double")
    valid = named_drug.filter(d.isNotNull() & (d > 0)).select(name, d.alias("_d"))
    checkpoint_dir(valid.sparkSession)
    top = (valid.groupBy(name).agg(F.count("_d").alias("record_count"), F.avg("_d").alias("mean_days"))
           .orderBy(F.desc("record_count"), F.asc(name)).limit(n).checkpoint(eager=True))  # n rows
    # Only the values of the drugs in the report are looked at again.
    shown = top.select(F.col(name).alias("_top"))
    theirs = valid.join(F.broadcast(shown), F.col(name).eqNullSafe(F.col("_top")), "left_semi")
    middle = exact_quantiles(theirs, [name], "_d", {"median_days": 0.5})
    return join_groups(top, middle, [name]).select(name, "record_count", "median_days", "mean_days").orderBy(
        F.desc("record_count"), F.asc(name))


# AGG-16 -----------------------------------------------------------------------
def note_features(note: DataFrame, concept: DataFrame) -> DataFrame:
    out = note.withColumn("note_length", C.char_len("note_text")).withColumn("word_count", C.word_count("note_text"))
    out = with_concept(out, "note_type_concept_id", concept, "note_type", fallback=C.UNMAPPED_NOTE_TYPE)
    return out.withColumn("note_year", F.year("note_date"))


def note_summary(features: DataFrame) -> DataFrame:
    """Corpus statistics. Patients come from the per-person counts; the medians are exact, from two passes over the
    lengths, whose texts are measured once."""
    checkpoint_dir(features.sparkSession)
    sizes = features.select("person_id", "note_length", "word_count").checkpoint(eager=True)  # numbers only
    per_person = sizes.groupBy("person_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("_n").agg(
        F.count(F.lit(1)).alias("_times"), F.count("person_id").alias("_known")).checkpoint(eager=True)
    corpus = sizes.agg(F.count(F.lit(1)).alias("notes"), F.avg("note_length").alias("mean_chars"),
                       F.max("note_length").alias("max_chars"), F.avg("word_count").alias("mean_words"),
                       F.max("word_count").alias("max_words"))
    people = per_person.agg(F.sum("_known").alias("patients"),
                            (F.sum(F.col("_n") * F.col("_times")) / F.sum("_times")).alias("mean_notes_per_patient"),
                            F.max("_n").alias("max_notes_per_patient"))
    middle = exact_medians(sizes, [], {"median_chars": "note_length", "median_words": "word_count"})
    notes = count_quantiles(per_person, [], "_n", "_times", {"median_notes_per_patient": 0.5})
    out = _with_scalar(_with_scalar(_with_scalar(corpus, people), middle), notes)
    return out.select("notes", "mean_chars", "median_chars", "max_chars", "mean_words", "median_words", "max_words",
                      "patients", "mean_notes_per_patient", "median_notes_per_patient", "max_notes_per_patient")


def note_types(features: DataFrame, n: int = 10) -> DataFrame:
    return (features.groupBy("note_type").agg(F.count(F.lit(1)).alias("notes"))
            .orderBy(F.desc("notes"), "note_type").limit(n))


# AGG-17 -----------------------------------------------------------------------
def notes_by_year(features: DataFrame) -> DataFrame:
    return (features.filter(F.col("note_year").isNotNull()).groupBy("note_year")
            .agg(F.count(F.lit(1)).alias("notes")).orderBy("note_year"))


# AGG-18 -----------------------------------------------------------------------
def range_checked(measurement: DataFrame) -> DataFrame:
    """PRJ-27 rows: value and both limits present, low <= high, with status."""
    m = measurement.filter(F.col("value_as_number").isNotNull() & F.col("range_low").isNotNull()
                           & F.col("range_high").isNotNull() & (F.col("range_low") <= F.col("range_high")))
    return m.withColumn("status", C.range_status("value_as_number", "range_low", "range_high"))


def abnormal_rates(checked_named: DataFrame, n: int = 10, name: str = "concept_name") -> DataFrame:
    st = F.col("status")
    agg = checked_named.groupBy(name).agg(
        F.count("measurement_id").alias("total"), F.count_if(st == "Low").alias("n_low"),
        F.count_if(st == "High").alias("n_high"),
        (F.avg((st != "Normal").cast("double")) * 100).alias("pct_abnormal"))
    return agg.orderBy(F.desc("pct_abnormal"), F.desc("total"), F.asc(name)).limit(n)


def abnormal_overall(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("with_range"),
                       F.count_if(F.col("status") != "Normal").alias("abnormal"),
                       (F.avg((F.col("status") != "Normal").cast("double")) * 100).alias("pct_abnormal"))


# AGG-19 -----------------------------------------------------------------------
def topic_shares(flags: DataFrame, topics: list[str]) -> DataFrame:
    """Matches and share per topic, plus any-match and no-match rows."""
    any_ = F.greatest(*[F.col(f"`{t}`").cast("int") for t in topics])
    wide = flags.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.sum(F.col(f"`{t}`").cast("int")).alias(t) for t in topics],
                     F.sum(any_).alias("__any"), F.sum(1 - any_).alias("__none"))
    names = topics + ["__any", "__none"]
    stack = ", ".join(f"'{t}', `{t}`" for t in names)
    out = wide.selectExpr("_n", f"stack({len(names)}, {stack}) as (topic, matches)")
    out = out.withColumn("topic", F.when(F.col("topic") == "__any", "Any category")
                         .when(F.col("topic") == "__none", "No category").otherwise(F.col("topic")))
    return out.select("topic", F.coalesce(F.col("matches"), F.lit(0)).cast("long").alias("matches"),
                      F.try_divide(F.col("matches") * 100.0, F.col("_n")).alias("percent"))


# AGG-26 -----------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str, exclude: str | None = None) -> DataFrame:
    c = F.col(col)
    keep = c.isNotNull() if exclude is None else (c.isNotNull() & (c != exclude))
    return df.filter(keep).agg(F.countDistinct(col).alias("distinct_values"))
