"""Letter dataset building (PRJ-16/17, JON-06..08, WIN-07..13, SET-01..03, AGG-20/24).

Samples are rows, splits are a ``split`` column. Every ordering that the
reference takes from a seeded shuffle is a reproducible hash order
(``seeded_key``), so Spark and any SQL engine pick the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import splits
from cohortlens.operators.bloom import bloom_filter, filter_bits, maybe_in
from cohortlens.operators.dist import checked_broadcast, last_rows, order_key, seeded_cuts
from cohortlens.operators.splits import check_grouped_input  # noqa: F401
from cohortlens.session import checkpoint_dir

# Note-length bounds of the candidate pool, text limit, split fractions.
MIN_NOTE_CHARS = 100
MAX_NOTE_CHARS = 2000
TRAIN_FRACTION = 0.8
VALIDATION_FRACTION = 0.10
MIN_SPLIT_ROWS = 10
OUTER_FOLDS = 5
INNER_FOLDS = 8
SEED = 42


# WIN-12 -----------------------------------------------------------------------
def candidate_pool(note: DataFrame, min_chars: int = MIN_NOTE_CHARS, max_chars: int = MAX_NOTE_CHARS,
                   at_least: int = 0) -> DataFrame:
    """All notes whose length lies within the bounds; null notes are out.

    Fewer than ``at_least`` of them is an error.
    """
    pool = note.filter(F.length("note_text").between(min_chars, max_chars))
    if at_least:
        require_rows(pool, at_least)
    return pool


def require_rows(df: DataFrame, n: int, what: str = "notes") -> None:
    """Error when fewer than ``n`` rows are there to draw from; the count stops at ``n``."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"{n} {what} wanted, {have} available")


# WIN-07 -----------------------------------------------------------------------
def _taken(df: DataFrame, id_col: str, seed: int, quota: DataFrame) -> DataFrame:
    """Every row with ``_in``: whether it is among the first ``quota`` rows of the seeded order."""
    cut = seeded_cuts(df, [], id_col, seed, quota)  # at most one row
    return (df.join(F.broadcast(cut), F.lit(True), "left")
            .withColumn("_in", F.coalesce(order_key(id_col, seed) <= F.col("cut"), F.lit(False))).drop("cut"))


def seeded_sample(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of the reproducible hash order (rows with one id are taken together)."""
    quota = df.sparkSession.createDataFrame([(n,)], "quota long")
    return _taken(df, id_col, seed, quota).filter("_in").drop("_in")


# WIN-08 -----------------------------------------------------------------------
def ordered_split(df: DataFrame, id_col: str, seed: int, fraction: float = TRAIN_FRACTION,
                  first: str = "train", rest: str = "test") -> DataFrame:
    """First floor(fraction * n) rows of the seeded order -> ``first``, others -> ``rest``.

    The rows themselves are neither sorted nor shuffled: each is compared with the one cut.
    """
    quota = df.agg(F.floor(F.count(F.lit(1)) * fraction).cast("long").alias("quota"))
    return _taken(df, id_col, seed, quota).withColumn("split", F.when(F.col("_in"), first).otherwise(rest)).drop("_in")


# WIN-09 -----------------------------------------------------------------------
def class_quotas(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """Held-out rows per class: ceil(fraction * n) overall, shared by largest remainder."""
    return _quotas(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")), label, fraction)


def _quotas(counts: DataFrame, label: str, fraction: float) -> DataFrame:
    w_all = Window.partitionBy()
    n = F.sum("n_class").over(w_all)
    n_test = F.ceil(n * fraction)
    exact = n_test * F.col("n_class") / n
    q = (counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
         .withColumn("_left", n_test - F.sum("_floor").over(w_all))
         .withColumn("_rk", F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")),
                                                               F.col(label)))))
    return q.select(label, "n_class", (F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0))
                    .cast("long").alias("quota"))


def stratified_split(df: DataFrame, id_col: str, label: str, fraction: float = VALIDATION_FRACTION,
                     seed: int = SEED, held: str = "validation", rest: str = "train", least_rows: int = 0) -> DataFrame:
    """Stratified hold-out: the first ``quota`` rows of each class in seeded order.

    One cut per class, found from counts; every row is compared with its
    class's cut where it is, so a dominant class is not moved at all. With
    ``least_rows`` (``MIN_SPLIT_ROWS`` for a training set) fewer rows, or a
    single class, is an error.
    """
    checkpoint_dir(df.sparkSession)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")).checkpoint(eager=True)  # one row per class
    if least_rows:
        _check_classes(counts.agg(F.coalesce(F.sum("n_class"), F.lit(0)), F.count(label)).first(), least_rows)
    quotas = _quotas(counts, label, fraction)
    cuts = seeded_cuts(df, [label], id_col, seed, quotas).withColumnRenamed(label, "_class")
    return (df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_class")), "left")  # one row per class
            .withColumn("split", F.when(F.coalesce(order_key(id_col, seed) <= F.col("cut"), F.lit(False)), held)
                        .otherwise(rest)).drop("_class", "cut"))


def check_stratified_input(df: DataFrame, label: str, least_rows: int = MIN_SPLIT_ROWS) -> None:
    """Error unless there are ``least_rows`` rows or more and 2 classes or more."""
    _check_classes(df.agg(F.count(F.lit(1)), F.countDistinct(label)).first(), least_rows)


def _check_classes(stats, least_rows: int) -> None:
    rows, classes = stats
    if rows < least_rows:
        raise ValueError(f"a stratified split needs {least_rows} rows or more, got {rows}")
    if classes < 2:
        raise ValueError(f"a stratified split needs 2 classes or more, got {classes}")


# WIN-10 -----------------------------------------------------------------------
def grouped_split(df: DataFrame, group: str, label: str, seed: int = SEED,
                  folds: tuple[int, int] = (OUTER_FOLDS, INNER_FOLDS)) -> DataFrame:
    """Grouped stratified split: no group in two splits, each with its share of the rows and labels.

    Fewer than 8 groups or a single label is an error.
    """
    return splits.grouped_split(df, group, label, seed, folds)


# WIN-11 -----------------------------------------------------------------------
def leaks(df: DataFrame, key, split: str = "split") -> DataFrame:
    """Keys found in more than one split (all split pairs at once). Empty = no leakage."""
    k = F.col(key) if isinstance(key, str) else key
    return (df.select(k.alias("leak_key"), F.col(split)).groupBy("leak_key")
            .agg(F.countDistinct(split).alias("n_splits"), F.array_join(F.sort_array(F.collect_set(split)), ",")
                 .alias("splits"))
            .filter(F.col("n_splits") > 1))


# WIN-13 -----------------------------------------------------------------------
def last_record(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Last record per key wins; of records with one ``order``, the one of the greatest row hash."""
    return last_rows(df, [key] if isinstance(key, str) else key, order)


# JON-06 -----------------------------------------------------------------------
def line_hashes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Normalised hash of every non-blank line."""
    lines = df.select(id_col, F.explode(F.split(F.col(text), "\n")).alias("_line"))
    return (lines.filter(F.trim(F.regexp_replace("_line", r"\s+", " ")) != "")
            .select(id_col, C.norm_hash("_line").alias("line_hash")))


#: Hashes (64 characters) that are broadcast, at most.
MAX_BROADCAST_HASHES = 500_000


def remove_overlap(train: DataFrame, test: DataFrame, text: str = "text", id_col: str = "doc_id",
                   test_text: str = "text", level: str = "document") -> DataFrame:
    """Training rows whose normalised text (or any normalised line) occurs in the test set are removed.

    The test hashes are counted. Up to ``MAX_BROADCAST_HASHES`` of them are
    broadcast. Beyond that, a Bloom filter of them, of bounded size, turns away
    the training hashes that cannot match before anything is shuffled; the few
    others meet the test hashes in an exact join. Texts are never shuffled for
    the look-up.
    """
    spark = train.sparkSession
    checkpoint_dir(spark)
    if level == "document":
        held = test.select(C.norm_hash(test_text).alias("_h"))
    else:
        held = line_hashes(test.withColumn("_tid", F.lit(0)), "_tid", test_text).select(F.col("line_hash").alias("_h"))
    hashes = held.filter("_h IS NOT NULL").distinct().checkpoint(eager=True)  # narrow; read by the filter and the join
    n_hashes = hashes.count()
    if n_hashes <= MAX_BROADCAST_HASHES:
        if level == "document":
            return train.withColumn("_h", C.norm_hash(text)).join(F.broadcast(hashes), "_h", "left_anti").select(train.columns)
        hit = line_hashes(train, id_col, text).join(F.broadcast(hashes), F.col("line_hash") == F.col("_h"), "left_semi")
        return train.join(checked_broadcast(hit.select(id_col).distinct()), id_col, "left_anti")
    bits = filter_bits(n_hashes)
    bitmaps = bloom_filter(hashes, "_h", bits).checkpoint(eager=True)
    if level == "document":
        marked = maybe_in(train.withColumn("_h", C.norm_hash(text)), "_h", bitmaps, bits, "_maybe")
        unsure = marked.filter("_maybe").join(hashes, "_h", "left_anti")
        return marked.filter("NOT _maybe").unionByName(unsure).drop("_h", "_maybe").select(train.columns)
    lines = maybe_in(line_hashes(train, id_col, text), "line_hash", bitmaps, bits, "_maybe").filter("_maybe")
    hit = lines.join(hashes, F.col("line_hash") == F.col("_h"), "left_semi").select(id_col).distinct()
    # Counted: the ids that go are broadcast while they are few, else the rows meet them by a shuffle.
    return train.join(checked_broadcast(hit), id_col, "left_anti")


# JON-07 -----------------------------------------------------------------------
def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


# JON-08 -----------------------------------------------------------------------
def merge_labels(letters: DataFrame, results: DataFrame, key: str = "note_id") -> tuple[DataFrame, DataFrame]:
    """Resolved letters get the new label; the rest are unresolved with a reason.

    ``results``: key, status ('resolved'/'unresolved'), label, label_failed, error_type.
    """
    joined = letters.join(results.withColumnRenamed("label", "new_label"), key, "left")
    resolved = (joined.filter(F.col("status") == "resolved")
                .withColumn("original_label", C.parse_int01("label"))
                .withColumn("label", F.col("new_label").cast("int"))
                .withColumn("label_name", F.when(F.col("label") == 1, "treatment_event").otherwise("routine_followup"))
                .withColumn("label_changed", F.col("original_label").isNotNull()
                            & (F.col("label") != F.col("original_label")))
                .withColumn("label_failed", F.lit(False))
                .drop("new_label", "status", "error_type"))
    unresolved = (joined.filter(F.col("status").isNull() | (F.col("status") != "resolved"))
                  .withColumn("label_failed", F.coalesce(F.col("label_failed"), F.lit(False)))
                  .withColumn("unresolved_reason", F.when(F.col("label_failed"), "api_failure")
                              .otherwise("labeller_uncertain"))
                  .drop("new_label", "status"))
    return resolved, unresolved


# AGG-20 / AGG-24 ----------------------------------------------------------------
def class_counts(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def relabel_counts(resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    r = resolved.agg(F.count(F.lit(1)).alias("n_resolved"),
                     F.count_if("label_changed").alias("n_changed"),
                     F.count_if(F.col("label") == 0).alias("n_label_0"),
                     F.count_if(F.col("label") == 1).alias("n_label_1"),
                     F.count_if(F.col("split") == "train").alias("n_train"),
                     F.count_if(F.col("split") == "validation").alias("n_validation"),
                     F.count_if(F.col("split") == "test").alias("n_test"))
    u = unresolved.agg(F.count(F.lit(1)).alias("n_unresolved"), F.count_if("label_failed").alias("n_failed"),
                       F.count_if(~F.col("label_failed")).alias("n_uncertain"))
    return r.withColumn("_one", F.lit(1)).join(F.broadcast(u.withColumn("_one", F.lit(1))), "_one").drop("_one")


# SET-01..03 -------------------------------------------------------------------
def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def concat(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, present, n_null): whether each required column is there, and its rows without a value."""
    gone = set(missing_columns(df, names))
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names if c not in gone])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c not in gone).alias("present"),
                              (F.lit(None) if c in gone else F.col(c)).cast("long").alias("n_null")) for c in names])
    return counts.select(F.explode(rows).alias("_r")).select("_r.*")


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


# PRJ-17 -----------------------------------------------------------------------
# Source names and challenge metadata fields.
TRAINING_SOURCE = "pifu_synthetic_training"
EXTERNAL_SOURCE = "eval_sample_150_v3"
CHALLENGE_FIELDS = ["document_type", "specialty", "referral_reason", "clock_stop_event_type", "non_clock_stop_scenario",
                    "hard_negative", "expected_reasoning"]


def _sample(df: DataFrame, sample_id, text: str, name, source: str, metadata) -> DataFrame:
    return df.select(sample_id.cast("string").alias("sample_id"), F.col(text).cast("string").alias("text"),
                     C.label_id(name).alias("label"), name.alias("label_name"), F.lit(source).alias("source"),
                     metadata.alias("metadata"))


_NO_METADATA = "cast(map() as map<string,string>)"


def training_samples(df: DataFrame, source: str = TRAINING_SOURCE) -> DataFrame:
    """Rows with ``input``, ``expected_output.pifu_assessment.eligibility`` and a ``metadata`` map.

    The id is the metadata's document id; when that is missing or empty, the
    first 16 characters of the normalised text hash.
    """
    name = F.upper(F.col("expected_output.pifu_assessment.eligibility").cast("string"))
    meta = F.coalesce(F.col("metadata"), F.expr(_NO_METADATA))
    given = F.nullif(F.try_element_at(meta, F.lit("document_id")), F.lit(""))
    return _sample(df, F.coalesce(given, F.substring(C.norm_hash("input"), 1, 16)), "input", name, source, meta)


def external_samples(df: DataFrame, source: str = EXTERNAL_SOURCE) -> DataFrame:
    """Rows with ``_idx``, ``_class``, ``input`` and a ``metadata`` map."""
    return _sample(df, F.concat(F.lit("eval_"), F.col("_idx").cast("string")), "input",
                   F.upper(F.col("_class").cast("string")), source, F.coalesce(F.col("metadata"), F.expr(_NO_METADATA)))


def challenge_samples(df: DataFrame, source: str) -> DataFrame:
    """Edge-case or hard-negative rows; the label follows the clock-stop rule. Absent fields are null in the metadata,
    ``hard_negative`` is then false."""
    value = {f: F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string") for f in CHALLENGE_FIELDS}
    value["hard_negative"] = F.coalesce(value["hard_negative"], F.lit("false"))
    meta = F.create_map(*[x for f in CHALLENGE_FIELDS for x in (F.lit(f), value[f])])
    return _sample(df, F.col("document_id"), "document_content",
                   C.challenge_label("is_clock_stop", "clock_stop_event_type"), source, meta)


def unknown_labels(samples: DataFrame) -> DataFrame:
    """Violation rows: label name missing or outside the label space."""
    return samples.filter(F.col("label").isNull() | (F.col("label") < 0))


def require_known_labels(samples: DataFrame) -> None:
    """Error that names one unknown label, if there is any."""
    bad = unknown_labels(samples).select("label_name").first()
    if bad is not None:
        raise ValueError(f"label {bad['label_name']!r} is not in the label space")
