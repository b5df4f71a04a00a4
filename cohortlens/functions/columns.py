"""Column expressions (PRJ operators). All are JVM built-ins: they stay inside
whole-stage codegen and never leave the executor."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference year for approximate age.
REFERENCE_YEAR = 2024
# Age bands, right-closed upper bounds, and their labels.
AGE_BANDS = [(17, "0–17"), (29, "18–29"), (44, "30–44"), (59, "45–59"), (74, "60–74"), (None, "75+")]
# Count bands (inclusive bounds) and their labels.
COUNT_BANDS = [(0, 0, "0 conditions"), (1, 1, "1 condition"), (2, 2, "2 conditions"),
               (3, 4, "3–4 conditions"), (5, 9, "5–9 conditions"), (10, None, "10+ conditions")]
# Fallback names for unmatched concepts, per use.
UNMAPPED_CONDITION = "Unmapped or missing condition"
UNMAPPED_MEDICATION = "Unmapped or missing medication"
UNMAPPED_MEASUREMENT = "Unmapped measurement"
UNMAPPED_DRUG_DURATION = "Unmapped medication"
UNMAPPED_NOTE_TYPE = "Unmapped note type"
# Three-class label space.
LABEL_NAMES = ["NOT_ELIGIBLE", "BORDERLINE", "ELIGIBLE"]
# Binary provisional label names.
BINARY_LABEL_NAMES = {0: "routine_followup", 1: "treatment_event", None: "uncertain"}
# Review thresholds.
CONFIDENCE_THRESHOLD = 0.80
MARGIN_THRESHOLD = 0.15


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# PRJ-05 -------------------------------------------------------------------
def age(year_of_birth, year: int = REFERENCE_YEAR) -> Column:
    return F.lit(year) - col_(year_of_birth)


# PRJ-06 -------------------------------------------------------------------
def age_band(age_col) -> Column:
    a = col_(age_col)
    expr = None
    for upper, label in AGE_BANDS:
        cond = a.isNotNull() if upper is None else (a <= upper)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def age_band_frame(spark):
    """Band dimension in fixed order, so zero rows survive left joins."""
    return spark.createDataFrame([(i, label) for i, (_, label) in enumerate(AGE_BANDS)],
                                 "band_order int, age_group string")


# PRJ-07 -------------------------------------------------------------------
def count_band(n) -> Column:
    c = col_(n)
    expr = None
    for lo, hi, label in COUNT_BANDS:
        cond = (c >= lo) if hi is None else c.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def count_band_frame(spark):
    return spark.createDataFrame([(i, label) for i, (_, _, label) in enumerate(COUNT_BANDS)],
                                 "band_order int, band string")


# PRJ-08 -------------------------------------------------------------------
def name_or(name, fallback: str) -> Column:
    return F.coalesce(col_(name), F.lit(fallback))


# PRJ-09 -------------------------------------------------------------------
def normalised_text(text) -> Column:
    return F.lower(F.trim(F.regexp_replace(col_(text), r"\s+", " ")))


def norm_hash(text) -> Column:
    return F.sha2(normalised_text(text), 256)


def raw_hash(text) -> Column:
    return F.sha2(col_(text), 256)


# PRJ-10 -------------------------------------------------------------------
def char_len(text) -> Column:
    return F.length(col_(text))


def word_count(text) -> Column:
    """Whitespace word count, equal to ``len(str.split())``."""
    return F.regexp_count(col_(text), F.lit(r"\S+"))


# PRJ-11 -------------------------------------------------------------------
def truncate(text, n: int) -> Column:
    return F.substring(col_(text), 1, n)


def ellipsize(text, n: int = 32) -> Column:
    """First ``n`` characters plus an ellipsis when longer."""
    t = col_(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def shorten(text, width: int, placeholder: str = "...") -> Column:
    """Word-boundary shortening: collapse whitespace, keep whole words so the
    result plus the placeholder fits ``width``."""
    t = F.trim(F.regexp_replace(col_(text), r"\s+", " "))
    room = width - len(placeholder)
    head = F.regexp_extract(t, r"^(.{0,%d})(?=\s|$)" % room, 1) if room > 0 else F.lit("")
    return F.when(F.length(t) <= width, t).otherwise(
        F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit(placeholder)))


# PRJ-12 -------------------------------------------------------------------
def keyword_hits(text, keywords: list[str]) -> Column:
    """Number of distinct keywords contained in the lower-cased text."""
    low = F.coalesce(F.lower(col_(text)), F.lit(""))
    return sum((low.contains(k.lower()).cast("int") for k in dict.fromkeys(keywords)), F.lit(0))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Whether any of the words occurs; plain ORs, which stay in generated code."""
    return reduce(or_, [lowered.contains(w.lower()) for w in words])


def provisional_label(text, positive: list[str], negative: list[str]) -> Column:
    pos = keyword_hits(text, positive)
    neg = keyword_hits(text, negative)
    return F.when(pos > neg, F.lit(1)).when(neg > pos, F.lit(0)).otherwise(F.lit(None)).cast("int")


def binary_label_name(label) -> Column:
    c = col_(label)
    return F.when(c == 0, BINARY_LABEL_NAMES[0]).when(c == 1, BINARY_LABEL_NAMES[1]).otherwise(
        BINARY_LABEL_NAMES[None])


# PRJ-13 -------------------------------------------------------------------
def topic_flags(df, text: str, topics: dict[str, list[str]], lowered: bool = False):
    """One boolean column per topic: any keyword contained (case-insensitive)."""
    low = F.coalesce(F.lower(F.col(text)), F.lit(""))
    cols = []
    for name, words in topics.items():
        cols.append(contains_any(low, words).alias(name))
    return df.select("*", *cols)


# PRJ-14 -------------------------------------------------------------------
def route(name, ordered_map: list[tuple[str, list[str]]], word_boundary: bool = False) -> Column:
    """First specialty (in map order) whose keyword occurs in the name; else null."""
    low = F.lower(col_(name))
    expr = None
    for specialty, words in ordered_map:
        if word_boundary:
            cond = low.rlike(r"\b(" + "|".join(re.escape(w.lower()) for w in words) + r")\b")
        else:
            cond = contains_any(low, words)
        expr = F.when(cond, specialty) if expr is None else expr.when(cond, specialty)
    return expr


def normalise_specialty(name) -> Column:
    return F.translate(F.regexp_replace(F.lower(col_(name)), r"^\s+|\s+$", ""), " -", "__")


# PRJ-15 -------------------------------------------------------------------
def parse_strict(c) -> Column:
    """'0' -> 0, '1' -> 1, 'U' -> null, anything else -> -1 (reported as invalid)."""
    v = F.upper(F.trim(col_(c).cast("string")))
    return F.when(v == "0", 0).when(v == "1", 1).when(v == "U", F.lit(None)).otherwise(-1).cast("int")


def parse_int01(c) -> Column:
    """Integer 0 or 1, anything else (text, other numbers, null) -> null."""
    v = col_(c).cast("string").try_cast("int")
    return F.when(v.isin(0, 1), v).cast("int")


def parse_generated(c) -> Column:
    """Leading 0/1/2 is the label; anything else is BORDERLINE and invalid."""
    text = F.coalesce(col_(c).cast("string"), F.lit(""))
    first = F.regexp_extract(F.trim(text), r"^([012])", 1)
    return F.struct(F.when(first != "", first.cast("int")).otherwise(F.lit(1)).alias("label"),
                    (first == "").alias("invalid"))


def parse_binary(c) -> Column:
    return F.trim(col_(c).cast("string")).startswith("1").cast("int")


# PRJ-16 -------------------------------------------------------------------
PIFU_EVENT = "Active Monitoring - Patient Initiated (PIFU)"


def challenge_label(is_stop, event_type) -> Column:
    ok = col_(is_stop).eqNullSafe(True) & col_(event_type).eqNullSafe(PIFU_EVENT)
    return F.when(ok, "ELIGIBLE").otherwise("NOT_ELIGIBLE")


# PRJ-18 -------------------------------------------------------------------
def render(template: str, text) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), col_(text).cast("string"))


# PRJ-20 -------------------------------------------------------------------
def softmax(scores) -> Column:
    s = col_(scores)
    m = F.array_max(s)
    ex = F.transform(s, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / total)


def sum_logprobs(token_logprobs) -> Column:
    """Candidate score = sum of its token log-probabilities (array<array<double>>)."""
    return F.transform(col_(token_logprobs), lambda toks: F.aggregate(toks, F.lit(0.0), lambda a, x: a + x))


# PRJ-21 -------------------------------------------------------------------
def argmax(probs) -> Column:
    p = col_(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_two_margin(probs) -> Column:
    s = F.sort_array(col_(probs), asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


# PRJ-27 -------------------------------------------------------------------
def range_status(value, low, high) -> Column:
    v, lo, hi = col_(value), col_(low), col_(high)
    return F.when(v < lo, "Low").when(v > hi, "High").otherwise("Normal")


# PRJ-29 -------------------------------------------------------------------
def label_name(label_id) -> Column:
    c = col_(label_id)
    return F.element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), c + 1)


def label_id(name) -> Column:
    c = F.upper(F.trim(col_(name)))
    return (F.array_position(F.array(*[F.lit(n) for n in LABEL_NAMES]), c) - 1).cast("int")


# PRJ-01 -------------------------------------------------------------------
def clamp_limit(n: int, maximum: int = 1000) -> int:
    return max(1, min(int(n), maximum))


def round6(c) -> Column:
    return F.round(col_(c), 6)
