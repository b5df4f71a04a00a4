"""Quality rules as a bitmask ledger (operator 2).

Every rule is evaluated once per document. The ledger row keeps the
measurements and one integer whose bit ``i`` is set when rule ``i`` failed.
A policy is a named, versioned set of rules; applying one, comparing two or
asking what a policy would do without one rule needs only bitwise arithmetic
on the ledger, never the texts again.

Edge cases: a null or blank text has no words, all counts are 0 and it fails
``few_words``. Repeated rows give one ledger row each. Columns other than
``doc_id`` and ``text`` are ignored, whatever their names. A null ``doc_id``
is carried through. ``n_letters`` counts A-Z, a-z and the characters from
U+00C0 on (by their first byte), ``n_upper`` A-Z only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices

#: Symbol characters counted by ``n_symbols`` (fixed by the contract).
SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
            "n_upper", "n_bangs"]
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    # One histogram of the bytes answers every character count.
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(byte[0x20] + byte[0x09:0x0E].sum())
    symbols = int(byte[_SYMBOL_BYTES].sum())
    upper = int(byte[0x41:0x5B].sum())
    letters = upper + int(byte[0x61:0x7B].sum() + byte[0xC3:].sum())
    seen: set[str] = set()
    dup_lines = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0  # end (exclusive) of the word positions counted so far
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return n, len(text) - spaces, symbols, dup_lines, repeated, lines, letters, upper, int(byte[0x21])


def measure(docs: DataFrame) -> DataFrame:
    """One row of measurements per document row."""

    def run(batches):
        names = ["doc_id", *MEASURES]
        for b in slices(batches):
            cols = list(zip(*(_measure(t) for t in b.column(1).to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEDGER_SCHEMA)


#: The rule book: name and the SQL condition under which a document breaks the
#: rule. Position is the rule's bit: append, never reorder.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("capitals", "100 * n_upper > 50 * n_letters"),
    ("exclamations", "5 * n_bangs > n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
]


def rule_bits() -> dict[str, int]:
    return {name: 1 << i for i, (name, _) in enumerate(RULES)}


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, all measurements, and ``fail_bits`` with one bit per rule."""
    bits = F.lit(0).cast("long")
    for i, (_, broken) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(broken), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: a document is kept when no named rule failed."""

    version: str
    names: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = rule_bits()
        return sum(known[n] for n in set(self.names))


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", BASE.names + ("symbol_ratio", "short_words", "long_words", "capitals")),
    Policy("v2", BASE.names + ("symbol_ratio", "short_words", "long_words", "capitals", "exclamations",
                               "few_letters")),
    Policy("strict", BASE.names + ("symbol_ratio", "duplicate_lines", "short_words", "long_words", "capitals",
                                   "exclamations", "few_letters")),
)}
CURRENT = "v2"


def passes(policy: Policy, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(ledger_df: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """What each rule does in each policy.

    Rows (version, rule, rejected_by_policy, failed_rule, rejected_only_by_rule):
    the last is how many documents come back when the rule is taken out. The
    ledger is first reduced to counts per bit pattern (map-side combined, at
    most 2^rules rows), so every policy and rule costs arithmetic on those.
    """
    policies = list(POLICIES.values()) if policies is None else policies
    patterns = ledger_df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("_n"))
    known = rule_bits()
    grid = [(p.version, p.mask, n, known[n]) for p in policies for n in p.names]
    spark = ledger_df.sparkSession
    cells = spark.createDataFrame(grid, "version string, mask long, rule string, rule_bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    # One row per policy and rule (fixed by the rule book), against the bit patterns.
    return (patterns.join(F.broadcast(cells), F.lit(True))
            .groupBy("version", "rule")
            .agg(F.sum(F.when(hit != 0, F.col("_n")).otherwise(0)).alias("rejected_by_policy"),
                 F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("rule_bit")) != 0, F.col("_n")).otherwise(0))
                 .alias("failed_rule"),
                 F.sum(F.when(hit == F.col("rule_bit"), F.col("_n")).otherwise(0)).alias("rejected_only_by_rule")))


def verdicts(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The contract's columns: measurements, the base verdict and the policy's verdict."""
    failed = ~passes(BASE)
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (passes(POLICIES[version]) & ~failed).alias("kept"), "fail_bits")


def keep_passing(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """Pipeline form: the documents that pass, with their own columns.

    The rules are evaluated beside the row, so nothing is shuffled.
    """
    names = docs.columns
    spark_cols = ", ".join(f"`_c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    at = names.index("text")

    def run(batches):
        for b in slices(batches):
            cols = list(zip(*(_measure(t) for t in b.column(at).to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.int64()) for c in cols)],
                [*(f"_c{i}" for i in range(len(names))), *MEASURES])

    measured = docs.mapInArrow(run, f"{spark_cols}, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = POLICIES[version].mask | BASE.mask
    for i, (_, broken) in enumerate(RULES):
        if mask >> i & 1:
            measured = measured.filter(~F.expr(broken))
    return measured.select([F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
