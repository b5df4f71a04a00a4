"""The training-corpus pipeline: quality rules, SimHash near-duplicates,
repeated passages, benchmark leaks, and the mix.

Every stage is one operator of ``cohortlens.llm``; it gets what its predecessor
kept (written as Parquet and read again) and its decisions take effect: bad
documents go, one document of each near-duplicate group stays, repeated
passages are cut out of the texts, leaked documents go, and the mix keeps each
chosen document with its number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import mixing, quality_ledger, simhash, spaced_seeds, suffix_index
from cohortlens.llm.common import read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_ledger.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash fingerprints within 3 bits (3-word shingles)."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier."""
    return suffix_index.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no near-verbatim window with a benchmark item."""
    return spaced_seeds.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with ``n_tokens`` and ``copies``."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mix_sources", mix_sources),
]

#: SimHash (XXH64 bit votes) and components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
