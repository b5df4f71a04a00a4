"""Registered queries of the training-data operators: ``opN_<name>`` over the
whole intended table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import (cotraining, cross_entropy, hard_negatives, html_blocks, language_codes,
                            lsh_forest, mixing, quality_ledger, quote_links, simhash, spaced_seeds, suffix_index,
                            token_alignment)
from cohortlens.llm.common import read_table

Build = Callable[[SparkSession, str], DataFrame]


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: flat blocks classified by a decision tree."""
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quality rule measured once; base verdict and the current policy's verdict."""
    return quality_ledger.verdicts(read_table(spark, sf_dir, "documents"))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    return language_codes.identify(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier, and what remains."""
    return suffix_index.digest(read_table(spark, sf_dir, "documents"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, linked to what they quote, in reply order."""
    return quote_links.threads(read_table(spark, sf_dir, "conversations"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every document from two co-trained views."""
    return cotraining.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix: hierarchical budgets, whole epochs and a seeded token prefix."""
    return mixing.choose(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash of 3-word shingles; components of fingerprints within 3 bits."""
    return simhash.digest(read_table(spark, sf_dir, "documents"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a near-verbatim 13-token window with a benchmark item."""
    return spaced_seeds.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per-token loss difference between the good documents' model and the corpus model."""
    labels = read_table(spark, sf_dir, "labels")
    return cross_entropy.score(read_table(spark, sf_dir, "documents"), cross_entropy.good_documents(labels))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over the bytes of every document: groups, links and their corpus counts."""
    return token_alignment.digest(read_table(spark, sf_dir, "documents"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 0.85 alike, from an LSH forest."""
    return lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector: slots below its positives' upper limits."""
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Build] = {f.__name__: f for f in (
    op1_html_blocks, op2_quality_ledger, op3_language_codes, op4_suffix_dedup, op5_quote_links, op6_cotraining,
    op7_mixing, op8_simhash, op9_spaced_seeds, op10_cross_entropy, op11_token_alignment,
    op12_lsh_forest, op13_hard_negatives)}


_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
tok AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT r, i, word AS a, lead(word, 1) OVER (PARTITION BY r ORDER BY i) AS b,
               lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM tok),
rep AS (SELECT r, i FROM (SELECT r, i, c, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL)
        WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY r),
lin AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines
        FROM (SELECT r, line, count(*) AS n FROM lin WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line)
        GROUP BY r),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
    length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{10FFFF}]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
f AS (
  SELECT *, (n_words < 50)::BIGINT
    + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 14 * n_words)::BIGINT
    + 64 * (100 * n_upper > 50 * n_letters)::BIGINT
    + 128 * (5 * n_bangs > n_words)::BIGINT
    + 256 * (2 * n_letters < word_chars)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & {mask}) = 0 AS kept, fail_bits
FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_ledger": _OP2_SQL.replace(
        "{mask}", str(quality_ledger.POLICIES[quality_ledger.CURRENT].mask | quality_ledger.BASE.mask)),
    "op7_mixing": mixing.sql(),
    "op9_spaced_seeds": spaced_seeds.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
