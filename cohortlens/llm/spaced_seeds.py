"""Benchmark decontamination with spaced-seed hashes (operator 9, DataFrame functions only).

A document is contaminated by a benchmark item when some ``WINDOW`` (13)
consecutive tokens of both agree in at least ``MATCHES`` (11) positions.
Tokens are the lower-cased runs of letters and digits.

Seeds. A mask says which positions of a short stretch are hashed; the others
are ignored, so a substitution there does no harm. Every placement of two
substitutions in 13 tokens leaves at least one placement of one of ``MASKS``
untouched (tests check all of them), so every contaminated window is hit.
Every document position is hashed under every mask in one code-generated
stage; the hashes are joined to those of the benchmark, and for each hit the
windows of 13 tokens around it are compared token by token.

The benchmark's hashes are broadcast while their counted number is at most
``BROADCAST_SEEDS``, and then nothing is shuffled before the few verified
rows. Beyond it, narrow (document, position, hash) rows are shuffled on the
hash, reduced to distinct (document, item, places) and verified after a join
with the texts, of which each hit takes the tokens in its reach.

An item of fewer than 13 tokens is its own window: a document that holds all of
its tokens in a row is contaminated by it (exact runs of that length, hashed and
compared). The SQL twin has only the windows of 13.

Edge cases: null or empty texts are never part of a match. A null doc_id or item_id is carried through.
Repeated documents give one row per (doc_id, item_id). Empty tables give an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
WINDOW, MATCHES = 13, 11
#: Lossless for two substitutions in 13 tokens.
MASKS = ("11010111", "111001011")
#: Tokens of a window before a seed at most.
REACH = WINDOW - min(map(len, MASKS))
#: 16 bytes of key and value each: at most about 100 MB as a hash table.
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _hashes(words: Column, at: Column) -> list[Column]:
    return [F.xxhash64(F.lit(m), *[F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"])
            for m, mask in enumerate(MASKS)]


def seeds(df: DataFrame, words: str, at: str) -> DataFrame:
    """One row per position of the token array ``words`` and mask: the frame with ``at`` and ``_seed``."""
    shortest = min(map(len, MASKS))
    placed = (df.filter(F.size(words) >= WINDOW)
              .select("*", F.explode(F.sequence(F.lit(0), F.size(words) - shortest)).alias(at)))
    return placed.select("*", F.explode(F.array(*_hashes(F.col(words), F.col(at)))).alias("_seed"))


def _verified(hits: DataFrame) -> DataFrame:
    """(doc_id, _k, _start, _n): the windows around a seed that agree in MATCHES positions.

    ``hits``: doc_id, _words with the seed at _i, _k, _item with the seed at _j; _start counts from ``_off`` tokens before
    _words. Built-in scalar functions only, so that the rows of a document stream through the code-generated stage:
    before a lambda they would all be buffered, each with its tokens.
    """
    def alike(k: int) -> Column:
        same = F.get("_words", F.col("_i") - REACH + k) == F.get("_item", F.col("_j") - REACH + k)
        return F.when(same, 1 << k).otherwise(0)

    inside = F.least(F.size("_words") - F.col("_i"), F.size("_item") - F.col("_j")) + (REACH - WINDOW)
    compared = hits.select(
        "doc_id", "_k", (F.col("_off") + F.col("_i") - REACH).alias("_first"),
        (REACH - F.least(F.col("_i"), F.col("_j"))).alias("_low"), inside.alias("_high"),
        reduce(Column.bitwiseOR, map(alike, range(WINDOW + REACH))).alias("_same"))
    # Windows that begin _t tokens after _first and lie inside both texts.
    counts = F.array(*[F.when((F.col("_low") <= t) & (F.col("_high") >= t),
                              F.bit_count(F.col("_same").bitwiseAND((1 << WINDOW) - 1 << t)))
                       for t in range(REACH + 1)])
    return (compared.select("doc_id", "_k", "_first", F.posexplode(counts).alias("_t", "_n"))
            .filter(F.col("_n") >= MATCHES)
            .select("doc_id", "_k", (F.col("_first") + F.col("_t")).alias("_start"), "_n"))


def _short_matches(texts: DataFrame, items: DataFrame, broadcast_seeds: int) -> DataFrame | None:
    """(doc_id, item_id, best, token_start, token_end): places in (doc_id, _words) that repeat a whole item of fewer than
    WINDOW tokens; None without such items."""
    keyed = items.filter(F.size("_item") > 0).distinct().withColumn("_bseed", F.xxhash64("_item"))
    sizes = keyed.groupBy(F.size("_item").alias("n")).count().collect()  # at most WINDOW - 1 rows
    if not sizes:
        return None
    if sum(r["count"] for r in sizes) <= broadcast_seeds:
        keyed = F.broadcast(keyed)
    here = F.array(*[F.lit(r.n) for r in sizes]).cast("array<int>")
    runs = (texts.select("doc_id", "_words", F.explode(here).alias("_n")).filter(F.size("_words") >= F.col("_n"))
            .select("doc_id", "_words", "_n", F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("_n"))).alias("_at"))
            .select("doc_id", "_at", "_n", F.slice("_words", F.col("_at") + 1, F.col("_n")).alias("_run")))
    return (runs.withColumn("_seed", F.xxhash64("_run"))
            .join(keyed, (F.col("_seed") == F.col("_bseed")) & (F.col("_run") == F.col("_item")))
            .select("doc_id", "item_id", F.col("_n").alias("best"), F.col("_at").alias("token_start"),
                    (F.col("_at") + F.col("_n")).alias("token_end")))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, best, token_start, token_end) of every contaminated pair.

    ``best`` is the largest number of equal tokens in a window; the token range
    spans all qualifying windows in the document.
    """
    # Out of a generator the tokens are made once; a projection is repeated in filters.
    texts = docs.select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("_words"))
    items_of = benchmark.select("item_id", tokens(F.col("text")).alias("_item"))
    items = items_of.filter(F.size("_item") >= WINDOW)
    # Items of the same tokens are compared once.
    keyed = items.select("_item").distinct().select(F.xxhash64("_item").alias("_k"), "_item")
    bench = seeds(keyed, "_item", "_j").select("_k", "_j", F.col("_seed").alias("_bseed"))
    named = items.select(F.xxhash64("_item").alias("_k"), "item_id").distinct()
    if bench.count() <= broadcast_seeds:
        found = (seeds(texts, "_words", "_i").join(F.broadcast(bench), F.col("_seed") == F.col("_bseed"))
                 .join(F.broadcast(keyed), "_k").withColumn("_off", F.lit(0)))
    else:
        narrow = (seeds(texts, "_words", "_i").select("doc_id", "_i", "_seed")
                  .join(bench, F.col("_seed") == F.col("_bseed"))
                  .select(F.col("doc_id").alias("_id"), "_k", "_i", "_j").distinct())
        off = F.greatest(F.col("_i") - REACH, F.lit(0))
        found = (texts.join(narrow, F.col("doc_id").eqNullSafe(F.col("_id")))
                 .select("doc_id", "_k", "_j", off.alias("_off"), (F.col("_i") - off).alias("_i"),
                         F.slice("_words", off + 1, WINDOW + REACH).alias("_words"))
                 .join(keyed, "_k"))
    by_text = (_verified(found).groupBy("doc_id", "_k")
               .agg(F.max("_n").alias("best"), F.min("_start").alias("token_start"),
                    (F.max("_start") + WINDOW).alias("token_end")))
    every = (by_text.join(F.broadcast(named) if named.count() <= broadcast_seeds else named, "_k")
             .select("doc_id", "item_id", "best", "token_start", "token_end"))
    short = _short_matches(texts, items_of.filter(F.size("_item") < WINDOW), broadcast_seeds)
    if short is not None:
        every = every.unionByName(short)
    return (every.groupBy("doc_id", "item_id")
            .agg(F.max("best").alias("best"), F.min("token_start").alias("token_start"),
                 F.max("token_end").alias("token_end")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: the documents with no contaminated pair, with their own columns.

    Documents are named by id and a hash of the text, so rows that share an id
    (or have none) are judged each by its own text.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text"))
    named = docs.select(key.alias("doc_id"), "text")
    bad = overlaps(named, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    bad = bad.select(F.col("_bad.doc_id").alias("_bad_id"), F.col("_bad.col2").alias("_bad_text"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_text")),
                     "left_anti")


def _literal(mask: str, words: str, at: str) -> str:
    return " || chr(31) || ".join(f"{words}[{at} + {i + 1}]" for i, b in enumerate(mask) if b == "1")


#: The same rule in DuckDB: spaced seeds as joined strings, verified along the diagonal.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS v FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - {min(map(len, MASKS)) - 1})) AS i FROM d WHERE len(w) >= {WINDOW}),
bp AS (SELECT item_id, v, unnest(range(0, len(v) - {min(map(len, MASKS)) - 1})) AS j FROM b WHERE len(v) >= {WINDOW}),
ds AS ({" UNION ALL ".join(f"SELECT doc_id, w, i, {m} AS m, {_literal(x, 'w', 'i')} AS s FROM dp"
                           for m, x in enumerate(MASKS))}),
bs AS ({" UNION ALL ".join(f"SELECT item_id, v, j, {m} AS m, {_literal(x, 'v', 'j')} AS s FROM bp"
                           for m, x in enumerate(MASKS))}),
h AS (SELECT DISTINCT doc_id, item_id, w, v, i - j AS sh FROM ds JOIN bs USING (m, s)),
o AS (SELECT *, greatest(0, -sh) AS a, least(len(v), len(w) - sh) AS z FROM h),
p AS (SELECT doc_id, item_id, w, v, sh, unnest(range(a, z - {WINDOW - 1})) AS t FROM o WHERE z - a >= {WINDOW}),
c AS (SELECT doc_id, item_id, t + sh AS tok,
        {" + ".join(f"(v[t + {k + 1}] = w[t + sh + {k + 1}])::INT" for k in range(WINDOW))} AS n FROM p)
SELECT doc_id, item_id, max(n)::INT AS best, min(tok)::INT AS token_start, max(tok + {WINDOW})::INT AS token_end
FROM c WHERE n >= {MATCHES} GROUP BY doc_id, item_id
"""
