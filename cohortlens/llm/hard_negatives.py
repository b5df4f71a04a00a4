"""Hard negatives by slot-decomposed selection (operator 13).

An anchor's positives are its best rows of the same label. A positive with
score s admits rows of other labels whose score lies in a window
[low % of s, high % of s]; the windows of one anchor overlap.

1. *Block join.* The anchors are a stated set (every ``every``-th id). Rows and
   anchors are dealt into groups of bounded size by a hash, and every group of
   anchors meets every group of rows in a cell of its own: the rows move once
   per anchor group, the anchors once per row group, and a cell is one product
   of two bounded matrices. No cell depends on a label, so frequent labels and
   repeated vectors are spread like all others.
2. *Positives.* Every cell returns the best positives of each anchor, at most
   ``positives`` rows; the best of those are the anchor's.
3. *Slots.* The distinct upper limits u1 > u2 > ... of an anchor's windows cut
   the scores into disjoint slots (u2, u1], (u3, u2], ... Every cell keeps the
   first ``negatives`` rows of each slot, and so does the merge of the cells.
4. *Suffixes.* The first rows of a window are the first rows of its slot and
   the slots below it, merged downwards, as far as its lower limit. So one
   ordered list per anchor (at most positives x negatives rows) answers all of
   its windows.

Scores are exact: components are whole numbers, products are taken in doubles
only where every partial sum is below 2^53, else in Python integers; scores
beyond the range of a long are held at its ends. Only vectors of the same
length are compared.

Edge cases: rows with a null label, a null vector or a null or non-finite
component take no part. Rows with a null id can be positives or negatives
(after all ids on a tie) but no anchors. "Other rows" of an anchor are rows of
another id. Anchor rows that agree in id, label and vector are one anchor;
repeated candidate rows each count. Empty tables give empty results. Columns
other than ``vec_id``, ``embedding`` and ``label`` are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

#: Most rows and anchors of a cell, fewest rows of one, and anchors scored at a time (32 MB of scores).
ROWS, LEAST_ROWS, ANCHORS, BLOCK = 1 << 15, 1 << 10, 1 << 14, 1 << 7
#: Components up to this size are multiplied in doubles, larger ones in Python integers.
TAME = 1 << 19
_LONG = np.iinfo(np.int64)


def prepared(rows: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part; every ``relabel_every``-th id has the next label."""
    x, label = F.col("embedding"), F.col("label").cast("long")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    noisy = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return (rows.filter(label.isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), noisy.alias("label"), "embedding"))


def anchors_of(rows: DataFrame, every: int = 100) -> DataFrame:
    """The stated set of anchors, with a key each."""
    key = F.xxhash64("vec_id", "label", "embedding").alias("key")
    return rows.filter(F.col("vec_id") % every == 0).select("vec_id", key, "label", "embedding").dropDuplicates(
        ["vec_id", "key"])


def matrix(vectors: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and whole components padded with zeros to the longest vector."""
    flat = vectors.combine_chunks() if vectors.num_chunks != 1 else vectors.chunk(0)
    n = np.diff(flat.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return n, np.floor(out * scale)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows, within the range of a long."""
    limit = TAME if a.shape[1] < 1 << 15 else 1 << 10
    wild_a, wild_x = (np.abs(m).max(axis=1, initial=0) > limit for m in (a, x))
    out = (np.where(wild_a[:, None], 0, a) @ np.where(wild_x[:, None], 0, x).T).astype(np.int64)
    if wild_a.any() or wild_x.any():
        for i, j in np.argwhere(wild_a[:, None] | wild_x[None, :]).tolist():
            exact = sum(int(u) * int(v) for u, v in zip(a[i], x[j]))
            out[i, j] = min(max(exact, _LONG.min), _LONG.max)
    return out


def first(score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of highest score, lower rows first on ties, in that order."""
    if len(rows) > k:
        s = score[rows]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = rows[s > least]
        rows = np.concatenate((above, rows[s == least][: k - len(above)]))
    return rows[np.lexsort((rows, ~score[rows]))]


def _cells(rows: DataFrame, anchors: DataFrame, pick, ddl: str, schema: pa.Schema, scale: int) -> DataFrame:
    """Every group of anchors against every group of rows; ``pick(score, anchor, ids, labels)`` chooses rows.

    ``pick`` yields (slot, row numbers in order); rows are in the order of ties.
    """
    spark = rows.sparkSession
    n, n_anchors = rows.count(), anchors.count()
    size = min(ROWS, max(LEAST_ROWS, n // (2 * max(1, spark.sparkContext.defaultParallelism))))
    r, c = max(1, -(-n // size)), max(1, -(-n_anchors // ANCHORS))
    # Dealt by place, not by value: equal rows spread as well.
    left = rows.withColumn("r", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(r))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = anchors.withColumn("c", F.pmod(F.xxhash64("vec_id", "key"), F.lit(c)).cast("int")).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))))

    def run(x: pa.Table, a: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in schema]
        if x.num_rows and a.num_rows:
            x = x.take(pa.compute.sort_indices(x, [("vec_id", "ascending")], null_placement="at_end"))
            ids, labels = x["vec_id"], x["label"].to_numpy()
            known = ids.fill_null(0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            n_x, mx = matrix(x["embedding"], scale)
            n_a, ma = matrix(a["embedding"], scale)
            who = a.drop_columns(["embedding", "r", "c"]).to_pylist()
            for width in np.unique(n_a).tolist():
                at, mine = np.flatnonzero(n_x == width), np.flatnonzero(n_a == width)
                for lo in range(0, len(mine) if len(at) else 0, BLOCK):
                    block = mine[lo:lo + BLOCK]
                    table = scores(ma[block, :width], mx[at, :width])
                    for anchor, s in zip((who[i] for i in block.tolist()), table):
                        other = null[at] | (known[at] != anchor["vec_id"])
                        for slot, got in pick(s, anchor, other, labels[at]):
                            out[0] += [anchor["vec_id"]] * len(got)
                            out[1] += [anchor["key"]] * len(got)
                            out[2] += [slot] * len(got)
                            out[3] += ids.take(pa.array(at[got])).to_pylist()
                            out[4] += s[got].tolist()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, schema.types)], schema=schema)

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, ddl)


_PICKED = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()),
                     ("score", pa.int64())])
_PICKED_DDL = "anchor_id long, key long, slot int, other_id long, score long"
def _order():
    return F.col("score").desc(), F.col("other_id").asc_nulls_last()


def positives_of(rows: DataFrame, anchors: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(anchor_id, key, place, positive_id, positive_score): the first ``k`` other rows of each anchor's label."""

    def pick(s, anchor, other, labels):
        yield 0, first(s, np.flatnonzero(other & (labels == anchor["label"])), k)

    best = _cells(rows, anchors, pick, _PICKED_DDL, _PICKED, scale)
    place = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(*_order()))
    return best.withColumn("place", place).filter(F.col("place") <= k).select(
        "anchor_id", "key", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))


def slots_of(rows: DataFrame, anchors: DataFrame, positives: DataFrame, k: int = 10, scale: int = 256) -> DataFrame:
    """(anchor_id, key, slot, other_id, score): the first ``k`` rows of other labels in every slot of every anchor."""
    windows = positives.filter("lo <= hi").groupBy("anchor_id", "key").agg(
        F.sort_array(F.collect_set("hi"), asc=False).alias("limits"), F.min("lo").alias("floor"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"])

    def pick(s, anchor, other, labels):
        open_rows = np.flatnonzero((labels != anchor["label"]) & other & (s >= anchor["floor"]))
        for slot, upper in enumerate(anchor["limits"]):
            inside = s[open_rows] <= upper
            if slot + 1 < len(anchor["limits"]):
                inside &= s[open_rows] > anchor["limits"][slot + 1]
            yield slot, first(s, open_rows[inside], k)

    best = _cells(rows, asked, pick, _PICKED_DDL, _PICKED, scale)
    place = F.row_number().over(Window.partitionBy("anchor_id", "key", "slot").orderBy(*_order()))
    return best.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of the rows of other labels with ``low * positive_score <= 100 * score <=
    high * positive_score``, the first ``n_negatives`` for each anchor and positive.
    """
    taking = prepared(rows, relabel_every, labels)
    anchors = stored(anchors_of(taking, every), "negatives-anchors")
    exact = F.col("positive_score").cast("decimal(19,0)")
    positives = stored(
        positives_of(taking, anchors, n_positives, scale)
        .withColumn("lo", F.ceil(exact * F.lit(low) / F.lit(100)).cast("long"))
        .withColumn("hi", F.floor(exact * F.lit(high) / F.lit(100)).cast("long")), "negatives-positives")
    slots = slots_of(taking, anchors, positives, n_negatives, scale)
    # One ordered list per anchor; what a window sees of it is the suffix below its upper limit.
    whole = Window.partitionBy("anchor_id", "key").orderBy(*_order())
    ordered = slots.withColumn("at", F.row_number().over(whole)).groupBy("anchor_id", "key").agg(
        F.sort_array(F.collect_list(F.struct("at", "score", "other_id"))).alias("list"))
    seen = F.slice(F.filter("list", lambda x: x["score"] <= F.col("hi")), 1, n_negatives)
    chosen = positives.join(ordered, ["anchor_id", "key"]).select(
        "anchor_id", "positive_id", "positive_score",
        F.posexplode(F.filter(seen, lambda x: x["score"] >= F.col("lo"))).alias("rank", "x"))
    return chosen.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"),
                         F.col("x.other_id").alias("negative_id"), "positive_score",
                         F.col("x.score").alias("negative_score"))


#: The contract over the whole table.
SQL = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
         list_inner_product(a.q, o.q)::BIGINT AS score
  FROM t a JOIN t o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
