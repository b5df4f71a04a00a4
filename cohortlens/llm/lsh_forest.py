"""Near-duplicates by word shingles with an LSH forest (operator 12).

Links are documents whose sets of 5-word shingles have
``100 * intersection >= 85 * union``; groups are the components of the links.

1. One pass over the texts gives the set size, a digest of the set and a
   signature of 64 minima. Documents with equal sets are folded to one class.
2. Sixteen sorted orders: order t reads the signature from its hash ``4 t`` on,
   round and round. A *region* is a run of an order that shares a prefix, so the
   classes with the longest common prefixes are neighbours in it. A region is
   taken at depth 4 where it is small; in more crowded parts of an order the
   depth adapts to 6, and a region that is crowded even there is dealt out in
   blocks that meet in pairs. Two documents at the limit (0.85) miss each other
   in all orders with probability 7e-6 (5e-4 where every one of their sixteen
   regions is crowded); closer ones with less.
3. In every region, classes of *different* components whose set sizes allow the
   limit and whose signatures agree in 40 of 64 minima (five standard deviations
   below the limit) are candidates. A pair that shares the deeper prefix of an
   earlier order has met there, whatever its region's depth, and is none here.
   Only the classes go on, not the pairs.
4. The full sets of the candidates are brought to their cell and compared there;
   a cell returns a spanning set of its links.
5. Steps 2 to 4 run for a few orders at a time: after the first, most groups of
   copies are one component each, and regions of one component are left out.
   Shuffle files of a round go when it ends.

Edge cases: documents without words, or with a null text, have an empty set,
link with nothing and keep their own id. Repeated rows give one output row
each, all with the same verdict. A null doc_id takes part and never names a
component unless the whole component has no id (``component_id`` is null and
``kept`` true then: nothing tells its copies apart). An empty table gives an
empty result. Columns other than ``doc_id`` and ``text`` are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored
from cohortlens.llm.components import components

HASHES, ORDERS, DEPTH, DEEPER = 64, 16, 4, 6
#: Minima that two documents above the limit share but for one in some 100,000.
AGREE = 40
#: Least limit (in percent) that this agreement is made for.
LEAST = 85
#: Classes, and shingles of them, of a region (or of a block) that are compared in one cell.
REGION, WEIGHT = 1024, 4_000_000
#: Orders of a round end here.
ROUNDS = (2, 6, ORDERS)
#: Classes (of some 50 bytes) that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_CLASSES = 200_000
#: Shingles hashed and minima taken at a time: bounds memory for very long texts.
SLICE = 1 << 15
_RNG = np.random.default_rng(12)
_MULTIPLY = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (ASCII letters lower-cased); fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    gap = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], gap + 1))[:n]
    ends = np.concatenate((gap, [len(flat)]))[len(words) - n:]
    digest, parts = xxhash.xxh3_64_intdigest, []
    for lo in range(0, n, SLICE):
        s, e = starts[lo:lo + SLICE].tolist(), ends[lo:lo + SLICE].tolist()
        parts.append(np.unique(np.fromiter((digest(flat[i:j]) for i, j in zip(s, e)), np.uint64, len(s))))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def signature(values: np.ndarray) -> np.ndarray:
    """16 high bits of the 64 minima of a non-empty set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 1024):
        np.minimum(least, (values[None, lo:lo + 1024] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    # The minimum of a large set is small: its low half tells sets apart, not its first bits.
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, sig): ``key`` is a 128-bit digest of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "key", "sig"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return named.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key binary, sig binary")


# ---------------------------------------------------------------- regions


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)


def _places(order: int, depth: int) -> np.ndarray:
    """Where the first ``depth`` values of an order are in the signature."""
    return (order * HASHES // ORDERS + np.arange(depth)) % HASHES


def _prefix(sig: np.ndarray, order: int, depth: int) -> np.ndarray:
    """The first ``depth`` values of an order, as one number."""
    out = np.zeros(len(sig), np.uint64)
    for j in _places(order, depth):
        out = (out ^ sig[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _of_order(number, order):
    """A cell's number: a hash of which the last four bits are its order (of ``ORDERS``)."""
    return number.bitwiseAND(~(ORDERS - 1)).bitwiseOR(order)


def regions(classes: DataFrame, orders: range, region: int = REGION, weight: int = WEIGHT) -> DataFrame:
    """(cell, x, y, own, cid, comp): the classes of every region that holds more than one component.

    ``classes`` has (cid, sig, comp, n_shingles); ``comp`` is the component. A
    region is one cell, (x, y) = (0, 0); one that is crowded even at the deeper
    prefix has a cell for every pair x <= y of its blocks, and ``own`` is the
    block of the row. Classes that are alone in their regions are left behind in
    one join: whatever follows, crowded regions too, reads the others only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b)
            for t in orders:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_prefix(sig, t, DEPTH) & ~(ORDERS - 1) | t),
                     pa.array((_prefix(sig, t, DEEPER) >> 32).astype(np.int32)),
                     b.column("cid"), b.column("comp"), b.column("n_shingles")], ["p", "q", "cid", "comp", "n_shingles"])

    blocks = F.greatest(F.ceil(F.col("n") / region), F.ceil(F.col("w") / weight)).cast("int")

    def mixed(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.min("comp").alias("lo"),
                                    F.max("comp").alias("hi")).filter("lo < hi").select(*on, blocks.alias("blocks"))

    rows = classes.select("cid", "sig", "comp", "n_shingles").mapInArrow(
        run, "p long, q int, cid long, comp long, n_shingles long")
    met = stored(rows.join(stored(mixed(rows, ["p"]), "forest-regions"), "p"), "forest-rows")
    found = met.filter("blocks = 1").select(
        F.col("p").alias("cell"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("own"), "cid", "comp")
    crowded = met.filter("blocks > 1").drop("blocks")
    if crowded.isEmpty():
        return found
    own = F.pmod(F.xxhash64("cid", "p"), F.col("blocks")).cast("int")
    dealt = crowded.join(mixed(crowded, ["p", "q"]), ["p", "q"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = _of_order(F.xxhash64("p", "q"), F.col("p").bitwiseAND(ORDERS - 1))
    return found.unionByName(dealt.select(
        cell.alias("cell"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cid", "comp"))


_CELL = ["cell", "x", "y"]
_ROW_DDL = "cell long, x int, y int, own int, cid long, comp long"


def _by_cell(rows: DataFrame, cell, ddl: str) -> DataFrame:
    """``cell(table)`` for the rows of every cell, a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the cell that the last batch broke off in
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(c).to_numpy() for c in _CELL]
            new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in at], axis=0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                name = tuple(v[lo] for v in at)
                if held and name != last:
                    yield from cell(pa.Table.from_batches(held))
                    held = []
                last = name
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from cell(pa.Table.from_batches(held))

    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, ddl)


def _neighbours(order: int, sig: np.ndarray) -> np.ndarray:
    """The rows of a region in its sorted order: those with the longest common prefixes follow each other."""
    return np.lexsort(np.roll(sig, -(order * HASHES // ORDERS), axis=1).T[::-1])


def likely_rows(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``regions`` that have a likely partner of another component in their cell: enough minima agree, the
    set sizes allow the limit, and no earlier order has surely brought both to one cell."""

    def cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, comp, own = t["n_shingles"].to_numpy(), t["comp"].to_numpy(), t["own"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
        across = t["x"][0].as_py() != t["y"][0].as_py()
        order = t["cell"][0].as_py() & (ORDERS - 1)
        rank = _neighbours(order, sig)
        before = np.array([_places(s, DEEPER) for s in range(order)], int).reshape(-1, DEEPER)
        chosen = np.zeros(len(rank), bool)
        for d in range(1, len(rank)):  # every row with the d-th after it
            if chosen.all():
                break
            i, j = rank[:-d], rank[d:]
            maybe = (comp[i] != comp[j]) & ~(chosen[i] & chosen[j]) & (
                100 * np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j]))
            if across:
                maybe &= own[i] != own[j]
            i, j = i[maybe], j[maybe]
            same = sig[i] == sig[j]
            agree = same.sum(axis=1) >= AGREE
            i, j, same = i[agree], j[agree], same[agree]
            new = ~same[:, before].all(axis=2).any(axis=1)
            chosen[i[new]] = chosen[j[new]] = True
        if chosen.any():
            yield from t.select([f.split()[0] for f in _ROW_DDL.split(", ")]).filter(pa.array(chosen)).to_batches()

    return _by_cell(cells.join(classes.select("cid", "sig", "n_shingles"), "cid"), cell, _ROW_DDL)


def link_sets(sets: list[np.ndarray], comp: np.ndarray, own: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of these sets as far as they are ``percent`` alike, a spanning set of them.

    Every set is compared in full with all sets of other components at once (with those of another block only, where
    ``own`` is given). Sets are sorted, distinct and not empty.
    """
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    label = np.unique(comp, return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, np.int64)
    links = []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        later = later[(label[later] != label[i])
                      & (100 * np.minimum(size[later], size[i]) >= percent * np.maximum(size[later], size[i]))]
        if own is not None:
            later = later[own[later] != own[i]]
        if not len(later):
            continue
        mark[codes[start[i]:start[i] + size[i]]] = 1
        n = size[later]
        ends = np.cumsum(n)
        met = np.add.reduceat(mark[codes[np.repeat(start[later] - ends + n, n) + np.arange(ends[-1])]], ends - n)
        mark[codes[start[i]:start[i] + size[i]]] = 0
        for j in later[100 * met >= percent * (size[i] + n - met)].tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


# ---------------------------------------------------------------- links


def sets_of(docs: DataFrame, classes: DataFrame, rows: DataFrame, width: int = 5) -> DataFrame:
    """``rows`` with the ``shingles`` of their classes, each set made once, from the text of one document."""
    wanted = classes.join(rows.select("cid").distinct(), "cid").select("cid", "first_id", "text_hash")
    cells = rows.groupBy("cid").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "cid"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            sets = [shingle_set(t, width).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("cells"), pa.array(sets, pa.list_(pa.int64()))],
                                             ["cid", "cells", "shingles"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    same = named["doc_id"].eqNullSafe(wanted["first_id"]) & (named["text_hash"] == wanted["text_hash"])
    # Counted first: a small set of classes goes to the texts, else both meet by a shuffle.
    small = wanted.count() <= BROADCAST_CLASSES
    texts = named.join(F.broadcast(wanted) if small else wanted, same).select("cid", "text").dropDuplicates(["cid"])
    held = texts.join(cells, "cid").select("cid", "cells", "text")
    ddl = f"cid long, cells {cells.schema['cells'].dataType.simpleString()}, shingles array<long>"
    return held.mapInArrow(run, ddl).select("cid", "shingles", F.explode("cells").alias("at")).select(
        *(F.col(c if c == "cid" else f"at.{c}") for c in rows.columns), "shingles")


def confirmed(rows: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b): links between components in every cell, checked on the full sets in ``rows``."""

    def cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, column = t["cid"].to_numpy(), t["shingles"].combine_chunks()
        flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        sets_here = [flat[i:j] for i, j in zip(at, at[1:])]
        across = t["x"][0].as_py() != t["y"][0].as_py()
        found = link_sets(sets_here, t["comp"].to_numpy(), t["own"].to_numpy() if across else None, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[[i for i, _ in found]]), pa.array(ids[[j for _, j in found]])],
                                             ["a", "b"])

    return stored(_by_cell(rows, cell, "a long, b long").distinct(), "forest-links")


def grouped(docs: DataFrame, width: int = 5, percent: int = 85, region: int = REGION,
            weight: int = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the sketches of every document, and (cid, key, root, ...) of every class."""
    if percent < LEAST:
        raise ValueError(f"the signatures are made for limits of {LEAST} percent or more")
    rows = stored(sketches(docs, width), "forest-sketches")
    # A short number instead of the digest travels with every order.
    classes = stored(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).select(
        F.monotonically_increasing_id().alias("cid"), "key", "least_id", F.col("first.doc_id").alias("first_id"),
        F.col("first.text_hash").alias("text_hash"), "sig", "n_shingles"), "forest-classes")
    links, rooted = None, classes.withColumn("root", F.col("cid"))
    for start, end in zip((0, *ROUNDS), ROUNDS):
        now = rooted.withColumn("comp", F.col("root"))
        likely = stored(likely_rows(regions(now, range(start, end), region, weight), classes), "forest-likely")
        if likely.isEmpty():
            continue
        found = confirmed(sets_of(docs, classes, likely, width), percent)
        links = found if links is None else links.unionByName(found)
        roots = stored(components(links), "forest-roots").withColumnRenamed("node", "cid")
        rooted = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return rows, rooted


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, region: int = REGION,
                    weight: int = WEIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row."""
    rows, classes = grouped(docs, width, percent, region, weight)
    names = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = rows.join(classes.join(names, "root").select("key", "component_id"), "key")
    alone = rows.filter(F.col("key").isNull()).withColumn("component_id", F.col("doc_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
