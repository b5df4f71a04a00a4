"""SimHash near-duplicates by a generalised pigeonhole search (operator 8).

1. One pass over the texts gives a 64-bit fingerprint per document; equal
   fingerprints are folded to one row before any search.
2. Bit statistics over all fingerprints (64 x 64 co-occurrence counts) group
   correlated bits into four units of 16 bits, so that different units are
   close to independent.
3. A histogram of every unit over all fingerprints gives the exact number of
   pairs within 0..k bits in that unit. Several layouts (units kept apart or
   merged into wider partitions) are costed; for each, dynamic programming
   allots a threshold t_i >= -1 to every partition with sum(t_i + 1) = k + 1,
   minimising estimated candidates plus probe rows. Two fingerprints within k
   bits must be within t_i bits in some partition i (otherwise their distance
   is at least k + 1), so no allotment loses a link.
4. Each fingerprint probes partition i with every value within t_i bits of its
   own; rows meeting in a cell are verified on all 64 bits. Cells of frequent
   values are dealt out in blocks of bounded size, each pair of blocks its own
   cell, and a cell returns a spanning set of its links instead of all pairs.
5. Components of the links, labelled with the smallest doc_id.

Edge cases: null or blank text has fingerprint zero and links like any other.
Repeated rows give one output row each. A null doc_id gets its fingerprint and
its component, and never names one unless the whole component has no id (then
``component_id`` is null). Empty tables give empty results. Columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored
from cohortlens.llm.components import components

BITS, UNIT, SEED = 64, 16, 42
#: Hashes turned into bits at a time: bounds memory for very long texts.
SLICE = 1 << 16
#: Fingerprints of one frequent value that are compared in one cell, per side.
BLOCK = 4096
#: A probe row (shuffled and sorted) costs about as much as this many comparisons.
PROBE_COST = 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text`` (ASCII letters lower-cased), as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    gap = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], gap + 1))[:n]
    ends = np.concatenate((gap, [len(flat)]))[len(words) - n:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, SLICE):
        s, e = starts[lo:lo + SLICE].tolist(), ends[lo:lo + SLICE].tolist()
        h = np.array([digest(flat[i:j], SEED) for i, j in zip(s, e)], np.uint64)
        total += _bits(h).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones, bit 0 first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` is the 64-bit pattern as a signed long."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return named.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _fp_column(batch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bit_units(fps: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits, correlated bits together, from counts over all fingerprints.

    Every task returns its 64 x 64 co-occurrence counts (the diagonal holds the
    bit counts); they are summed by Spark, and 4,096 numbers reach the driver.
    """

    def run(batches):
        gram = np.zeros((BITS, BITS))
        for b in batches:
            x = _bits(_fp_column(b)).astype(np.float32)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(gram.ravel())], ["i", "n"])

    got = fps.select("fp").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    gram = np.zeros(BITS * BITS)
    for r in got:
        gram[r.i] = r.n
    return group_bits(gram.reshape(BITS, BITS), fps.count())


def group_bits(gram: np.ndarray, n: int) -> list[list[int]]:
    """Greedy grouping: start from the most correlated free pair, add the bit closest to the unit."""
    n = max(n, 1)
    p = np.diag(gram) / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs((gram / n - np.outer(p, p)) / spread)
    np.fill_diagonal(corr, 0)
    free, units = list(range(BITS)), []
    while free:
        sub = corr[np.ix_(free, free)]
        first = free[int(sub.max(axis=1).argmax())]
        unit = [first]
        while len(unit) < UNIT:
            rest = [b for b in free if b not in unit]
            unit.append(max(rest, key=lambda b: (corr[b, unit].mean(), -b)))
        units.append(sorted(unit))
        free = [b for b in free if b not in unit]
    return units


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of every value, packed into the low bits."""
    out = np.zeros(len(values), np.uint64)
    for j, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def histograms(fps: DataFrame, units: list[list[int]]) -> np.ndarray:
    """(4, 65536) counts of every unit's values over all fingerprints: a fixed size, whatever the data."""

    def run(batches):
        acc = np.zeros((len(units), 1 << UNIT), np.int64)
        for b in batches:
            v = _fp_column(b)
            for u, bits in enumerate(units):
                acc[u] += np.bincount(project(v, bits).astype(np.int64), minlength=1 << UNIT)
        at = np.flatnonzero(acc.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc.ravel()[at])], ["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(units) * (1 << UNIT), np.int64)
    out[rows["i"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(len(units), 1 << UNIT)


def flips(width: int, t: int) -> list[int]:
    """XOR masks of up to ``t`` bits out of ``width``, none first."""
    return [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)]


@dataclass(frozen=True)
class Partition:
    units: tuple[int, ...]
    threshold: int


def plan_partitions(hist: np.ndarray, k: int) -> list[Partition]:
    """Layout and thresholds of least estimated cost."""
    n = float(max(hist.sum(axis=1).max(initial=0), 1))
    values = np.arange(1 << UNIT)
    # near[u][d]: share of ordered pairs that differ in exactly d bits of unit u.
    near = np.zeros((len(hist), k + 1))
    for u, h in enumerate(hist):
        for d in range(k + 1):
            for c in combinations(range(UNIT), d):
                near[u, d] += float(h @ h[values ^ sum(1 << b for b in c)])
    near /= n * n
    best: tuple[float, list[Partition]] | None = None
    for layout in (((0,), (1,), (2,), (3,)), ((0, 1), (2,), (3,)), ((0, 1), (2, 3)), ((0, 1, 2), (3,))):
        cost = []
        for part in layout:
            dist = np.ones(1)
            for u in part:  # units are nearly independent: their distances add up
                dist = np.convolve(dist, near[u])[: k + 1]
            width = UNIT * len(part)
            probes = [1.0]
            for d in range(1, k + 1):
                probes.append(probes[-1] * (width - d + 1) / d)
            cost.append([0.0] + [n * n / 2 * dist[: t + 1].sum() + PROBE_COST * n * sum(probes[: t + 1])
                                 for t in range(k + 1)])
        # table[e]: cheapest way to spend e of the k + 1 errors on the partitions so far.
        table: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(np.inf, ())] * (k + 1)
        for c in cost:
            table = [min((table[e - s][0] + c[s], table[e - s][1] + (s - 1,)) for s in range(e + 1))
                     for e in range(k + 2)]
        total, thresholds = table[k + 1]
        if len(thresholds) == len(layout) and (best is None or total < best[0]):
            best = total, [Partition(p, t) for p, t in zip(layout, thresholds) if t >= 0]
    return best[1]


def probe(fps: DataFrame, units: list[list[int]], hist: np.ndarray, plan: list[Partition],
          block: int = BLOCK) -> DataFrame:
    """(part, key, cell, fp, home): the cells in which every fingerprint is compared.

    ``home`` rows carry the fingerprint's own value; the others are probes. The
    number of blocks of a value follows from the unit histograms, an upper
    bound on its frequency.
    """
    shared = fps.sparkSession.sparkContext.broadcast(hist)  # fixed size: 4 x 65,536 counts

    def cells(fp: np.ndarray, part: Partition, keys: np.ndarray):
        bound = np.full(len(keys), np.iinfo(np.int64).max)
        for j, u in enumerate(part.units):
            unit_value = (keys >> np.uint64(UNIT * j)) & np.uint64((1 << UNIT) - 1)
            bound = np.minimum(bound, shared.value[u][unit_value.astype(np.int64)])
        b = np.maximum(1, -(-bound // block))
        own = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % b
        row = np.repeat(np.arange(len(keys)), b)
        other = np.arange(len(row)) - np.repeat(np.cumsum(b) - b, b)
        x, y = np.minimum(own[row], other), np.maximum(own[row], other)
        return row, x * b[row] + y

    def run(batches):
        for batch in batches:
            v = _fp_column(batch)
            for i, part in enumerate(plan):
                bits = [b for u in part.units for b in units[u]]
                own = project(v, bits)
                for m, mask in enumerate(flips(len(bits), part.threshold)):
                    keys = own ^ np.uint64(mask)
                    row, cell = cells(v, part, keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), i, np.int32)), pa.array(keys[row].view(np.int64)),
                         pa.array(cell), pa.array(v[row].view(np.int64)), pa.array(np.full(len(row), m == 0))],
                        ["part", "key", "cell", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "part int, key long, cell long, fp long, home boolean")


def link_cells(group: np.ndarray, fp: np.ndarray, home: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links inside sorted groups: rows at most ``k`` bits apart, at least one of them at home.

    Compares row j with row j + d for d = 1, 2, ... at once over all groups, and
    keeps a label per row instead of the pairs, so memory follows the rows.
    """
    n = len(fp)
    label = np.arange(n)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate(([0], ends)))
    left = np.repeat(ends, sizes) - np.arange(n) - 1  # rows after this one in its group
    active, d = np.flatnonzero(left >= 1), 1
    while len(active):
        other = active + d
        near = (np.bitwise_count(fp[active] ^ fp[other]) <= k) & (home[active] | home[other])
        a, b = active[near], other[near]
        while True:
            ra, rb = label[a], label[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        d += 1
        active = active[left[active] >= d]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(cells: DataFrame, k: int) -> DataFrame:
    """Verified links (a, b) between fingerprints, a spanning set per cell."""

    def run(batches):
        held: list[np.ndarray] | None = None  # the cell that the last batch broke off in
        for batch in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if held is not None:
                c = [np.concatenate((h, x)) for h, x in zip(held, c)]
            if not len(c[0]):
                continue
            new = np.concatenate(([False], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])))
            starts = np.flatnonzero(new)
            cut = starts[-1] if len(starts) else 0
            held = [x[cut:] for x in c]
            if cut:
                yield from out(c, new, cut)
        if held is not None and len(held[0]):
            yield from out(held, np.zeros(len(held[0]), bool), len(held[0]))

    def out(c, new, cut):
        a, b = link_cells(np.cumsum(new[:cut]), c[3][:cut].view(np.uint64), c[4][:cut].astype(bool), k)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = cells.repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every document row, and (fp, first_id, root) of every fingerprint: ``root`` names its
    component."""
    by_doc = stored(fingerprints(docs, shingle), "simhash-fp")
    folded = stored(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    units = bit_units(folded)
    hist = histograms(folded, units)
    plan = plan_partitions(hist, max_bits)
    edges = links(probe(folded, units, hist, plan, block), max_bits)
    roots = components(edges)
    rooted = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    return by_doc, rooted


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every document row."""
    by_doc, rooted = grouped(docs, shingle, max_bits, block)
    # The smallest id in the component of every distinct fingerprint.
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return by_doc.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Pipeline form: one document of each group (its smallest doc_id, then text hash), with its own columns.

    Rows that repeat the kept document's id and text are one document. Rows
    without an id cannot be told apart by one and are all kept.
    """
    names = docs.columns
    by_doc, rooted = grouped(docs, shingle, max_bits)
    least = by_doc.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("_first"))
    keep = (least.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("_first").alias("_first"))
            .select(F.col("_first.doc_id").alias("_keep_id"), F.col("_first.text_hash").alias("_keep_hash")))
    same = (F.col("doc_id") == F.col("_keep_id")) & (F.xxhash64("text") == F.col("_keep_hash"))
    once = docs.filter(F.col("doc_id").isNotNull()).join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(names).unionByName(docs.filter(F.col("doc_id").isNull()).select(names))
