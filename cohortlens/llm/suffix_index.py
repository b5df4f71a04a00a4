"""Exact removal of repeated byte strings with a logarithmic suffix-index family (operator 4).

A byte goes when it lies in a ``length``-byte string that also starts earlier
(smaller doc_id, or earlier in the same document).

Index. Every ``length``-byte window holds one anchor: the position of the
smallest fingerprint among the ``gram``-byte strings inside it. Equal windows
have their anchor at the same offset, so only suffixes that start at an anchor
(about 3 % of all positions) need indexing. A batch's suffix array is the
table of its anchor suffixes in the order of the fingerprint of their first
``gram`` bytes: equal prefixes are neighbours, which is all that a merge scan
for long matches needs. It is written bucketed and sorted by that order, so
scanning a batch against a level, and merging two levels, are sort-merge
passes without another shuffle.

Batches arrive in doc_id order. Before a batch is added, levels of equal size
are merged (sizes 1, 2, 4, ... batches, so a suffix is rewritten a logarithmic
number of times); then the batch is merge-scanned against itself and every
level. A level keeps the first suffix per prefix; every later member of that
prefix is recorded as a hit in the batch that brings it, together with the first.

Match. Only hits are compared further. A hit brings the bytes around its
anchor (``length - gram`` before, ``length`` from the anchor on: every window
with that anchor). Repeats of the whole surrounding within a task are settled
there, before the shuffle. The rest meet by prefix and, in document order, each
window is tested against the windows of the same offset before it. A prefix
with very many different surroundings is dealt out in slices of offsets, each
keyed by the bytes common to the slice's windows, down to single windows.

Windows are compared by a 64-bit hash of their 100 bytes within one prefix and
offset. Edge cases: null text is empty; texts below ``length`` bytes lose
nothing; a null doc_id counts as larger than all others; rows that repeat a
doc_id and text have the same starts and so never remove each other, rows that
share a doc_id with other text are ordered by the start alone. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import shared_path, short_lived_shuffles, slices, stored

LENGTH, GRAM = 100, 32
BATCHES = 4
#: Members of one prefix (different surroundings) that are compared in one cell.
CELL = 16384
#: Bytes of text hashed at a time.
PIECE = 1 << 19
#: Broadcast the frequent prefixes (12 bytes each) up to this many.
BROADCAST_KEYS = 1_000_000
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base & ((1 << 64) - 1), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Hasher:
    """Fingerprints of all ``gram``-byte strings of a piece of text."""

    def __init__(self, size: int):
        self.pow = _powers(size + 1, _BASE)
        self.inv = _powers(size + 1, pow(_BASE, -1, 1 << 64))

    def grams(self, raw: np.ndarray, gram: int) -> np.ndarray:
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.pow[:len(raw)], dtype=np.uint64)))
        n = len(raw) - gram + 1
        return _mix((s[gram:] - s[:n]) * self.inv[:n])


def anchor_positions(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the (leftmost) minimum of some ``width`` consecutive fingerprints."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost, as positions decide
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    at = (m & low).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _anchors(texts: list[bytes], hasher: _Hasher, length: int, gram: int):
    """(index of the text, position, fingerprint) of every anchor of each text.

    A text longer than a piece is walked in pieces that overlap by
    ``length - 1`` bytes, so every window lies inside one piece.
    """
    for i, raw in enumerate(texts):
        at = 0
        while len(raw) - at >= length:
            piece = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
            h = hasher.grams(piece, gram)
            pos = anchor_positions(h, length - gram + 1)
            yield i, pos + at, h[pos]
            if at + len(piece) >= len(raw):
                break
            at += PIECE - length + 1


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """(d, tag): ``d`` orders documents; ``tag`` tells rows of one id apart where ids repeat."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    repeated = docs.groupBy(d.alias("d")).count().filter("count > 1").limit(1).count() > 0
    return d, F.xxhash64("text") if repeated else F.lit(0).cast("long")


def _utf8(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, d, tag, pos): the sampled suffixes, ``key`` the fingerprint of their first bytes."""

    def run(batches):
        hasher = _Hasher(PIECE)
        for b in slices(batches):
            d, tag = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            keys, pos, at = [], [], []
            for i, p, h in _anchors(_utf8(b.column(2)), hasher, length, gram):
                keys.append(h.view(np.int64))
                pos.append(p)
                at.append(np.full(len(p), i))
            if keys:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(d[at]), pa.array(tag[at]),
                     pa.array(np.concatenate(pos))], ["key", "d", "tag", "pos"])

    return rows.select("d", "tag", "text").mapInArrow(run, "key long, d long, tag long, pos long")


class SuffixIndex:
    """Levels of suffix arrays with sizes 1, 2, 4, ... batches.

    The arrays are tables of a database that lives in the shared checkpoint
    folder; a table is dropped, with its files, as soon as it is merged or scanned.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.length, self.gram = spark, length, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (batches held, table), largest first
        self.database = f"suffix_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{shared_path(spark, 'suffix-index')}'")

    def _save(self, df: DataFrame) -> str:
        name = f"{self.database}.array_{uuid.uuid4().hex}"
        with short_lived_shuffles(self.spark):
            df.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _drop(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")

    def _merge_equal(self) -> None:
        while len(self.levels) >= 2 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            x = self.spark.table(a).select("key", F.col("first").alias("_x"))
            y = self.spark.table(b).select("key", F.col("first").alias("_y"))
            both = x.join(y, "key", "full").select("key", F.least("_x", "_y").alias("first"))
            self.levels.append((n + m, self._save(both)))
            self._drop(a, b)

    def add(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch of (d, tag, text); returns the hits (key, d, tag, pos) that it brings.

        With ``last`` the batch is scanned but not kept as a level.
        """
        self._merge_equal()
        table = self._save(anchors(rows, self.length, self.gram).repartition(self.buckets, "key"))
        batch = self.spark.table(table)
        own = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "pos", "tag")).alias("first"))
        met, olds = own.select("key", "n"), []
        for i, (_, level) in enumerate(self.levels):
            met = met.join(self.spark.table(level).select("key", F.col("first").alias(f"_o{i}")), "key", "left")
            olds.append(F.col(f"_o{i}"))
        repeated = F.col("n") > 1
        for o in olds:
            repeated = repeated | o.isNotNull()
        met = met.filter(repeated)
        hits = batch.join(met.select("key"), "key").select("key", "d", "tag", "pos")
        for o in olds:
            hits = hits.unionByName(met.filter(o.isNotNull()).select("key", o.d.alias("d"), o.tag.alias("tag"),
                                                                     o.pos.alias("pos")))
        hits = stored(hits, "suffix-hits")
        if not last:
            self.levels.append((1, self._save(own.select("key", "first"))))
        self._drop(table)
        return hits

    def close(self) -> None:
        """Drop all levels, when no further batch will come."""
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def _surroundings(rows: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around every hit, or spans settled within the task.

    Rows (cell, d, tag, pos, lo, hi, left, bytes): windows that start lo..hi
    bytes before the anchor, ``left`` bytes before it given. ``bytes`` null: the
    span pos..pos+hi is settled as repeated.
    """
    reach = length - gram

    def run(batches):
        seen: dict[tuple, tuple[int, int]] = {}
        for b in slices(batches):
            out: list[tuple] = []
            ids, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, tag, raw, spots in zip(ids, tags, _utf8(b.column(2)), b.column(3).to_pylist()):
                n, done = len(raw), []
                for spot in sorted(spots, key=lambda s: s["pos"]):
                    p, cuts = spot["pos"], spot["slices"]
                    if p + gram > n:  # of another text with this id
                        continue
                    for s in range(cuts):
                        lo = max(s * (reach + 1) // cuts, p + length - n)
                        hi = min((s + 1) * (reach + 1) // cuts - 1, p)
                        if lo > hi:
                            continue
                        start, end = p - hi, p - lo + length
                        text = raw[start:end]
                        # Windows of equal cuts of offsets share these bytes at least.
                        core = raw[p - s * (reach + 1) // cuts:p + length - (s + 1) * (reach + 1) // cuts + 1]
                        first = seen.setdefault((text, cuts, lo, hi), (d, p))
                        if first < (d, p):
                            if done and start <= done[-1][1]:
                                done[-1][1] = max(done[-1][1], end)
                            else:
                                done.append([start, end])
                            continue
                        if first > (d, p):
                            seen[(text, cuts, lo, hi)] = (d, p)
                        cell = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=bytes([s, cuts])).digest(),
                                              "little", signed=True)
                        out.append((cell, d, tag, p, lo, hi, hi, text))
                out += [((d * 31 + s) & 0x7FFFFFFFFFFF, d, tag, s, 0, e - s, 0, None) for s, e in done]
            if out:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 ["cell", "d", "tag", "pos", "lo", "hi", "left", "bytes"])

    joined = rows.join(places, ["d", "tag"]).select("d", "tag", "text", "spots")
    return joined.mapInArrow(run, "cell long, d long, tag long, pos long, lo long, hi long, left long, bytes binary")


def repeated_windows(group: np.ndarray, d: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                     data: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest offset of a repeated window for every row (-1: none).

    Rows are sorted by (group, d, pos). Column ``reach`` of the byte matrix is
    the anchor, so windows of one offset are the same columns in every row.
    """
    reach, n = length - gram, len(d)
    width = reach + length
    flat = np.zeros(n * width, np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, n)
    put = np.repeat(np.arange(n) * width + reach - hi, sizes) + np.arange(sizes.sum()) \
        - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[put] = np.frombuffer(b"".join(data), np.uint8)
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(_BYTE[flat].reshape(n, width) * _powers(width, _BASE)[None, :], axis=1, out=sums[:, 1:])
    salt = _mix(group.astype(np.uint64) + np.uint64(1))
    near, far = np.full(n, -1), np.full(n, -1)
    for off in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= off) & (off <= hi))
        if len(rows) < 2:
            continue
        h = _mix(sums[rows, reach - off + length] - sums[rows, reach - off]) ^ salt[rows]
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        head = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
        first = rows[order[np.flatnonzero(head)[np.cumsum(head) - 1]]]
        mine = rows[order]
        again = mine[(d[first] != d[mine]) | (pos[first] != pos[mine])]
        near[again] = np.where(near[again] < 0, off, near[again])
        far[again] = off
    return near, far


def _spans(cells: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, tag, start, stop) of repeated bytes, by comparing the surroundings in every cell."""
    names = ["d", "tag", "start", "stop"]

    def emit(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        settled = pa.compute.is_null(t["bytes"])
        s = t.filter(settled)
        if len(s):
            start = s["pos"].to_numpy()
            yield pa.RecordBatch.from_arrays([s["d"].combine_chunks(), s["tag"].combine_chunks(), pa.array(start),
                                              pa.array(start + s["hi"].to_numpy())], names)
        t = t.filter(pa.compute.invert(settled))
        if len(t) < 2:
            return
        c = {k: t[k].to_numpy() for k in ("cell", "d", "tag", "pos", "lo", "hi")}
        group = np.cumsum(np.concatenate(([False], c["cell"][1:] != c["cell"][:-1])))
        near, far = repeated_windows(group, c["d"], c["pos"], c["lo"], c["hi"], t["bytes"].to_pylist(), length, gram)
        hit = np.flatnonzero(far >= 0)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["d"][hit]), pa.array(c["tag"][hit]), pa.array(c["pos"][hit] - far[hit]),
                 pa.array(c["pos"][hit] - near[hit] + length)], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in slices(batches, 2048):
            cell = b.column(0).to_numpy()
            if held and sum(x.num_rows for x in held) >= 6144:
                # Emit up to the last change of cell in this batch.
                last = held[-1].column(0).to_numpy()[-1]
                change = np.flatnonzero(cell != last)
                cut = int(change[0]) if len(change) else None
                if cut is not None:
                    yield from emit(held + ([b.slice(0, cut)] if cut else []))
                    held = [b.slice(cut)]
                    continue
            held.append(b)
        if held:
            yield from emit(held)

    dealt = cells.repartition("cell").sortWithinPartitions("cell", "d", "pos")
    return dealt.mapInArrow(run, "d long, tag long, start long, stop long")


def repeated_spans(docs: DataFrame, key: tuple[Column, Column], length: int = LENGTH, gram: int = GRAM,
                   batches: int = BATCHES, cell: int = CELL) -> DataFrame:
    """(d, tag, spans) of the documents that lose bytes; ``key`` names each row's (d, tag)."""
    spark = docs.sparkSession
    rows = docs.select(key[0].alias("d"), key[1].alias("tag"), "text")
    index = SuffixIndex(spark, length, gram)
    shares = [i / batches for i in range(1, batches)]
    # Quantiles are doubles: that of rows without an id is 2^63, beyond a long.
    cuts = sorted({min(int(c), NO_ID - 1) for c in rows.approxQuantile("d", shares, 0.01)}) if shares else []
    hits: DataFrame | None = None
    for i in range(len(cuts) + 1):
        part = rows
        if i > 0:
            part = part.filter(F.col("d") > F.lit(cuts[i - 1]))
        if i < len(cuts):
            part = part.filter(F.col("d") <= F.lit(cuts[i]))
        got = index.add(part, last=i == len(cuts))
        hits = got if hits is None else hits.unionByName(got)
    index.close()
    hot = stored(hits.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell)
                 .select("key", F.least(F.lit(length - gram + 1), F.ceil(F.col("_n") / cell)).cast("int").alias("_s")),
                 "suffix-hot")
    # Usually a handful of keys, and their number is known here; beyond the bound the join shuffles.
    if hot.count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    sliced = hits.join(hot, "key", "left").select("d", "tag", "pos", F.coalesce("_s", F.lit(1)).alias("slices"))
    places = sliced.groupBy("d", "tag").agg(F.collect_set(F.struct("pos", "slices")).alias("spots"))
    found = _spans(_surroundings(rows, places, length, gram), length, gram)
    spans = found.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return stored(spans, "suffix-spans")


def union_spans(spans: list[dict] | None) -> list[list[int]]:
    """Maximal runs covered by the spans, in order."""
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def kept_bytes(raw: bytes, runs: list[list[int]]) -> bytes:
    if not runs:
        return raw
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES,
                cell: int = CELL) -> DataFrame:
    """(doc_id, n_bytes, runs, kept binary): the removed runs and the remaining bytes of every row."""
    key = _row_key(docs)
    spans = repeated_spans(docs, key, length, gram, batches, cell)
    rows = docs.select(key[0].alias("d"), key[1].alias("tag"), "text")

    def run(parts):
        for b in slices(parts):
            n, runs, kept = [], [], []
            for raw, s in zip(_utf8(b.column(1)), b.column(2).to_pylist()):
                r = union_spans(s)
                n.append(len(raw))
                runs.append(r)
                kept.append(kept_bytes(raw, r))
            ids = [None if d == NO_ID else d for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "runs", "kept"])

    joined = rows.join(spans, ["d", "tag"], "left").select("d", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, runs array<array<long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return deduplicate(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline form: the documents with the remaining text, their other columns unchanged.

    A character that loses some of its bytes goes whole. ``n_chars``, where the
    table has it, is that of the remaining text. A null text stays null.
    """
    names, (key, tag) = docs.columns, _row_key(docs)
    spans = repeated_spans(docs, (key, tag))
    one = spans.select(F.col("d").alias("_d"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
    joined = docs.join(one, (key == F.col("_d")) & (tag == F.col("_tag")), "left").select(*names, "_spans")
    at = names.index("text")
    size_at = names.index("n_chars") if "n_chars" in names else None

    def run(parts):
        for b in slices(parts):
            cols = list(b.columns[:-1])
            texts = []
            for t, s in zip(cols[at].to_pylist(), b.columns[-1].to_pylist()):
                if t and s:
                    t = kept_bytes(t.encode("utf-8", "surrogatepass"), union_spans(s)).decode("utf-8", "ignore")
                texts.append(t)
            cols[at] = pa.array(texts, pa.string())
            if size_at is not None:
                cols[size_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, [f"_c{i}" for i in range(len(names))])

    schema = ", ".join(f"`_c{i}` {'long' if i == size_at else f.dataType.simpleString()}"
                       for i, f in enumerate(docs.schema.fields))
    return joined.mapInArrow(run, schema).select([F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
