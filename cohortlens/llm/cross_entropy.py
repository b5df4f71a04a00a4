"""Cross-entropy difference scoring with matched n-gram models (operator 10).

Two word-bigram models, one of the target texts and one of the whole corpus
(the background), share one vocabulary, one set of bigrams and one smoothing,
so that a token's two losses differ only by what the texts say. A document's
score is the mean of (target loss - background loss) over its tokens: the
lower, the more it reads like the target.

Every word and every bigram of the corpus counts, however rare; nothing is
broadcast and no task holds the vocabulary.

1. Texts get their target flag by a join of the same plan at every size (the
   list of targets grows with the corpus and is never broadcast). Each task
   deals its texts into blocks of about ``BLOCK`` tokens and writes, per block,
   the distinct words (64-bit hashes) and the distinct bigrams with their counts
   (64-bit keys), both sorted and packed into one row per bucket of keys, and
   the texts as places in the block's list of words. Packed numbers are sorted
   keys as differences, laid out byte by byte and compressed.
2. Per bucket, the counts of a bigram are summed over its blocks and go back to
   them; those of a word (and of what follows it) are summed over the bigrams
   and go back per bucket as well. A key occurs at most once a block, so a
   frequent one is no load on its task.
3. Each block gets the totals of its own words and bigrams, makes their log
   probabilities and scores its texts.
4. Absolute discounting with back-off: bigrams give up ``DISCOUNT`` counts,
   what is not given to bigrams goes to the add-one unigrams.

Words are the lower-cased ``[^\\x20\\x09-\\x0D]+`` runs. The target of
``score`` is any boolean column; the registered query takes the documents
labelled good and not toxic. ``n_unknown`` is zero: no word of the corpus is
unknown.

Edge cases: null or blank text has no tokens, losses and score are null.
Without target texts the target model is uniform over the vocabulary. An empty
table gives an empty result. Repeated rows count and are scored each. Labels
without a document are ignored; several labels of one doc_id make it a target
if any does. A null doc_id is never a target. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import shared_path, short_lived_shuffles, slices, stored

#: Least share of the tokens that a word or bigram needs to be counted: none.
VOCAB_SHARE = BIGRAM_SHARE = 0.0
DISCOUNT = 0.75
#: Stands before every text; no word, as it is a space.
START = b" "
#: Tokens and texts of a block, at least (the last text is whole): bounds what a task holds.
BLOCK, BLOCK_TEXTS = 1 << 20, 1 << 16
#: Bytes of text for one bucket of bigrams.
BUCKET_BYTES = 1 << 23
WORD, GRAM, TOTAL, TEXT = range(4)
#: WORD: hashes. GRAM: keys, counts, target counts. TOTAL: counts, target counts, first. TEXT: places, sizes, doc_ids,
#: which of them are null.
CODED = "block long, kind int, i int, a binary, b binary, c binary, d binary"


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


START_HASH = _hash(START)


def pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, all second ones, ...), compressed: small numbers take little."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1) if len(x) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(data) if data else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return pack(np.diff(x, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _rows(n: int, /, **cols) -> pa.RecordBatch:
    """``n`` rows of CODED; columns that are not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in CODED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, kinds[k]) if name not in cols else
         pa.array(np.full(n, cols[name]) if np.isscalar(cols[name]) else cols[name], kinds[k]) for name, k in fields],
        [name for name, _ in fields])


def _pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams from the hashes of their words."""
    x = prev.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _bigrams(hashes: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct bigrams of a block's texts (places in ``hashes``, which are sorted) in the order of their keys:
    (key, previous word, word, counts) and the place in them of every token."""
    start = np.searchsorted(hashes, np.int64(START_HASH).view(np.uint64))
    prev = np.concatenate(([start], word))[:-1]
    prev[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    pairs, at, n = np.unique(prev * len(hashes) + word, return_inverse=True, return_counts=True)
    prev, word = pairs // len(hashes), pairs % len(hashes)
    key = _pair_keys(hashes[prev], hashes[word])
    order = np.argsort(key, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return key[order], prev[order], word[order], n[order], place[at]


def _buckets(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The buckets of sorted keys, and where each begins and ends."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[edges], list(zip(edges, [*edges[1:], len(keys)]))


#: Texts of one TEXT row.
TEXTS_A_ROW = 512


def _block(block: int, bits: int, local: dict[bytes, int], texts: list[tuple[int | None, np.ndarray, bool]]):
    """The rows of one block: its words and its bigrams by bucket, and its texts."""
    hashes = np.array([_hash(w) for w in local], np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, place = hashes[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket, spans = _buckets(hashes, bits)
    yield _rows(len(spans), block=block, kind=WORD, i=bucket, a=[pack_sorted(hashes[x:z]) for x, z in spans])
    sizes = np.array([len(ids) for _, ids, _ in texts], np.int64)
    ids = place[np.concatenate([ids for _, ids, _ in texts] + [np.zeros(0, np.int32)])]
    key, _, _, n, at = _bigrams(hashes, ids, sizes)
    target = np.repeat(np.array([t for *_, t in texts], bool), sizes)
    n_target = np.bincount(at, weights=target, minlength=len(key)).astype("<i8")
    bucket, spans = _buckets(key, bits)
    if spans:
        yield _rows(len(spans), block=block, kind=GRAM, i=bucket, a=[pack_sorted(key[x:z]) for x, z in spans],
                    b=[pack(n[x:z].astype("<i8")) for x, z in spans], c=[pack(n_target[x:z]) for x, z in spans])
    ends = np.cumsum(sizes)
    for lo in range(0, len(texts), TEXTS_A_ROW):
        part, hi = texts[lo:lo + TEXTS_A_ROW], min(lo + TEXTS_A_ROW, len(texts))
        docs = np.array([0 if d is None else d for d, *_ in part], "<i8")
        yield _rows(1, block=block, kind=TEXT, i=lo, a=[pack(ids[ends[lo] - sizes[lo]:ends[hi - 1]].astype("<u4"))],
                    b=[pack(sizes[lo:hi].astype("<u4"))], c=[pack(docs)],
                    d=[pack(np.array([d is None for d, *_ in part], np.uint8))])


def encode(flagged: DataFrame, bits: int) -> DataFrame:
    """Blocks of (doc_id, text, target) as rows of CODED: kind WORD, GRAM or TEXT, ``i`` the place in its kind (GRAM:
    the bucket, one of 2 ** bits)."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        local, texts, held = {START: 0}, [], 0
        for b in slices(batches):
            for d, t, target in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.array([local.setdefault(w, len(local)) for w in _words(t)], "<i4")
                texts.append((d, ids, target))
                held += len(ids)
                if held >= BLOCK or len(texts) >= BLOCK_TEXTS:
                    yield from _block(block, bits, local, texts)
                    block, local, texts, held = block + 1, {START: 0}, [], 0
        if texts:
            yield from _block(block, bits, local, texts)

    return flagged.select("doc_id", "text", "target").mapInArrow(run, CODED)


def _stored_by_kind(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows of CODED, written to the shared folder with a folder for each kind, and where."""
    spark = rows.sparkSession
    path = shared_path(spark, "lm-coded")
    with short_lived_shuffles(spark):
        rows.write.partitionBy("kind").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns), path


def _drop_kind(spark: SparkSession, path: str, kind: int) -> None:
    """Delete the rows of a kind, which no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _runs(batches):
    """(values of the first two columns, slice) for every run of rows that agree in them."""
    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for lo, hi in zip([0, *new], [*new, len(x)]):
            if lo < hi:
                yield x[lo], y[lo], b.slice(lo, hi - lo)


def _joined(rows: list[pa.RecordBatch], name: str, kind) -> np.ndarray:
    """The numbers of a column of packed rows, one after the other."""
    parts = [unpack(x, kind) for r in rows for x in r.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bigram_totals(coded: DataFrame) -> DataFrame:
    """TOTAL rows: counts of the whole corpus for the bigrams of every block and bucket; ``first`` marks a bigram in one
    of its blocks."""

    def emit(held: list[pa.RecordBatch]):
        keys = [unpack_sorted(x) for r in held for x in r.column("a").to_pylist()]
        sizes, key = np.array([len(k) for k in keys], np.int64), np.concatenate(keys)
        u, first, at = np.unique(key, return_index=True, return_inverse=True)
        mark = np.zeros(len(key), np.uint8)
        mark[first] = 1
        sums = [np.bincount(at, weights=_joined(held, c, "<i8"), minlength=len(u)).astype("<i8")[at] for c in ("b", "c")]
        ends = np.cumsum(sizes)
        whole = pa.Table.from_batches(held)
        yield _rows(len(sizes), block=whole["block"].to_numpy(), kind=TOTAL, i=whole["i"].to_numpy(), **{
            name: [pack(x[lo:hi]) for lo, hi in zip(ends - sizes, ends)] for name, x in zip("abc", (*sums, mark))})

    def run(batches):
        bucket, held = None, []
        for i, _, part in _runs(batches):
            if held and i != bucket:
                yield from emit(held)
                held = []
            bucket = i
            held.append(part)
        if held:
            yield from emit(held)

    dealt = (coded.filter(F.col("kind") == GRAM).select("i", "kind", "block", "a", "b", "c")
             .repartition("i").sortWithinPartitions("i", "block"))
    return dealt.mapInArrow(run, CODED)


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of CODED, those of a block together and in the order of (kind, i)."""
    return rows.repartition("block").sortWithinPartitions("block", "kind", "i")


def _whole_blocks(batches):
    """The rows of every block, by kind."""
    block, held = None, {}
    for at, kind, part in _runs(batches):
        if at != block:
            if held:
                yield held
            block, held = at, {WORD: [], TOTAL: [], TEXT: []}
        held[kind].append(part)
    if held:
        yield held


def _texts(held: dict[int, list[pa.RecordBatch]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens, and the sizes of the texts."""
    return _joined(held[TEXT], "a", "<u4").astype(np.int64), _joined(held[TEXT], "b", "<u4").astype(np.int64)


def _hashes(rows: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([unpack_sorted(x) for r in rows for x in r.column("a").to_pylist()])


COUNTS = ["n", "n_target", "given", "given_target"]


def word_totals(coded: DataFrame, totals: DataFrame) -> DataFrame:
    """(word, n, n_target, given, given_target): counts (of START: texts) and what discounting gives to followers."""

    def run(batches):
        for held in _whole_blocks(batches):
            hashes = _hashes(held[WORD])
            start = np.searchsorted(hashes, np.int64(START_HASH).view(np.uint64))
            _, prev, word, *_ = _bigrams(hashes, *_texts(held))
            first = _joined(held[TOTAL], "c", np.uint8).astype(bool)
            prev, word, out = prev[first], word[first], []
            for side in ("a", "b"):
                n = _joined(held[TOTAL], side, "<i8")[first]
                count = np.bincount(word, weights=n, minlength=len(hashes))
                count[start] = n[prev == start].sum()
                given = np.bincount(prev, weights=np.maximum(n - DISCOUNT, 0), minlength=len(hashes))
                out += [count.astype(np.int64), given.astype(float)]
            some = (out[0] > 0) | (out[1] > 0)  # the others are told by other blocks
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)[some]), *[pa.array(x[some]) for x in out]],
                                             ["word", "n", "given", "n_target", "given_target"])

    rows = coded.filter(F.col("kind").isin(WORD, TEXT)).unionByName(totals)
    return (_by_block(rows).mapInArrow(run, "word long, n long, given double, n_target long, given_target double")
            .groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def words_of_blocks(coded: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """(block, kind, i, a, b, c, d, e): WORD rows with the totals of their words: counts, target counts, and what is given
    in either (single precision)."""
    mine = coded.filter(F.col("kind") == WORD).select("i", F.lit(1).alias("side"), "block", "a")
    table = words.select(F.expr(f"cast(shiftrightunsigned(word, {64 - bits}) as int)").alias("i"), F.lit(0).alias("side"), "word", *COUNTS)
    both = mine.unionByName(table, allowMissingColumns=True).select("i", "side", "block", "a", "word", *COUNTS)

    def run(batches):
        bucket, held, known = None, [], None
        for i, side, part in _runs(batches):
            if i != bucket:
                bucket, held, known = i, [], None
            if side == 0:
                held.append(part)
                continue
            if known is None:  # START is not among them when all texts are blank: a row of zeros stands behind them
                word = np.concatenate([r.column("word").to_numpy() for r in held] + [np.zeros(0, np.int64)]).view(np.uint64)
                order = np.argsort(word)
                known = word[order], [np.append(np.concatenate([r.column(c).to_numpy() for r in held] + [np.zeros(0)])[order], 0)
                                      for c in COUNTS]
            out = []
            for block, a in zip(part.column("block").to_pylist(), part.column("a").to_pylist()):
                asked = unpack_sorted(a)
                at = np.searchsorted(known[0], asked)
                at[np.append(known[0], np.uint64(0))[at] != asked] = len(known[0])
                n, n_target, given, given_target = (x[at] for x in known[1])
                out.append((block, WORD, i, a, pack(n.astype("<i8")), pack(n_target.astype("<i8")), pack(given.astype("<f4")),
                            pack(given_target.astype("<f4"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _WIDE.types)], schema=_WIDE)

    return both.repartition("i").sortWithinPartitions("i", "side").mapInArrow(run, f"{CODED}, e binary")


_WIDE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("i", pa.int32()), *[(c, pa.binary()) for c in "abcde"]])


def log_probabilities(words: np.ndarray, given: np.ndarray, prev: np.ndarray, word: np.ndarray, pairs: np.ndarray,
                      tokens: np.ndarray, size: int) -> np.ndarray:
    """(2, bigrams) of a block: row 0 target, row 1 background, as in ``words``, ``given`` and ``pairs``."""
    p = np.maximum((words + 1.0) / (tokens[:, None] - 1 + size), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.clip(np.where(words > 0, 1 - given / words, 1.0), 1e-6, 1.0)
        rate = np.where(words[:, prev] > 0, np.maximum(pairs - DISCOUNT, 0) / words[:, prev], 0.0)
    return np.log(rate + back[:, prev] * p[:, word])


def _losses(log_p: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(2, texts) mean loss of texts whose tokens are the bigrams ``at``; NaN without tokens."""
    owner, some = np.repeat(np.arange(len(sizes)), sizes), sizes > 0
    loss = np.full((2, len(sizes)), np.nan)
    for m in range(2):
        total = np.bincount(owner, weights=log_p[m, at], minlength=len(sizes))
        loss[m, some] = -total[some] / sizes[some]
    return loss


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_unknown, loss_target, loss_background, score) of every document row.

    ``targets`` has the doc_id of the target documents.
    """
    spark = docs.sparkSession
    wanted = targets.select(F.col("doc_id").cast("long").alias("_t")).filter("_t IS NOT NULL").distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (n_bytes // BUCKET_BYTES).bit_length())
    flagged = (plain.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_t"), "left")
               .select("doc_id", "text", F.col("_t").isNotNull().alias("target")))
    coded, path = _stored_by_kind(encode(flagged, bits))
    totals = stored(bigram_totals(coded), "lm-bigrams")
    _drop_kind(spark, path, GRAM)  # the totals have taken their place
    words = stored(word_totals(coded, totals), "lm-words")
    sums = words.filter(F.col("word") != START_HASH).agg(F.sum("n_target"), F.sum("n"), F.count(F.lit(1))).first()
    tokens, size = np.array([sums[0] or 0, sums[1] or 0], float), sums[2] + 2  # START and an unknown word
    rows = words_of_blocks(coded, words, bits).unionByName(
        coded.filter(F.col("kind") == TEXT).unionByName(totals), allowMissingColumns=True)

    def run(batches):
        for held in _whole_blocks(batches):
            hashes = _hashes(held[WORD])
            n, n_target = (_joined(held[WORD], c, "<i8") for c in "bc")
            given, given_target = (_joined(held[WORD], c, "<f4").astype(float) for c in "de")
            words_at, sizes = _texts(held)
            _, prev, word, _, at = _bigrams(hashes, words_at, sizes)
            pairs = np.stack([_joined(held[TOTAL], c, "<i8") for c in "ba"])
            log_p = log_probabilities(np.stack([n_target, n]), np.stack([given_target, given]), prev, word, pairs, tokens, size)
            loss, none = _losses(log_p, at, sizes), sizes == 0
            ids = pa.array(_joined(held[TEXT], "c", "<i8"), mask=_joined(held[TEXT], "d", np.uint8).astype(bool))
            cols = [pa.array(x, mask=none) for x in (loss[0], loss[1], loss[0] - loss[1])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(np.zeros(len(sizes), np.int64)), *cols],
                ["doc_id", "n_tokens", "n_unknown", "loss_target", "loss_background", "score"])

    return _by_block(rows).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long, loss_target double, "
                                           "loss_background double, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
