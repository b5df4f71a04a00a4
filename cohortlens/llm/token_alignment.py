"""Alignment of two tokenizers over the same bytes (operator 11).

Byte offsets at which a token of A and a token of B both end cut a text into
groups; every token of A is linked with every token of B of its group.

1. *Fragments.* A fragment describes any byte range of a text: the tokens of
   either side before the first common end (open prefix), the closed groups
   between common ends, and the tokens after the last one (open suffix).
   ``compose`` joins two neighbouring ranges: the left suffix and the right
   prefix become one closed group. It is associative and ``Fragment()`` is its
   identity, so ranges can be composed in any tree.
2. *Texts.* Texts of up to ``chunk`` bytes make one fragment at once. Longer
   ones are cut into byte ranges, dealt over the tasks and tokenized there; the
   fragments of neighbouring ranges are composed ``FAN`` at a time, level by
   level, until one is left per text. Only the token groups of a text, never
   its tokens and links as rows, meet in a task.
3. *Words.* A single space between two characters that are no white space ends
   a token of both sides whatever surrounds it (A's pattern starts a token
   there, and no piece of B has a space behind another character; this is
   checked when the vocabulary is read). So the ids of `` word`` do not depend
   on its neighbours and are kept per worker for repeated words. A range that
   begins or ends inside a word tokenizes the whole word and keeps the tokens
   that end in the range.
4. *Counts.* Every document's distinct id pairs are counted per task before
   they are shuffled; pairs seen in two or more documents go back to the
   documents in bounded slices of whole A ids (``SLICE_PAIRS``), each broadcast
   in turn, so nothing that is broadcast grows with the corpus. A pair that is
   in no slice was seen once.

Edge cases: null and empty texts, and texts that the pieces of a side do not
give back byte for byte (a literal U+2581, for one), have no tokens: zeros and
an empty digest. Rows that repeat an id or a text are documents of their own. A
null doc_id stays null. An empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored

VOCABULARIES = "/opt/tokenizers"
#: Texts of more bytes are cut into ranges of this size.
CHUNK = 1 << 15
#: Neighbouring fragments composed by one row of the next level.
FAN = 8
#: Words whose ids a worker keeps.
KEPT_WORDS = 250_000
#: Pair counts broadcast at a time (a slice holds whole A ids, each of at most B's vocabulary).
SLICE_PAIRS = 4_000_000
#: Pairs that a task folds at a time while counting.
FOLD = 4_000_000

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SAFE_BYTES = re.compile(rb"(?<=[!-~]) (?=[!-~])")


@dataclass
class Body:
    """Closed groups in order: totals, their text, and link counts per pair code."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: list[str] = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)

    def plus(self, other: Body) -> Body:
        return Body(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups,
                    self.n_links + other.n_links, self.groups + other.groups, self.codes + other.codes)


@dataclass
class Fragment:
    """A byte range of a text. Without a common end (``cut``) all its tokens are in the prefix."""

    ok: bool = True
    cut: bool = False
    pre_a: list[int] = field(default_factory=list)
    pre_b: list[int] = field(default_factory=list)
    body: Body = field(default_factory=Body)
    suf_a: list[int] = field(default_factory=list)
    suf_b: list[int] = field(default_factory=list)


def group_body(a: list[int], b: list[int], size_b: int) -> Body:
    """One closed group; no tokens make no group."""
    if not a and not b:
        return Body()
    codes = (np.array(a, np.int64)[:, None] * size_b + np.array(b, np.int64)[None, :]).ravel()
    return Body(len(a), len(b), 1, len(a) * len(b), [",".join(map(str, a)) + "|" + ",".join(map(str, b))], [codes])


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of two neighbouring ranges."""
    ok = x.ok and y.ok
    if not x.cut:
        return Fragment(ok, y.cut, x.pre_a + y.pre_a, x.pre_b + y.pre_b, y.body, y.suf_a, y.suf_b)
    if not y.cut:
        return Fragment(ok, True, x.pre_a, x.pre_b, x.body, x.suf_a + y.pre_a, x.suf_b + y.pre_b)
    met = group_body(x.suf_a + y.pre_a, x.suf_b + y.pre_b, size_b)
    return Fragment(ok, True, x.pre_a, x.pre_b, x.body.plus(met).plus(y.body), y.suf_a, y.suf_b)


def closed(f: Fragment, size_b: int) -> Body:
    """The groups of a whole text, whose ends close the open ones."""
    return group_body(f.pre_a, f.pre_b, size_b).plus(f.body).plus(group_body(f.suf_a, f.suf_b, size_b))


def token_fragment(a: list[tuple[int, int]], b: list[tuple[int, int]], size_b: int, ok: bool = True) -> Fragment:
    """Fragment of a range given as (id, end) tokens of both sides."""
    both = sorted({e for _, e in a} & {e for _, e in b})
    if not both:
        return Fragment(ok, False, [i for i, _ in a], [i for i, _ in b])
    out, i, j = Fragment(ok, True), 0, 0
    for n, end in enumerate(both):
        ga, gb = [], []
        while i < len(a) and a[i][1] <= end:
            ga.append(a[i][0])
            i += 1
        while j < len(b) and b[j][1] <= end:
            gb.append(b[j][0])
            j += 1
        if n:
            out.body = out.body.plus(group_body(ga, gb, size_b))
        else:
            out.pre_a, out.pre_b = ga, gb
    out.suf_a, out.suf_b = [t for t, _ in a[i:]], [t for t, _ in b[j:]]
    return out


class Words:
    """Ids of both sides for `` word``, kept for repeated words, with their closed groups."""

    def __init__(self, path_a: str, path_b: str, keep: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.side_a = Tokenizer.from_file(path_a)
        self.side_a.encode_special_tokens = True
        self.side_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b, self.keep = self.side_b.get_piece_size(), keep
        self.bytes_a = _byte_level(self.side_a)
        if len(self.bytes_a) * self.size_b > 1 << 32:
            raise ValueError("pair codes have 32 bits: the vocabularies are too large")
        pieces = [self.side_b.id_to_piece(i) for i in range(self.size_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("side B has pieces with a space behind another character: words are not independent")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.side_b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.at: dict[str, int] = {}
        self.totals = np.zeros((0, 5), np.int64)  # ok, n_a, n_b, n_groups, n_links
        self.groups: list[str] = []
        self.pool, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def ends(self, word: str) -> tuple[bool, list, list]:
        """Whether the tokens give the word back, and (id, end) of both sides from its leading space on."""
        a, b = self.side_a.encode(" " + word, add_special_tokens=False).ids, self.side_b.encode(word)
        x, y = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        ok = b"".join(x) == b"".join(y) == b" " + word.encode()
        return ok, list(zip(a, np.cumsum([len(t) for t in x]).tolist())), list(zip(b, np.cumsum([len(t) for t in y]).tolist()))

    def add(self, words: Iterable[str]) -> None:
        """Make the words known."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if not new:
            return
        # Blanks at an end of a word could join with those between words; such words go by themselves.
        bare = [w for w in new if w == w.strip()]
        found = [self._closed(bare)] if bare else []
        found += [self._closed([w]) for w in new if w != w.strip()]
        for w in bare + [w for w in new if w != w.strip()]:
            self.at[w] = len(self.at)
        self.groups += [g for f in found for g in f[1]]
        self.totals = np.concatenate([self.totals, *[f[0] for f in found]])
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate([f[2] for f in found]))))
        self.pool = np.concatenate([self.pool, *[f[3] for f in found]])

    def _closed(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(totals, groups, number of pair codes, the codes) of words, all of them in one text.

        Words do not depend on their neighbours, so the text of all has the tokens of each; its byte offsets are cut at
        the common ends like those of any text. A word that its tokens do not give back is found by halving.
        """
        text = " ".join(words)
        a = np.array(self.side_a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.side_b.encode(text), np.int64)
        x, y = [self.bytes_a[i] for i in a.tolist()], [self.bytes_b[i] for i in b.tolist()]
        if not (b"".join(x) == b"".join(y) == (" " + text).encode()):
            if len(words) == 1:
                return np.zeros((1, 5), np.int64), [""], np.zeros(1, np.int64), np.zeros(0, np.int64)
            half = len(words) // 2
            one, two = self._closed(words[:half]), self._closed(words[half:])
            return (np.concatenate((one[0], two[0])), one[1] + two[1], np.concatenate((one[2], two[2])),
                    np.concatenate((one[3], two[3])))
        end_a, end_b = np.cumsum([len(t) for t in x]), np.cumsum([len(t) for t in y])
        cuts = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # Every token of A with all tokens of B of its group.
        times = n_b[group_a]
        other = np.repeat(at_b[group_a] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        codes = np.repeat(a, times) * self.size_b + b[other]
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        last = np.searchsorted(cuts, ends) + 1  # groups up to the end of each word
        from_ = np.concatenate(([0], last[:-1]))
        per = np.stack([n_a, n_b, np.ones(len(cuts), np.int64), n_a * n_b], axis=1)
        totals = np.concatenate((np.ones((len(words), 1), np.int64), np.add.reduceat(per, from_, axis=0)), axis=1)
        ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spelled = [",".join(ids_a[i:i + n]) + "|" + ",".join(ids_b[j:j + m]) if n > 1 or m > 1 else ids_a[i] + "|" + ids_b[j]
                   for i, n, j, m in zip(at_a.tolist(), n_a.tolist(), at_b.tolist(), n_b.tolist())]
        groups = [spelled[i] if j == i + 1 else ";".join(spelled[i:j]) for i, j in zip(from_.tolist(), last.tolist())]
        return totals, groups, totals[:, 4], codes

    def forget(self) -> None:
        """Drop the words beyond those kept (frequent words are met early)."""
        if len(self.groups) > self.keep:
            for w in list(self.at)[self.keep:]:
                del self.at[w]
            del self.groups[self.keep:]
            self.totals, self.first = self.totals[: self.keep].copy(), self.first[: self.keep + 1].copy()
            self.pool = self.pool[: self.first[-1]].copy()

    def body(self, words: list[str]) -> tuple[bool, Body]:
        """Closed groups of whole words that have been added."""
        i = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        sums = self.totals[i]
        n, start = self.first[i + 1] - self.first[i], self.first[i]
        codes = self.pool[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ok, (n_a, n_b, n_groups, n_links) = bool(sums[:, 0].all()), sums[:, 1:].sum(axis=0).tolist()
        return ok, Body(n_a, n_b, n_groups, n_links, [self.groups[k] for k in i.tolist()], [codes])


def _byte_level(tokenizer) -> list[bytes]:
    """Bytes of every entry of a byte-level vocabulary: printable bytes stand for themselves, the others, in order,
    for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for entry, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


_WORDS: dict[tuple[str, str], Words] = {}


def words_of(path_a: str, path_b: str) -> Words:
    """The worker's word table, shared by its tasks."""
    if (path_a, path_b) not in _WORDS:
        _WORDS[path_a, path_b] = Words(path_a, path_b)
    return _WORDS[path_a, path_b]


def byte_ranges(text: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """(from, to, lo, hi) of the ranges of `` text``: the range [lo, hi) and the whole words [from, to) around it.

    Offsets count the leading space. A boundary inside a run without a safe
    space that is longer than a quarter range moves to the end of the run.
    """
    y = b" " + text
    bounds = [(0, 0, 0)]  # (start of the word around the boundary, the boundary, end of that word)
    x = chunk
    while x < len(y):
        m = _SAFE_BYTES.search(y, x)
        right = m.start() if m else len(y)
        left = max((c.start() for c in _SAFE_BYTES.finditer(y, max(bounds[-1][2], x - chunk // 4), x + 1)),
                   default=-1)
        if right == x or left < 0 or right - left > chunk // 4:
            left, x = right, right
        if x >= len(y):
            break
        bounds.append((left, x, right))
        x += chunk
    bounds.append((len(y), len(y), len(y)))
    return [(p[0], q[2], p[1], q[1]) for p, q in zip(bounds, bounds[1:])]


def range_fragment(words: Words, body: bytes, lead: int, keep: int) -> Fragment:
    """Fragment of the bytes [lead, keep) of ``body``, whole words with their leading space."""
    size_b, parts = words.size_b, _SAFE.split(body[1:].decode())
    ends = np.cumsum([1 + len(w.encode()) for w in parts])
    starts = np.concatenate(([0], ends[:-1]))
    inner = np.flatnonzero((starts >= lead) & (ends <= keep))  # consecutive words
    cut = np.flatnonzero((ends > lead) & (starts < keep) & ((starts < lead) | (ends > keep))).tolist()  # at either boundary

    def inside(k: int) -> Fragment:
        ok, a, b = words.ends(parts[k])
        return token_fragment(*([(i, e + starts[k]) for i, e in side if lead < e + starts[k] <= keep] for side in (a, b)),
                              size_b, ok)

    out = Fragment()
    if cut and starts[cut[0]] < lead:
        out = inside(cut.pop(0))
    if len(inner):
        whole = [parts[k] for k in inner.tolist()]
        words.add(whole)
        ok, body_of = words.body(whole)
        out = compose(out, Fragment(ok, True, body=body_of), size_b)
    if cut:
        out = compose(out, inside(cut[0]), size_b)
    return out


# ---------------------------------------------------------------- rows

_FRAGMENT = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("ok", pa.bool_()), ("cut", pa.bool_()),
    ("pre_a", pa.list_(pa.int32())), ("pre_b", pa.list_(pa.int32())), ("suf_a", pa.list_(pa.int32())),
    ("suf_b", pa.list_(pa.int32())), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("codes", pa.binary()), ("times", pa.binary())])
_FRAGMENT_DDL = ("rid long, doc_id long, part int, ok boolean, cut boolean, pre_a array<int>, pre_b array<int>, "
                 "suf_a array<int>, suf_b array<int>, n_a long, n_b long, n_groups long, n_links long, groups string, "
                 "codes binary, times binary")
_DONE = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                   ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary())])
_DONE_DDL = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "groups_sha256 string, codes binary, times binary")


def _packed(codes: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Distinct pair codes in order, and how often each is linked."""
    if not codes:
        return b"", b""
    if len(codes) == 1 and not len(codes[0]):
        return b"", b""
    values, times = np.unique(np.concatenate(codes), return_counts=True)
    return values.astype("<u4").tobytes(), times.astype("<u4").tobytes()


def _unpacked(codes: bytes, times: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64))


def _row(rid, doc_id, part, f: Fragment) -> tuple:
    b, (codes, times) = f.body, _packed(f.body.codes)
    return (rid, doc_id, part, f.ok, f.cut, f.pre_a, f.pre_b, f.suf_a, f.suf_b, b.n_a, b.n_b, b.n_groups, b.n_links,
            ";".join(b.groups), codes, times)


def _fragment(r: tuple) -> Fragment:
    body = Body(r[9], r[10], r[11], r[12], [r[13]] if r[11] else [], [_unpacked(r[14], r[15])])
    return Fragment(r[3], r[4], list(r[5]), list(r[6]), body, list(r[7]), list(r[8]))


def _done(rid, doc_id, ok: bool, body: Body, keep_groups: bool) -> tuple:
    if not ok or not body.n_groups:
        return rid, doc_id, 0, 0, 0, 0, "" if keep_groups else None, "", b"", b""
    text = ";".join(body.groups)
    return (rid, doc_id, body.n_a, body.n_b, body.n_groups, body.n_links, text if keep_groups else None,
            hashlib.sha256(text.encode()).hexdigest(), *_packed(body.codes))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK, fan: int = FAN,
            keep_groups: bool = True) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups, groups_sha256, codes, times) for every row of ``docs``.

    ``groups`` spells the token groups (``a1,a2|b1;...``, null unless kept),
    ``codes`` holds the distinct pairs as ``a * size_b + b`` in order (32-bit)
    and ``times`` how many links each has. ``rid`` numbers the rows.
    """
    path_a, path_b = path_a or f"{VOCABULARIES}/byte_bpe_50k.json", path_b or f"{VOCABULARIES}/piece_bpe_32k.model"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    whole = F.coalesce(F.octet_length("text") <= chunk, F.lit(True))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path_a, path_b)
        for b in slices(batches, 512):
            split = [_SAFE.split(t) if t else [] for t in b.column(2).to_pylist()]
            words.add(w for ws in split for w in ws)
            out = []
            for rid, doc_id, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), split):
                ok, body = words.body(ws) if ws else (False, Body())
                out.append(_done(rid, doc_id, ok, body, keep_groups))
            words.forget()
            yield _batch(out, _DONE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("lead", pa.int32()),
                            ("keep", pa.int32()), ("body", pa.binary())])
        for b in slices(batches, 1):
            rid, doc_id, text = (c[0].as_py() for c in b.columns)
            y = text.encode()
            for part, (start, end, lo, hi) in enumerate(byte_ranges(y, chunk)):
                body = (b" " + y[:end - 1]) if not start else y[start - 1:end - 1]
                yield _batch([(rid, doc_id, part, lo - start, hi - start, body)], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path_a, path_b)
        for b in slices(batches, 16):
            yield _batch([_row(r["rid"], r["doc_id"], r["part"], range_fragment(words, r["body"], r["lead"], r["keep"]))
                          for r in b.to_pylist()], _FRAGMENT)
            words.forget()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_b, held = words_of(path_a, path_b).size_b, None
        for b in slices(batches, 16):
            for r in zip(*(c.to_pylist() for c in b.columns)):
                key = (r[0], r[2] // fan)
                if held and held[0] == key:
                    held = key, r[1], compose(held[2], _fragment(r), size_b)
                else:
                    if held:
                        yield _batch([_row(held[0][0], held[1], held[0][1], held[2])], _FRAGMENT)
                    held = key, r[1], _fragment(r)
        if held:
            yield _batch([_row(held[0][0], held[1], held[0][1], held[2])], _FRAGMENT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_b = words_of(path_a, path_b).size_b
        for b in slices(batches, 1):
            for r in zip(*(c.to_pylist() for c in b.columns)):
                f = _fragment(r)
                yield _batch([_done(r[0], r[1], f.ok, closed(f, size_b), keep_groups)], _DONE)

    done = rows.filter(whole).mapInArrow(short, _DONE_DDL)
    ranges = rows.filter(~whole).mapInArrow(cut, "rid long, doc_id long, part int, lead int, keep int, body binary")
    parts = stored(ranges.repartition("rid", "part").mapInArrow(read, _FRAGMENT_DDL), "align-fragments")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last:  # one level of the tree: up to ``fan`` neighbours become one fragment
        level = parts.withColumn("_g", F.floor(F.col("part") / fan)).repartition("rid", "_g").sortWithinPartitions(
            "rid", "_g", "part").drop("_g")
        parts, last = stored(level.mapInArrow(joined, _FRAGMENT_DDL), "align-fragments"), last // fan
    return done.unionByName(parts.mapInArrow(finish, _DONE_DDL))


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, n): in how many documents every id pair is linked; folded per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, rest = [], 0, (np.zeros(0, np.uint32), np.zeros(0, np.int64))

        def fold():
            values = np.concatenate([rest[0], *held]).astype(np.uint32)
            weights = np.concatenate((rest[1], np.ones(len(values) - len(rest[1]), np.int64)))
            codes, at = np.unique(values, return_inverse=True)
            return codes, np.bincount(at, weights, len(codes)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(rest[0].astype(np.int64)), pa.array(rest[1])], ["code", "n"])

        for b in batches:
            for c in b.column(0):
                held.append(np.frombuffer(c.as_buffer(), "<u4").copy())  # the buffer goes with the batch
                n += len(held[-1])
                if n >= FOLD:
                    rest, held, n = fold(), [], 0
                    if len(rest[0]) >= FOLD:
                        yield out()
                        rest = rest[0][:0], rest[1][:0]
        rest = fold()
        yield out()

    return found.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def count_slices(counts: DataFrame, size_b: int, most: int = SLICE_PAIRS) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of A ids that hold at most ``most`` counted pairs each (or one id), covering all ids.

    One number per A id reaches the driver: bounded by the vocabulary.
    """
    per_a = counts.groupBy(F.floor(F.col("code") / size_b).alias("a")).count().orderBy("a").collect()
    bounds, held = [0], 0
    for a, n in per_a:
        if held and held + n > most:
            bounds.append(a)
            held = 0
        held += n
    return list(zip(bounds, [*bounds[1:], 1 << 32]))


def with_counts(found: DataFrame, size_b: int, most: int = SLICE_PAIRS) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum``; ``found`` must be a written table."""
    spark = found.sparkSession
    counts = stored(pair_counts(found).filter("n > 1"), "align-counts")
    ranges = count_slices(counts, size_b, most)

    def look_up(lo: int, hi: int):
        got = counts.filter((F.col("code") >= lo * size_b) & (F.col("code") < hi * size_b)).toArrow()
        order = np.argsort(codes := got["code"].to_numpy())
        shared = spark.sparkContext.broadcast((codes[order].astype(np.uint32), got["n"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, n = shared.value
            best = np.ones(hi - lo if hi < 1 << 32 else int(table[-1]) // size_b - lo + 1 if len(table) else 1, np.int64)
            np.maximum.at(best, (table // size_b).astype(np.int64) - lo, n)
            for b in slices(batches, 1024):
                codes, times = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
                n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for r in range(b.num_rows):
                    x = np.frombuffer(codes[r].as_buffer(), "<u4")
                    i, j = np.searchsorted(x, [lo * size_b, min(hi * size_b, 1 << 32)]) if len(ranges) > 1 else (0, len(x))
                    x, t = x[i:j], np.frombuffer(times[r].as_buffer(), "<u4")[i:j].astype(np.int64)
                    count = np.ones(len(x), np.int64)
                    if len(table):
                        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
                        count = np.where(table[at] == x, n[at], 1)
                    a = (x // size_b).astype(np.int64) - lo
                    top = np.where(a < len(best), best[np.minimum(a, len(best) - 1)], 1)
                    n_best[r], total[r] = t[count == top].sum(), (t * count).sum()
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_best), pa.array(total)],
                                                 [*b.schema.names[:-2], "n_best", "count_sum"])
        return run

    kept = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    ddl = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "n_best long, count_sum long")
    if len(ranges) == 1:
        return found.select(*kept, "codes", "times").mapInArrow(look_up(*ranges[0]), ddl)
    sums = None
    for lo, hi in ranges:  # one bounded broadcast at a time
        part = stored(found.select("rid", "codes", "times").mapInArrow(look_up(lo, hi),
                                                                       "rid long, n_best long, count_sum long"), "align-slice")
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*kept).join(sums, "rid")


def digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK, fan: int = FAN,
           most: int = SLICE_PAIRS) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    path_b = path_b or f"{VOCABULARIES}/piece_bpe_32k.model"
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = stored(aligned(docs, path_a, path_b, chunk, fan, keep_groups=False).drop("groups"), "align-documents")
    return with_counts(found, size_b, most).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
