"""Language identification with error-correcting output codes (operator 3).

Every language gets a codeword of bits. One binary classifier per bit, on
hashed letter trigrams, says whether a text belongs to the languages whose
codeword has that bit; its weights are log ratios of the trigram frequencies of
the two sides, each side the mean of its languages' smoothed frequencies. The
expected answer of every bit for every language follows from the same counts:
the midpoint between the two sides is the bit's threshold, half the gap its
scale and its weight. A text goes to the codeword with the least weighted
logistic loss; ``ambiguous`` marks texts whose answered bits are too far from
every codeword to be corrected, or whose best two codewords are close.

The counts cover every training text whole: each task sums (language, trigram)
counts, Spark adds them up, and the driver gets the totals, whose size is
languages x ``DIMS`` however large the corpus.

Training uses ``text`` and non-null ``lang`` of rows whose crc32(doc_id as
text) mod 4 is not 2; predictions use the text only. Edge cases: null text and
text without a letter give ``und`` and score 0, as does everything when there
is no training row; a null doc_id is not held out, as its crc32 is null, and
trains like the rest. Repeated rows count as often as they occur. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices

DIMS = 1 << 14
#: Bits for more languages than an exhaustive code serves (2^(n-1) - 1 bits up to 5 languages).
LONG_CODE = 24
UND = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 / -1, no two rows or columns alike (nor columns opposite) as far as n allows.

    Up to five languages: all ways to split them in two. Beyond: the columns
    are drawn by a fixed generator, the best of many draws by least distance.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng, best, far = np.random.default_rng(n), None, -1
    bits = max(LONG_CODE, 4 * int(np.ceil(np.log2(n))))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        gap = (bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits
        if gap.min() > far:
            best, far = code, gap.min()
    return best


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index) of all letter trigrams of the texts.

    Lower-cased; ASCII characters that are no letters become a space, runs of
    spaces one, and every text is enclosed in spaces.
    """
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " if t else b"" for t in texts]
    b = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (at[1:] != at[:-1])
    b, at = b[keep].astype(np.uint32), at[keep]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    inside = at[2:] == at[:-2]
    code = code[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 14)).astype(np.int64), at[:-2][inside]


def counts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their (language, feature) counts over all training texts."""
    train = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    index = {name: i for i, name in enumerate(langs)}

    def run(batches):
        acc = np.zeros(len(langs) * DIMS, np.int64)
        for b in slices(batches):
            of = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            f, at = trigrams(b.column(1).to_pylist())
            if len(f):
                acc += np.bincount(of[at] * DIMS + f, minlength=len(acc))
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], ["i", "n"])

    out = np.zeros(len(langs) * DIMS)
    if langs:
        rows = train.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        out[rows["i"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return langs, out.reshape(len(langs), DIMS)


class Decoder:
    """Bit classifiers and codewords; ``predict`` gives (language, score, ambiguous) per text."""

    def __init__(self, langs: list[str], n: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        if not langs:
            return
        self.code = codewords(len(langs))
        p = (n + alpha) / (n + alpha).sum(axis=1, keepdims=True)
        plus = (self.code > 0).astype(float)
        eps = 1.0 / DIMS ** 2
        side = lambda m: (m.T @ p + eps) / np.maximum(m.sum(axis=0), 1)[:, None]
        self.weights = np.log(side(plus) / side(1 - plus)).T if len(langs) > 1 else np.zeros((DIMS, 1))
        expected = p @ self.weights  # mean answer of each bit for each language
        low = np.where(plus > 0, expected, np.inf).min(axis=0)
        high = np.where(plus > 0, -np.inf, expected).max(axis=0) if len(langs) > 1 else low - 1
        self.threshold, gap = (low + high) / 2, np.maximum((low - high) / 2, 1e-6)
        self.gap, self.weight = gap, gap / gap.sum() * len(gap)
        self.weights = self.weights.astype(np.float32)
        far = (len(gap) - self.code.astype(int) @ self.code.T.astype(int)) // 2
        self.correctable = (far[~np.eye(len(langs), dtype=bool)].min(initial=2) - 1) // 2

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs:
            return [UND] * n, np.zeros(n), np.zeros(n, bool)
        f, at = trigrams([t if h else None for t, h in zip(texts, has)])
        answer = np.zeros((n, self.code.shape[1]))
        if len(f):
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sums = np.add.reduceat(self.weights[f], head, axis=0, dtype=np.float64)
            size = np.diff(np.concatenate((head, [len(f)])))
            answer[at[head]] = (sums / size[:, None] - self.threshold) / self.gap
        # Weighted logistic loss of every codeword.
        loss = np.stack([(self.weight * np.logaddexp(0, -3 * answer * c)).sum(axis=1) for c in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        prob = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        prob /= prob.sum(axis=1, keepdims=True)
        best = order[:, 0]
        score = np.where(has, prob[np.arange(n), best], 0.0)
        wrong = (np.sign(answer) != self.code[best]).sum(axis=1)
        second = prob[np.arange(n), order[:, 1]] if len(self.langs) > 1 else np.zeros(n)
        unclear = has & ((wrong > self.correctable) | (score - second < 0.2))
        return [self.langs[k] if h else UND for k, h in zip(best, has)], score, unclear


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document row."""
    decoder = Decoder(*counts(docs))

    def run(batches):
        for b in slices(batches):
            lang, score, unclear = decoder.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"))
