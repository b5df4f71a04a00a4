"""Quality scores by co-training of two views (operator 6).

Text view: hashed byte trigrams of the text. Metadata view: source, lang,
n_chars and the page's layout (lines, lengths, shares of character kinds).
Each view has a linear discriminant on balanced class means, fitted in closed
form from sums that Spark adds up, so a fit covers all its rows however many.

Round 0 fits both views on labelled rows. Every round scores all documents
with both views; an unlabelled document that one view is sure of (calibrated
probability at least ``SURE`` or at most 1 - ``SURE``) becomes a training row
of the other view with that label, and both are fitted again. A fifth of the
labelled rows (crc32(doc_id) mod 5 = 0) never trains: it calibrates each view
(Platt scaling on a histogram of its scores) and, at the end, weighs the two
calibrated views into one score, all from counts of bounded size.

Features are computed once, in one pass over the texts, and stored (about 300
bytes a document); rounds read only those.

Edge cases: null text, lang, source or n_chars are values of their own; with
labels of one class only, or none, every score is the prior (0.5 without
labels). A doc_id with several labels counts as good if the mean is at least
one half; labels without a document and null labels are ignored; a null doc_id
has no label. Repeated rows train and are scored each. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored

TEXT_DIMS, SOURCE_DIMS, LANG_DIMS, LAYOUT_DIMS = 256, 32, 8, 14
META_DIMS = SOURCE_DIMS + LANG_DIMS + LAYOUT_DIMS
ROUNDS, SURE, RIDGE = 3, 0.95, 1e-3
BINS, SPAN = 200, 12.0  #: calibration histogram: bins over -SPAN..SPAN standardised scores
GRID = 40  #: bins of each view's logit when the views are combined


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed byte-trigram shares, as bytes."""
    out = np.zeros(TEXT_DIMS, np.uint8)
    if text:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(b) >= 3:
            code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
            n = np.bincount(code >> np.uint32(24), minlength=TEXT_DIMS)
            out = np.minimum(255, np.sqrt(n / n.sum()) * 510).astype(np.uint8)
    return out


def meta_view(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_DIMS, np.uint8)
    slot = lambda s, n: 0 if s is None else 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (n - 1)
    out[slot(source, SOURCE_DIMS)] = 255
    out[SOURCE_DIMS + slot(lang, LANG_DIMS)] = 255
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, lines, words = max(1, len(raw)), max(1, int(byte[10])), max(1, int(byte[32] + byte[10]))
    share = lambda lo, hi: byte[lo:hi].sum() / total
    known = 0 if n_chars is None else max(0, n_chars)
    layout = (n_chars is None, text is None, np.log1p(known) / 14, np.log1p(len(raw)) / 14, np.log1p(lines) / 10,
              np.log1p(len(raw) / lines) / 12, min(1, len(raw) / words / 20), share(0x41, 0x5B), share(0x61, 0x7B),
              share(0x30, 0x3A) * 4, (byte[0x21:0x2C].sum() + byte[0x3A:0x41].sum() + byte[0x7B:0x7F].sum()) / total * 4,
              share(0x2C, 0x2F) * 8, byte[0x21] / total * 8, share(0x80, 0x100))
    out[SOURCE_DIMS + LANG_DIMS:] = [int(255 * min(1.0, float(x))) for x in layout]
    return out


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x binary, meta_x binary) of every document row."""

    def run(batches):
        for b in slices(batches):
            texts, rest = b.column(1).to_pylist(), [b.column(i).to_pylist() for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([text_view(t).tobytes() for t in texts], pa.binary()),
                 pa.array([meta_view(*x).tobytes() for x in zip(texts, *rest)], pa.binary())],
                ["doc_id", "text_x", "meta_x"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return typed.mapInArrow(run, "doc_id long, text_x binary, meta_x binary")


@dataclass
class View:
    """Standardised linear score and its calibration."""

    w: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w + self.bias, -SPAN, SPAN)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.scores(x) + self.b


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dims).astype(np.float32) / 255


def _sum(df: DataFrame, size: int) -> np.ndarray:
    rows = df.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[rows["i"].to_numpy(np.int64)] = rows["v"].to_numpy(float)
    return out


def _emit(acc: np.ndarray):
    at = np.flatnonzero(acc)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at].astype(float))], ["i", "v"])


def _fit(data: DataFrame, old: tuple[View, View] | None) -> tuple[View, View] | None:
    """Both views from labelled training rows and, given ``old`` views, each other's sure rows."""
    dims = (TEXT_DIMS + 1, META_DIMS + 1)
    sizes = [2 * d * d for d in dims]
    high = np.log(SURE / (1 - SURE))

    def run(batches):
        acc = [np.zeros((2, d, d)) for d in dims]
        for b in batches:
            x = [_matrix(b.column(i), d - 1) for i, d in zip((0, 1), dims)]
            y = b.column(2).to_numpy(zero_copy_only=False).astype(float)  # NaN: no label
            use = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            label = [np.where(use, y, np.nan) for _ in x]
            if old is not None:
                for teacher, pupil in ((0, 1), (1, 0)):
                    sure = old[teacher].logits(x[teacher])
                    free = np.isnan(y)
                    label[pupil][free & (sure >= high)] = 1
                    label[pupil][free & (sure <= -high)] = 0
            for v, m in enumerate(x):
                m = np.hstack((m, np.ones((len(m), 1), np.float32)))
                for c in (0, 1):
                    rows = m[label[v] == c]
                    acc[v][c] += rows.T @ rows
        yield _emit(np.concatenate([a.ravel() for a in acc]))

    got = _sum(data.select("text_x", "meta_x", F.col("label").cast("double"), "train")
               .mapInArrow(run, "i long, v double"), sum(sizes))
    out = []
    for v, part in enumerate(np.split(got, [sizes[0]])):
        gram = part.reshape(2, dims[v], dims[v])
        n = gram[:, -1, -1]
        if (n == 0).any():
            return None
        mean = gram[:, -1, :-1] / n[:, None]
        cov = sum(gram[c, :-1, :-1] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)) / 2
        cov += RIDGE * max(np.trace(cov) / len(cov), 1e-9) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
        w = np.linalg.solve(cov, mean[1] - mean[0])
        spread = max(np.sqrt(w @ cov @ w), 1e-9)
        out.append(View(w / spread, float(-(mean.sum(axis=0) / 2) @ w / spread)))
    return out[0], out[1]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients (last: intercept) of a lightly penalised logistic fit on counted cells."""
    x = np.hstack((x, np.ones((len(x), 1))))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - 1e-2 * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _calibrate(data: DataFrame, pair: tuple[View, View]) -> tuple[View, View]:
    """Platt scaling of both views on the labelled rows that never train."""

    def run(batches):
        acc = np.zeros((2, 2, BINS))
        for b in batches:
            y = b.column(2).to_numpy(zero_copy_only=False).astype(int)
            for v, d in ((0, TEXT_DIMS), (1, META_DIMS)):
                s = pair[v].scores(_matrix(b.column(v), d))
                at = np.minimum(((s + SPAN) / (2 * SPAN) * BINS).astype(int), BINS - 1)
                np.add.at(acc[v], (y, at), 1)
        yield _emit(acc.ravel())

    held = data.filter("label IS NOT NULL AND NOT train").select("text_x", "meta_x", "label")
    n = _sum(held.mapInArrow(run, "i long, v double"), 4 * BINS).reshape(2, 2, BINS)
    centre = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN
    out = []
    for v in (0, 1):
        a, b = _logistic(np.tile(centre, 2)[:, None], np.repeat([0.0, 1.0], BINS), n[v].ravel()) if n[v].sum() else (1, 0)
        out.append(View(pair[v].w, pair[v].bias, max(float(a), 1e-3), float(b)))
    return out[0], out[1]


def _cells(logit: np.ndarray) -> np.ndarray:
    return np.clip(((np.clip(logit, -SPAN, SPAN) + SPAN) / (2 * SPAN) * GRID).astype(int), 0, GRID - 1)


def _combine(data: DataFrame, pair: tuple[View, View]) -> np.ndarray:
    """Weights of the two calibrated logits and an intercept."""

    def run(batches):
        acc = np.zeros((2, GRID, GRID))
        for b in batches:
            y = b.column(2).to_numpy(zero_copy_only=False).astype(int)
            at = [_cells(pair[v].logits(_matrix(b.column(v), d))) for v, d in ((0, TEXT_DIMS), (1, META_DIMS))]
            np.add.at(acc, (y, at[0], at[1]), 1)
        yield _emit(acc.ravel())

    held = data.filter("label IS NOT NULL AND NOT train").select("text_x", "meta_x", "label")
    n = _sum(held.mapInArrow(run, "i long, v double"), 2 * GRID * GRID)
    if not n.any():
        return np.array([0.5, 0.5, 0.0])
    centre = (np.arange(GRID) + 0.5) / GRID * 2 * SPAN - SPAN
    grid = np.stack(np.meshgrid(centre, centre, indexing="ij"), axis=-1).reshape(-1, 2)
    return _logistic(np.tile(grid, (2, 1)), np.repeat([0.0, 1.0], GRID * GRID), n)


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of every document row: probabilities of good quality."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_q"))
             .filter("_id IS NOT NULL AND _q IS NOT NULL").groupBy("_id")
             .agg(F.when(F.avg("_q") >= 0.5, 1).otherwise(0).alias("label")))
    data = stored(views(docs).join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn(
        "train", F.col("label").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)),
        "cotraining-views")
    pair = _fit(data, None)
    if pair is None:
        prior = data.agg(F.avg("label")).first()[0]
        level = F.lit(0.5 if prior is None else float(prior))
        return data.select("doc_id", level.alias("text_score"), level.alias("meta_score"), level.alias("score"))
    pair = _calibrate(data, pair)
    for _ in range(rounds):
        pair = _calibrate(data, _fit(data, pair))
    weights = _combine(data, pair)

    def run(batches):
        prob = lambda z: pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        for b in batches:
            z = [pair[v].logits(_matrix(b.column(v + 1), d)) for v, d in ((0, TEXT_DIMS), (1, META_DIMS))]
            both = weights[0] * np.clip(z[0], -SPAN, SPAN) + weights[1] * np.clip(z[1], -SPAN, SPAN) + weights[2]
            yield pa.RecordBatch.from_arrays([b.column(0), prob(z[0]), prob(z[1]), prob(both)],
                                             ["doc_id", "text_score", "meta_score", "score"])

    return data.select("doc_id", "text_x", "meta_x").mapInArrow(
        run, "doc_id long, text_score double, meta_score double, score double")
