"""Text quality: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._columns import ALNUM, LOWER, slices, text_buffers, words
from ._labelled import class_samples, held_out, sampled_features, scored

WORD_BITS = 16
BINS = 10
#: Statistics of a text's structure, and of its size as metadata.
STATISTICS = ("upper", "digits", "marks", "exclamation", "bars", "symbols", "space", "word_length", "distinct", "line_length", "repeated_lines", "top_byte", "bytes", "lines")


def _statistics(raw: np.ndarray, offsets: np.ndarray, distinct: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    one = np.maximum(size, 1)

    def share(members) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        return np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets]) / one

    upper, lower = share(range(65, 91)), share(range(97, 123))
    lines = share([10]) * one + 1
    repeated, top = np.zeros(n), np.zeros(n)
    for d in range(n):
        part = raw[offsets[d] : offsets[d + 1]]
        if len(part):
            split = part.tobytes().split(b"\n")
            repeated[d] = 1 - len(set(split)) / len(split)
            top[d] = np.bincount(part, minlength=256).max() / len(part)
    return np.column_stack([
        upper / np.maximum(upper + lower, 1e-9), share(range(48, 58)), share([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]),
        share(b"!"), share(b"|"), share(b"#$%&*@^~<>{}[]\\"), share([32, 9, 13]), size / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1),
        size / lines, repeated, top, np.log1p(size), np.log1p(lines),
    ])


def _rows(column: pa.Array):
    """For each slice: first document, documents and distinct word buckets (pairs, by document), statistics."""
    raw, offsets = text_buffers(column)
    for i, j in slices(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = words(LOWER[part], at, ALNUM)
        bucket = (w.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        key = np.unique(bucket | (w.doc() << WORD_BITS))
        d, b = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
        yield i, j, d, b, _statistics(part, at, np.bincount(d, minlength=j - i), np.diff(w.first))


def features(column: pa.Array) -> list[bytes]:
    """Each document's statistics (float32) and distinct word buckets (int32)."""
    out = []
    for i, j, d, b, s in _rows(column):
        first = np.searchsorted(d, np.arange(j - i + 1))
        out += [s[k].astype("<f4").tobytes() + b[first[k] : first[k + 1]].astype("<i4").tobytes() for k in range(j - i)]
    return out


@dataclass
class Model:
    """score = sigmoid(bias + w.x + 1/2 sum_f ((v_f.x)^2 - v_f^2.x^2)); linear in the number of features present."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def margin(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[f] * x[:, None]
        first = np.searchsorted(d, np.arange(n))
        full = np.add.reduceat(np.vstack([vx, np.zeros((1, vx.shape[1]), vx.dtype)]), first, axis=0)
        squares = np.bincount(d, weights=(vx * vx).sum(1), minlength=n)
        linear = np.bincount(d, weights=self.w[f] * x, minlength=n)
        return self.bias + linear + 0.5 * ((full * full).sum(1) - squares), full

    def inputs(self, d: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, features and values, by document: words at equal length, and one bin of each statistic."""
        n, k = s.shape
        bins = np.column_stack([np.searchsorted(self.edges[c], s[:, c], "right") for c in range(k)])
        stat = (1 << WORD_BITS) + np.arange(k) * BINS + bins
        count = np.bincount(d, minlength=n)
        order = np.argsort(np.concatenate([np.repeat(np.arange(n), k), d]), kind="stable")
        docs = np.concatenate([np.repeat(np.arange(n), k), d])[order]
        feats = np.concatenate([stat.ravel(), b])[order]
        values = np.concatenate([np.ones(n * k), 1 / np.sqrt(np.maximum(count, 1))[d]])[order]
        return docs, feats, values.astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, d, b, s in _rows(column):
            m, _ = self.margin(*self.inputs(d, b, s.astype("<f4")), j - i)
            out[i:j] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return out


def fit(rows: list[tuple[int, bytes]], share: dict[int, float], rank: int = 6, epochs: int = 14, rate: float = 0.05, decay: float = 2e-5, batch: int = 128) -> Model:
    """Adagrad on the weighted logistic loss; without rows of both classes the score is the share of class 1."""
    size = (1 << WORD_BITS) + len(STATISTICS) * BINS
    k = len(STATISTICS)
    rng = np.random.default_rng(7)
    model = Model(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, rank)) * 0.03).astype(np.float32), np.zeros((k, BINS - 1)))
    y = np.array([a for a, _ in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(max(share.get(1, 0.5), 1e-3), 1 - 1e-3)
        model.bias = float(np.log(p / (1 - p)))
        model.v[:] = 0
        return model
    s = np.array([np.frombuffer(b[: 4 * k], "<f4") for _, b in rows])
    model.edges = np.quantile(s, np.arange(1, BINS) / BINS, axis=0).T.astype("<f4")
    word = [np.frombuffer(b[4 * k :], "<i4").astype(np.int64) for _, b in rows]
    counts = np.bincount(y.astype(int), minlength=2)
    weight = np.array([share[int(c)] / counts[int(c)] for c in y]) * len(y)
    model.bias = float(np.log(share[1] / share[0]))
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            d = np.repeat(np.arange(len(pick)), [len(word[i]) for i in pick])
            d, f, x = model.inputs(d, np.concatenate([word[i] for i in pick]), s[pick])
            m, full = model.margin(d, f, x, len(pick))
            r = weight[pick] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[pick]) / len(pick)
            model.bias -= rate * float(r.sum())
            u, back = np.unique(f, return_inverse=True)
            rx = (r[d] * x).astype(np.float32)
            dw = np.bincount(back, weights=rx, minlength=len(u)) + decay * model.w[u]
            gw[u] += dw * dw
            model.w[u] -= rate * dw / np.sqrt(gw[u])
            each = rx[:, None] * (full[d] - model.v[f] * x[:, None])
            dv = np.column_stack([np.bincount(back, weights=each[:, c], minlength=len(u)) for c in range(rank)]) + decay * model.v[u]
            gv[u] += dv * dv
            model.v[u] -= rate * dv / np.sqrt(gv[u])
    return model


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_per_class: int = 2500,
    threshold: float = 0.5,
    modulus: int = 3,
    rest: int = 1,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Learns from at most `most_per_class` labelled documents of each class, none of
    them held out; scores whole texts. Null and empty texts are scored by their
    (empty) structure, null ids are scored and not held out, repeated rows
    repeat, an empty table gives no row, and without labels all scores are 0.5.
    """
    free = labels.where(~held_out(labels[id_col], modulus, rest))
    sample, share = class_samples(free, id_col, label_col, most_per_class)
    model = fit(sampled_features(docs, sample, id_col, text_col, features), share)
    out = scored(docs, id_col, text_col, model.score)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
