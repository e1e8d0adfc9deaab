"""Toxicity: a sparse linear classifier whose scores stay put when identity terms are swapped."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._columns import ALNUM, LOWER, Words, slices, text_buffers, words
from ._labelled import class_samples, held_out, sampled_features, scored

BITS = 20
PREFIX = 5
#: Groups of identity terms; a term is swapped for the others of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features of each word: itself and its first bytes."""
    whole = w.hashes() >> np.uint64(64 - BITS)
    stem = Words(w.raw, w.start, np.minimum(w.end, w.start + PREFIX), w.first).hashes(5) >> np.uint64(64 - BITS)
    return whole.astype(np.int64), stem.astype(np.int64)


def _term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return np.unique(np.concatenate(_buckets(words(raw, np.array([0, len(raw)]), ALNUM))))


def presence(column: pa.Array) -> list[bytes]:
    """Each document's distinct features, as int32."""
    raw, offsets = text_buffers(column)
    out = []
    for i, j in slices(offsets):
        w = words(LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], ALNUM)
        a, b = _buckets(w)
        for s, e in zip(w.first[:-1], w.first[1:]):
            out.append(np.unique(np.concatenate([a[s:e], b[s:e]])).astype(np.int32).tobytes())
    return out


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        raw, offsets = text_buffers(column)
        out = np.full(len(column), self.intercept)
        for i, j in slices(offsets):
            w = words(LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], ALNUM)
            a, b = _buckets(w)
            d = w.doc()
            key = np.concatenate([k[at] | (d[at] << BITS) for k in (a, b) for at in [np.flatnonzero(self.weights[k])]])
            key = np.unique(key)
            out[i:j] += np.bincount(key >> BITS, weights=self.weights[key & ((1 << BITS) - 1)], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[int, bytes]], share: dict[int, float], swap: float = 1.0, sparsity: float = 2e-4, steps: int = 300, groups=IDENTITY_TERMS) -> Model:
    """Logistic loss + sparsity * |w| + swap * mean squared score change over identity swaps.

    A document in which a term of a group stands gives one swapped copy for each
    other term of the group; the model is linear in the features present, so the
    copy's score differs by the weights of the two terms' features alone. Each
    pair of a group counts once besides, for sentences that the sample lacks.
    Without rows of both classes the score is the share of class 1.
    """
    x = [np.frombuffer(b, np.int32) for _, b in rows]
    y = np.array([a for a, _ in rows], float)
    zero = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        p = min(max(share.get(1, 0.0), 1e-3), 1 - 1e-3) if len(y) else 0.01
        return Model(zero, float(np.log(p / (1 - p))))
    size = np.bincount(y.astype(int), minlength=2)
    weight = np.array([share[int(c)] / size[int(c)] for c in y])
    flat, doc = np.concatenate(x).astype(np.int64), np.repeat(np.arange(len(x)), [len(v) for v in x])
    df = np.bincount(flat, minlength=1 << BITS)
    on = np.bincount(flat, weights=y[doc], minlength=1 << BITS)
    expected = df * y.mean()
    terms = {t: _term_features(t) for g in groups for t in g}
    keep = (df >= 3) & (np.abs(on - expected) > 1.5 * np.sqrt(np.maximum(expected * (1 - y.mean()), 1e-9)))
    for f in terms.values():
        keep[f] = df[f] > 0
    names = np.flatnonzero(keep)
    place = np.full(1 << BITS, -1)
    place[names] = np.arange(len(names))
    at = place[flat]
    at, doc = at[at >= 0], doc[place[flat] >= 0]
    has = {t: np.zeros(len(x), bool) for t in terms}
    for t, f in terms.items():
        n = np.bincount(doc[np.isin(at, place[f])], minlength=len(x))
        has[t] = n >= len(f)
    pairs = []
    for g in groups:
        for s in g:
            for t in g:
                if s != t:
                    delta = np.zeros(len(names))
                    delta[place[terms[t]][place[terms[t]] >= 0]] += 1
                    delta[place[terms[s]][place[terms[s]] >= 0]] -= 1
                    if delta.any():
                        pairs.append((1 / len(x) + weight[has[s]].sum(), delta))
    d = np.array([p[1] for p in pairs]) if pairs else np.zeros((0, len(names)))
    c = np.array([p[0] for p in pairs])
    m = len(names)

    def times(w):
        return np.bincount(doc, weights=w[at], minlength=len(x))

    def back(r):
        return np.bincount(at, weights=r[doc], minlength=m)

    v = np.ones(m) / max(np.sqrt(m), 1)
    top = 1.0
    for _ in range(12):
        u = back(weight * times(v)) / 4 + 2 * swap * (d.T @ (c * (d @ v)))
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    rate = 1 / (1.2 * top + 0.3)
    w, b = np.zeros(m), float(np.log(share[1] / share[0]))
    w0, b0, k0 = w, b, 1.0
    z, zb = w, b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(z) + zb, -30, 30)))
        r = weight * (p - y)
        g = back(r) + 2 * swap * (d.T @ (c * (d @ z)))
        w = z - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
        b = zb - rate * r.sum()
        k = (1 + np.sqrt(1 + 4 * k0 * k0)) / 2
        z, zb = w + (k0 - 1) / k * (w - w0), b + (k0 - 1) / k * (b - b0)
        w0, b0, k0 = w, b, k
    zero[names] = w
    return Model(zero, float(b))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_per_class: int = 2500,
    threshold: float = 0.3,
    modulus: int = 4,
    rest: int = 2,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Learns from at most `most_per_class` labelled documents of each class, none of
    them held out; scores whole texts. Null and empty texts get the score of a
    text without known words, null ids are scored and not held out, repeated
    rows repeat, an empty table gives no row, and without labels all scores are low.
    """
    free = labels.where(~held_out(labels[id_col], modulus, rest))
    sample, share = class_samples(free, id_col, label_col, most_per_class)
    model = fit(sampled_features(docs, sample, id_col, text_col, presence), share)
    out = scored(docs, id_col, text_col, model.score)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
