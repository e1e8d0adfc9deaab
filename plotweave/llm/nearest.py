"""Nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import cut
from ._worker import lean

#: Queries that go to all tasks at once; with 2048 dimensions in double precision they take 64 MB at most.
QUERY_VALUES = 8 << 20
MOST_QUERIES = 16_384
#: Bits of a rotated query's components: planes that are met with a code by AND and popcount.
PLANES = 6


@dataclass
class Rotation:
    """A centre and a random rotation; error bounds hold with `bound` standard deviations."""

    centre: np.ndarray
    turn: np.ndarray
    bound: float = 3.0

    def units(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit vectors from the centre, and distances from it."""
        r = x - self.centre
        norm = np.sqrt((r * r).sum(1))
        return (r / np.where(norm > 0, norm, 1)[:, None]) @ self.turn.T, norm

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign bits (packed into 64-bit words), distance from the centre, and the share of the vector that its bits keep."""
        u, norm = self.units(x)
        kept = np.abs(u).sum(1) / np.sqrt(u.shape[1])
        return _packed(u > 0), norm, kept

    def asked(self, queries: np.ndarray) -> list[tuple]:
        """What each query needs to be met with codes: planes of its quantised components, their origin and step, their sum, what quantising can change, distance from the centre."""
        v, norm = self.units(queries)
        out = []
        for x, n in zip(v, norm):
            low, top = float(x.min()), float(x.max())
            step = (top - low) / ((1 << PLANES) - 1) or 1.0
            whole = np.rint((x - low) / step).astype(np.int64)
            planes = [_packed(((whole >> j) & 1 > 0)[None])[0] for j in range(PLANES)]
            known = low + step * whole
            out.append((planes, low, step, float(known.sum()), float(np.abs(x - known).sum()), float(n)))
        return out

    def bounds(self, code: np.ndarray, ones: np.ndarray, norm: np.ndarray, kept: np.ndarray, query: tuple) -> np.ndarray:
        """A squared distance for each row that the true one is above, but for the bound's error. `ones` counts each code's set bits.

        The inner product of a row's signs and a query is made of the counts of bits
        that the code shares with each plane, and corrected by the row's two scalars.
        """
        planes, low, step, total, lost, q_norm = query
        d = self.turn.shape[0]
        shared = np.zeros(len(code), np.int64)
        for j, plane in enumerate(planes):
            both = np.bitwise_count(code & plane)
            shared += (both[:, 0] if code.shape[1] == 1 else both.sum(1)).astype(np.int64) << j
        signs = (2 * (low * ones + step * shared) - total) / np.sqrt(d)
        kept = np.where(kept > 0, kept, 1)
        error = self.bound * np.sqrt(np.maximum(1 - kept * kept, 0)) / np.sqrt(max(d - 1, 1)) + lost / np.sqrt(d)
        cosine = np.minimum((signs + error) / kept, 1)
        return norm**2 + q_norm**2 - 2 * q_norm * norm * cosine

    def lower(self, code: np.ndarray, norm: np.ndarray, kept: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """`bounds` by query and row."""
        ones = np.bitwise_count(code).sum(1)
        return np.array([self.bounds(code, ones, norm, kept, q) for q in self.asked(queries)])


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null ids and vectors that are null, empty, zero or have null or non-finite components."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, most: int = 2048, seed: int = 11, bound: float = 3.0) -> Rotation | None:
    """The mean of `most` vectors, picked by a hash of the id, and a random rotation of their dimension."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    if not got:
        return None
    d = len(got[0]["v"])
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return Rotation(np.mean([r["v"] for r in got if len(r["v"]) == d], axis=0), turn, bound)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def index(rows: DataFrame, model: Rotation) -> DataFrame:
    """(vec_id, v, code, norm, kept) for every row of the model's dimension; others take no part."""
    d = len(model.centre)

    def run(batches):
        for b in batches:
            code, norm, kept = model.encode(_matrix(b.column(1), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(kept)], names=["vec_id", "v", "code", "norm", "kept"])

    return rows.where(F.size("v") == d).mapInArrow(lean(run), "vec_id long, v array<double>, code binary, norm double, kept double")


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the components' order."""
    total = np.zeros(len(x))
    for k in range(len(q)):
        t = x[:, k] - q[k]
        total += t * t
    return np.sqrt(total)


def _block_of(model: Rotation, q_ids: np.ndarray, queries: np.ndarray, k: int):
    """Reads rows of an index and gives the k nearest of the task's for each query of a block."""
    d = len(model.centre)
    asked = model.asked(queries)

    def run(batches):
        best = np.full((len(q_ids), k), np.inf)
        near = np.full((len(q_ids), k), -1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), d)
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
            norm, kept, ones = b.column(3).to_numpy(), b.column(4).to_numpy(), np.bitwise_count(code).sum(1)
            for j, query in enumerate(asked):
                low = model.bounds(code, ones, norm, kept, query)
                low[ids == q_ids[j]] = np.inf
                if best[j, -1] == np.inf:  # the most promising rows tell first how near is near
                    first = np.argpartition(low, min(4 * k, len(low) - 1))[: 4 * k]
                    first = first[low[first] < np.inf]
                    _keep(best[j], near[j], _distances(x[first], queries[j]), ids[first])
                    low[first] = np.inf
                pick = np.flatnonzero((low <= best[j, -1] ** 2 * (1 + 1e-6)) & (low < np.inf))
                # a product is fast but rounds otherwise than a sum in order, so it only picks
                gap = ((x[pick] - queries[j]) ** 2).sum(1)
                pick = pick[gap <= best[j, -1] ** 2 * (1 + 1e-9)]
                if len(pick):
                    _keep(best[j], near[j], _distances(x[pick], queries[j]), ids[pick])
        q, at = np.nonzero(best < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(near[q, at]), pa.array(best[q, at])], names=["query_id", "vec_id", "score"])

    return run


def _keep(best: np.ndarray, near: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Puts the least of old and new into `best` and `near`, ties to the smaller id."""
    score, ids = np.concatenate([best, score]), np.concatenate([near, ids])
    order = np.lexsort((ids, score))[: len(best)]
    best[:], near[:] = score[order], ids[order]


def search(rows: DataFrame, queries: DataFrame, model: Rotation, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query, but for rows with its own id.

    `rows` is an index, `queries` has (vec_id, v) and no id twice. Rows stay where they are stored:
    blocks of queries, bounded in bytes, go to all tasks one after the other, and each task
    returns its k nearest for each. There codes bound every distance from below, and only rows whose
    bound is within the k-th best distance so far are compared exactly. Ties go to the smaller id.
    Work grows with queries times rows, what moves with queries times tasks. On vectors without
    clusters a coarse grouping prunes nothing: its bounds reach all groups.
    """
    d = len(model.centre)
    most = max(1, min(MOST_QUERIES, QUERY_VALUES // d))
    blocks = max(1, -(-queries.count() // most))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for n in range(blocks):
        got = queries.where(part == n).toArrow()
        if not got.num_rows:
            continue
        asked = _matrix(got.column("v").combine_chunks(), d)
        near = rows.mapInArrow(lean(_block_of(model, got.column("vec_id").to_numpy(), asked, k)), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        near = near if blocks == 1 else cut(near)
        found = near if found is None else found.union(near)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest other rows of each row whose id is divisible by `every`.

    Rows with a null id and vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do vectors of another dimension than
    the first sampled one. Rows that repeat an id are candidates one by one, but
    never for their own id; of those the one with the least hash asks. An empty
    table gives no row. Other columns are not read.

    The centre is the mean of at most 2048 vectors (fitting only); every row is coded and searched.
    """
    rows = valid(vectors, id_col, vec_col)
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded = cut(index(rows, model))
    asked = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    return search(coded, cut(asked), model, k)
