"""What the two substring de-duplicators share: settling which windows of text repeat earlier ones.

A window is a fixed number of consecutive units (words or bytes) of one document.
A scheme picks an anchor for each window from the window's content alone, so
equal windows have equal anchors. Consecutive windows with one anchor form a
stretch; only stretches travel, as (k, c, doc, at, n): hash of the anchor, hash of
the whole stretch, document, first window, number of windows.

1. Each task emits its stretches, equal ones of a slice once, and those that it meets
   in slice after slice about once (Met); the others are marked as repeats on the spot.
2. Stretches are dealt and sorted by (k, c, doc, at) and read as a stream: of equal
   stretches all but the first repeat. Anchors with several different stretches go on.
3. Their windows are compared one by one in the same way (by a scheme's own means).
4. Marks are gathered by document and applied.

No step holds more than a slice, a batch or a document, whatever the number of copies.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._columns import mix, runs, slices, text_buffers
from ._worker import lean

#: A document's parts (rows that share its id) are told apart in the upper bits of a place.
PART = 40
NO_ID = -(1 << 63)
#: What steps read of with_ranges: all of it, so that every join reads one and the same exchange of the documents.
JOINED = ("doc", "part", "text", "ranges", "rest")
_STRETCH = "kind byte, k long, c long, doc long, at long, n int"
_MARK = "doc long, at long, n int"
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


#: Powers are a product of two, from tables of this many: a long text needs no longer table.
_TABLE_BITS = 16


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, ...]:
    """P^i and P^-i for i below the tables' length, and the same for its multiples."""
    out, n = [], 1 << _TABLE_BITS
    for base in (_P, _INVERSE):
        for step in (int(base), pow(int(base), n, 1 << 64)):
            table = np.full(n, np.uint64(step))
            table[0] = 1
            out.append(np.cumprod(table))
    return tuple(out)


class RangeHash:
    """Hashes of ranges of 64-bit units in constant time each."""

    def __init__(self, units: np.ndarray):
        up, far_up, self.down, self.far_down = _powers()
        self.sums = np.zeros(len(units) + 1, np.uint64)
        for k, at in enumerate(range(0, len(units), len(up))):
            part = units[at : at + len(up)]
            np.multiply(part, up[: len(part)] * far_up[k], out=self.sums[at + 1 : at + 1 + len(part)])
        np.cumsum(self.sums, out=self.sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self.down[start & (len(self.down) - 1)]
        if len(self.sums) > len(self.down):
            down = down * self.far_down[start >> _TABLE_BITS]
        return mix((self.sums[end] - self.sums[start]) * down + (end - start).astype(np.uint64))


def prepared(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, part, text, rest), null ids as NO_ID and null texts as empty; rest holds the columns `carry`.

    Rows that share an id are parts of one document, in order of a hash of their
    text; matches don't cross parts, and rows with the same id and text are one part.
    """
    d = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*((docs[c] for c in carry) if carry else [F.lit(0).alias("_")])).alias("rest"))
    keys = d.select("doc", F.xxhash64("text").alias("_k"))
    several = keys.groupBy("doc").agg(F.min("_k").alias("_a"), F.max("_k").alias("_b")).where("_a <> _b").select("doc")
    if several.isEmpty():
        return d.select("doc", F.lit(0).alias("part"), "text", "rest")
    parts = keys.join(several, "doc").groupBy("doc").agg(F.array_sort(F.collect_set("_k")).alias("_ks"))
    place = F.coalesce(F.array_position("_ks", F.xxhash64("text")) - 1, F.lit(0)).cast("int")
    return d.join(parts, "doc", "left").select("doc", place.alias("part"), "text", "rest")


def _records(kind, k, c, doc, at, n) -> pa.RecordBatch:
    full = np.full(len(doc), kind, np.int8) if np.isscalar(kind) else kind
    arrays = [full, k.view(np.int64), c.view(np.int64), doc, at, n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[x.split()[0] for x in _STRETCH.split(", ")])


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks with adjoining ranges of windows made one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order].astype(np.int64)
    if not len(doc):
        return doc, at, n
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + n[:-1])])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(at + n, first)
    return doc[first], at[first], end - at[first]


class Met:
    """Stretches that a task has met in one slice after the other, in a table of fixed size.

    A stretch that stands later than an equal one met before is no news: it repeats, and
    the one before tells other tasks so. Those met in the last slice keep their cells, so
    what stands in every slice leaves a task once, not once a slice: one passage in a third of
    all documents brings about as many rows to its key's task as there are tasks.
    """

    CELLS = 1 << 16

    def __init__(self):
        self.k, self.c = np.zeros(self.CELLS, np.uint64), np.zeros(self.CELLS, np.uint64)
        self.doc, self.at = np.zeros(self.CELLS, np.int64), np.zeros(self.CELLS, np.int64)
        self.used, self.hot = np.zeros(self.CELLS, bool), np.zeros(self.CELLS, bool)

    def later(self, k, c, doc, at) -> np.ndarray:
        """Which of a slice's stretches, no two of them equal, stand later than an equal one met before; meets the others."""
        cell = ((k ^ (c >> np.uint64(7))) & np.uint64(self.CELLS - 1)).astype(np.int64)
        known = self.used[cell] & (self.k[cell] == k) & (self.c[cell] == c)
        late = known & ((doc > self.doc[cell]) | ((doc == self.doc[cell]) & (at >= self.at[cell])))
        again = late & ((doc != self.doc[cell]) | (at != self.at[cell]))
        put = np.flatnonzero(~late & (known | ~self.hot[cell]))
        x = cell[put]
        self.k[x], self.c[x], self.doc[x], self.at[x], self.used[x] = k[put], c[put], doc[put], at[put], True
        self.hot[:] = False
        self.hot[cell[known]] = True
        return again


def unlike(k, c, doc, at, n, met: Met) -> Iterator[pa.RecordBatch]:
    """Of equal stretches in a slice the first, unless an earlier one was met before; the others as marks (kind 1), spread by document."""
    order = np.lexsort((at, doc, c, k))
    k, c, doc, at, n = k[order], c[order], doc[order], at[order], n[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    again = same & ((doc != doc[first]) | (at != at[first]))
    one = np.flatnonzero(~same)
    again[one] = met.later(k[one], c[one], doc[one], at[one])
    one = one[~again[one]]
    yield _records(0, k[one], c[one], doc[one], at[one], n[one])
    if again.any():
        d, a, m = _joined(doc[again], at[again], n[again])
        h = mix(d.view(np.uint64))
        yield _records(1, h, h, d, a, m)


def settled(batches, go_on: bool) -> Iterator[pa.RecordBatch]:
    """Reads stretches sorted by (k, c, doc, at); emits marks (kind 1) and, if `go_on`, stretches to compare window by window (kind 2)."""
    held = None  # the first stretch of the last run of equal ones, and whether its anchor had another run before
    for b in batches:
        kind, k, c, doc, at, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        through = kind == 1
        if through.any():
            yield _records(1, k[through], c[through], doc[through], at[through], n[through])
            k, c, doc, at, n = (x[~through] for x in (k, c, doc, at, n))
        if not len(k):
            continue
        if held is not None:
            k, c, doc, at, n = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held[:5], (k, c, doc, at, n)))
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        again = ~new & ((doc != doc[first]) | (at != at[first]))
        if again.any():
            d, a, m = _joined(doc[again], at[again], n[again])
            yield _records(1, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, a, m)
        r = np.flatnonzero(new)
        before = np.zeros(len(r), bool)
        before[1:] = k[r[1:]] == k[r[:-1]]
        if held is not None:
            before[0] = held[5]
        if go_on and len(r) > 1:
            done = r[:-1][before[:-1] | (k[r[1:]] == k[r[:-1]])]
            if len(done):
                yield _records(2, k[done], c[done], doc[done], at[done], n[done])
        e = r[-1]
        held = (k[e], c[e], doc[e], at[e], n[e], bool(before[-1]))
    if go_on and held is not None and held[5]:
        yield _records(2, *(np.array([h], t) for h, t in zip(held[:5], (np.int64, np.int64, np.int64, np.int64, np.int32))))


def _in_slices(batch, make: Callable):
    doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    raw, offsets = text_buffers(batch.column(2))
    for i, j in slices(offsets):
        base = part[i:j].astype(np.int64) << PART
        yield from make(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], doc[i:j], base, i, j)


def stretches(docs: DataFrame, scheme: Callable) -> DataFrame:
    """scheme(raw, offsets) -> k, c, document, first window, windows of each stretch of a slice."""

    def run(batches):
        met = Met()

        def make(raw, offsets, doc, base, i, j):
            k, c, d, at, n = scheme(raw, offsets)
            yield from unlike(k, c, doc[d], at + base[d], n, met)

        for b in batches:
            yield from _in_slices(b, make)

    return docs.select("doc", "part", "text").mapInArrow(lean(run), _STRETCH)


def settle(rows: DataFrame, go_on: bool) -> DataFrame:
    dealt = rows.repartition("k").sortWithinPartitions("k", "c", "doc", "at")
    return dealt.mapInArrow(lean(lambda batches: settled(batches, go_on)), _STRETCH)


def by_document(rows: DataFrame, name: str) -> DataFrame:
    """(doc, part, name): each document's ranges of windows, of the part that they lie in."""
    part = F.shiftright("at", PART).cast("int")
    place = F.col("at") - F.shiftleft(part.cast("long"), PART)
    return rows.select("doc", part.alias("part"), place.alias("a"), "n").groupBy("doc", "part").agg(F.collect_list(F.struct("a", "n")).alias(name))


def ranges(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and number of windows of the ranges of rows i to j - 1 of a list<struct<a, n>> column."""
    part = column.slice(i, j - i)
    count = np.array(pa.compute.fill_null(pa.compute.list_value_length(part), 0))
    flat = part.flatten()
    return np.repeat(np.arange(j - i), count), flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def covered(first: np.ndarray, d: np.ndarray, a: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Which of a slice's units lie in windows a .. a + n - 1 of documents d; first: each document's first unit, and the end."""
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, first[d] + a, 1)
    np.add.at(edge, np.minimum(first[d] + a + n - 1 + size, first[d + 1]), -1)
    return np.cumsum(edge[:-1]) > 0


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Global first unit and document of every window of a slice."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    return runs(first[:-1], n), np.repeat(np.arange(len(n)), n)


def with_ranges(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined to (doc, part, ranges). The join's own exchange of the documents is the same in every such join of a query, so it runs once."""
    return docs.join(found.withColumnsRenamed({"doc": "_d", "part": "_p"}), (F.col("doc") == F.col("_d")) & (F.col("part") == F.col("_p")), how).drop("_d", "_p")
