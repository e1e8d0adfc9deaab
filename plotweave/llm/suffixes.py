"""Substring de-duplication over bytes by an enhanced suffix array and its tree of common-prefix intervals.

Only suffixes that begin in text which may repeat enter the array: every window of
`size` bytes has an anchor (the least hash among its `GRAM`-byte strings), stretches
of windows that share an anchor are settled as in repeats.py, and what differs
around a shared anchor is compared as suffixes. Spark sorts those (dealt by a longer
anchor within their first `size` bytes, so that an interval of a common prefix that
long lies in one partition) and the sorted stream is scanned once with a stack: the array's common
prefix lengths open and close intervals, each of which is a repeat with all its
occurrences; it is maximal if the bytes before the occurrences differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from ._columns import SLICE_BYTES, mix, runs, slices, text_buffers
from ._store import cut, release
from ._worker import lean

GRAM = 32
#: Bytes of a suffix that are sorted beyond the window's size.
BEYOND = 28
#: Most bytes by which groups that are still equal are compared further at a time.
FURTHER = 1 << 14
_BYTE_1 = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_BYTE_2 = mix(np.arange(256, dtype=np.uint64) + np.uint64(5000))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the place of the first of the least (by the upper bits)."""
    bits = np.uint64(max(int(len(h)).bit_length(), 1))
    m = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if width > have:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def scheme(size: int):
    """Stretches of windows of `size` bytes."""
    gram = min(GRAM, max(1, size // 2))

    def make(raw, offsets):
        return _anchored(raw, offsets, *repeats.window_starts(offsets, size), size, gram)

    return make


def _anchored(raw, offsets, at, doc, size: int, gram: int):
    """Stretches of the windows that begin at `at` (ascending), by anchors of `gram` bytes."""
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    h1, h2 = repeats.RangeHash(_BYTE_1[raw]), repeats.RangeHash(_BYTE_2[raw])
    g = np.arange(len(raw) - gram + 1)
    hashes = h1(g, g + gram)
    anchor = _least(hashes, size - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(at)))
    first = at[s]
    return hashes[anchor[s]], h2(first, first + count - 1 + size), doc[s], first - offsets[doc[s]], count


def _long_gram(size: int) -> int:
    """Anchors nearly as long as a window are shared by little but real repeats."""
    return max(1, size - max(size // 6, 1))


def _refined(size: int):
    """The stretches that go on, cut finer, by long anchors."""
    gram = _long_gram(size)

    def run(batches):
        met = repeats.Met()
        for b in batches:
            ids, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, offsets = text_buffers(b.column(2))
            for i, j in slices(offsets):
                text, at0 = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                d, a, n = repeats.ranges(b.column(3), i, j)
                s = np.sort(repeats.runs(a + at0[d], n))
                k, c, d, at, n = _anchored(text, at0, s, np.searchsorted(at0, s, "right") - 1, size, gram)
                yield from repeats.unlike(k, c, ids[i:j][d], at + (part[i:j][d].astype(np.int64) << repeats.PART), n, met)

    return run


_SUFFIX = "k long, text binary, left int, doc long, at long"
_FURTHER = _SUFFIX + ", c long"


def _suffixes(size: int, every: bool = False):
    """Suffixes of the stretches that go on: unless `every`, a slice's equal ones once, the others marked (k null)."""

    def run(batches):
        for b in batches:
            doc, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, offsets = text_buffers(b.column(2))
            for i, j in slices(offsets, SLICE_BYTES // 4):
                text, at0 = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                d, a, n = repeats.ranges(b.column(3), i, j)
                at = repeats.runs(a, n)
                d = np.repeat(d, n)
                if not len(at):
                    continue
                s = at + at0[d]
                order = np.argsort(s, kind="stable")
                d, at, s = d[order], at[order], s[order]
                h1, h2 = repeats.RangeHash(_BYTE_1[text]), repeats.RangeHash(_BYTE_2[text])
                k, c = h1(s, s + size), h2(s, s + size)
                found = _anchored(text, at0, s, d, size, _long_gram(size))
                anchor = np.repeat(found[0], found[4])
                left = np.where(at > 0, text[np.maximum(s - 1, 0)].astype(np.int32), -1)
                ids, place = doc[i:j][d], at + (part[i:j][d].astype(np.int64) << repeats.PART)
                if not every:
                    order = np.lexsort((place, ids, c, k))
                    same = np.zeros(len(order), bool)
                    o, p = order[1:], order[:-1]
                    same[1:] = (k[o] == k[p]) & (c[o] == c[p])
                    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                    again = same & ((ids[order] != ids[first]) | (place[order] != place[first]))
                    gone = order[again]
                    if len(gone):
                        g_doc, g_at, g_n = repeats._joined(ids[gone], place[gone], np.ones(len(gone), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(g_doc), pa.int64()), pa.nulls(len(g_doc), pa.binary()), pa.array(g_n.astype(np.int32)), pa.array(g_doc), pa.array(g_at)], names=["k", "text", "left", "doc", "at"])
                    pick = np.sort(order[~same])
                    anchor, s, d, left, ids, place = (x[pick] for x in (anchor, s, d, left, ids, place))
                length = np.minimum(size + BEYOND, at0[d + 1] - s)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text[runs(s, length)]))])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), bytes_, pa.array(left), pa.array(ids), pa.array(place)], names=["k", "text", "left", "doc", "at"])

    return run


def common_prefixes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix with the one before it."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.int64)
    most = np.minimum(n[1:], n[:-1])
    on, k = np.arange(1, len(n)), 0
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.ndarray((len(raw) + 1,), ">u8", padded.data, strides=(1,))
    while len(on):
        x = word[offsets[on] + k].astype(np.uint64) ^ word[offsets[on - 1] + k].astype(np.uint64)
        zero = x == 0
        lead = np.zeros(len(on), np.int64)
        if (~zero).any():
            v = x[~zero]
            bits = np.zeros(len(v), np.int64)
            for shift in (32, 16, 8):
                high = v >> np.uint64(shift)
                move = high > 0
                bits += np.where(move, shift, 0)
                v = np.where(move, high, v)
            lead[~zero] = 7 - bits // 8
        lead[zero] = 8
        out[on] = np.minimum(k + lead, most[on - 1])
        on = on[zero & (k + 8 < most[on - 1])]
        k += 8
    return out


class IntervalScan:
    """The stack scan over suffixes as they come sorted; intervals are repeats of at least `size` bytes.

    An open interval keeps its prefix length, its earliest occurrence, whether
    the bytes before its occurrences differ and, if `groups`, its occurrences. Only
    the intervals that enclose the latest suffix are open, at most one for each
    length, so memory doesn't grow with the number of occurrences unless groups are asked for.
    """

    def __init__(self, size: int, groups: bool):
        self.size, self.groups = size, groups
        self.stack: list[list] = []
        self.last = None  # the latest suffix: bytes, left, (doc, at)
        self.found: list[tuple[int, list]] = []
        self.marks: list[tuple[int, int]] = []

    def _close(self, down_to: int):
        """Closes intervals longer than `down_to`; gives what was in the last of them."""
        inner = None
        while self.stack and self.stack[-1][0] > down_to:
            length, first, left, differs, places = self.stack.pop()
            if self.groups and differs:
                self.found.append((length, sorted(set(places))))
            inner = [length, first, left, differs, places]
            if self.stack and self.stack[-1][0] >= down_to:
                self._into(self.stack[-1], inner)
                inner = None
        return inner

    @staticmethod
    def _into(outer: list, inner: list) -> None:
        outer[1] = min(outer[1], inner[1])
        outer[3] = outer[3] or inner[3] or outer[2] != inner[2]
        if outer[4] is not inner[4]:
            outer[4] += inner[4]

    def step(self, prefix: int, left: int, place: tuple[int, int]) -> None:
        """The next suffix, of `prefix` bytes in common with the latest one."""
        if prefix < self.size:
            self._close(0)
        else:
            one = [prefix, place, left, left < 0, [place] if self.groups else []]
            if not self.stack or self.stack[-1][0] < prefix:
                self.stack.append([prefix, self.last[1], self.last[0], self.last[0] < 0, [self.last[1]] if self.groups else []])
            elif self.stack[-1][0] > prefix:
                inner = self._close(prefix)
                if inner is not None:
                    self.stack.append([prefix, *inner[1:4], list(inner[4])])
            root = self.stack[0]
            earliest = min(x[1] for x in self.stack)
            if place != earliest:
                late = max(place, earliest)
                self.marks.append(late)
                if place < earliest:
                    root[1] = place
            self._into(self.stack[-1], one)
        self.last = (left, place)


def _scan(size: int, groups: bool, end: int = 0, further: bool = False):
    """Reads sorted suffixes. `end` is the length that they are cut to; if `further`, they begin `size` bytes on and k and c tell the groups."""

    def run(batches):
        scan, tail, last = IntervalScan(size, groups), b"", None
        for b in batches:
            loose = b.column(0).is_null().to_numpy(zero_copy_only=False)
            marks = []
            if loose.any():
                t = b.filter(pa.array(loose))
                marks.append((t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(2).to_numpy()))
                b = b.filter(pa.array(~loose))
            if b.num_rows:
                raw, offsets = text_buffers(b.column(1))
                joined = np.concatenate([np.frombuffer(tail, np.uint8), raw])
                prefix = common_prefixes(joined, np.concatenate([[0], offsets + len(tail)]))[1:]
                tail = raw[offsets[-2] : offsets[-1]].tobytes()
                if further:
                    k, c = b.column(0).to_numpy(), b.column(5).to_numpy()
                    same = np.concatenate([[last == (k[0], c[0])], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
                    prefix, last = np.where(same, prefix + size, 0), (k[-1], c[-1])
                left, doc, at = (b.column(i).to_pylist() for i in (2, 3, 4))
                deep = prefix >= size
                near = deep.copy()
                near[:-1] |= deep[1:]
                near[-1] = True
                for i in np.flatnonzero(near).tolist():
                    scan.step(int(prefix[i]), left[i], (doc[i], at[i]))
            if scan.marks:
                d, a = (np.array(x, np.int64) for x in zip(*scan.marks))
                marks.append((d, a, np.ones(len(d), np.int32)))
                scan.marks = []
            for d, a, n in marks:
                yield repeats._records(1, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), np.asarray(d, np.int64), np.asarray(a, np.int64), np.asarray(n))
            yield from _groups(scan)
        scan._close(0)
        yield from _groups(scan)

    def _groups(scan):
        """One row for each occurrence of a repeat; k and c are the first's document and place, n the length. Kind 3: maximal; 4: as long as the suffixes are cut, so it may go on."""
        for length, places in scan.found:
            d, a = (np.array(x, np.int64) for x in zip(*places))
            yield repeats._records(4 if length == end else 3, np.full(len(d), d[0]), np.full(len(d), a[0]), d, a, np.full(len(d), length))
        scan.found = []

    return run


def _sorted_suffixes(suffixes: DataFrame) -> DataFrame:
    # equal windows have equal anchors; neighbours too, mostly, and so travel side by side and compress well
    spread = F.when(F.col("k").isNull(), F.xxhash64("doc", "at")).otherwise(F.col("k"))
    return suffixes.repartition(spread).sortWithinPartitions("text", "doc", "at")


def _prepare_suffixes(d: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    met = cut(repeats.settle(repeats.stretches(d, scheme(size)), True))
    release(d.sparkSession)
    rough = repeats.with_ranges(d, repeats.by_document(met.where("kind = 2"), "ranges"), "inner")
    fine = repeats.settle(rough.select(*repeats.JOINED).mapInArrow(lean(_refined(size)), repeats._STRETCH), True)
    again = repeats.with_ranges(d, repeats.by_document(fine.where("kind = 2"), "ranges"), "inner")
    return met.where("kind = 1").unionByName(fine.where("kind = 1")), again.select(*repeats.JOINED).mapInArrow(lean(_suffixes(size)), _SUFFIX)


def repeated_windows(d: DataFrame, size: int) -> DataFrame:
    """(doc, part, ranges): windows that also start earlier, from (doc, part, text)."""
    met, suffixes = _prepare_suffixes(d, size)
    marks = _sorted_suffixes(suffixes).mapInArrow(lean(_scan(size, False)), repeats._STRETCH)
    return repeats.by_document(met.unionByName(marks.where("kind = 1")), "ranges")


def _suffixes_further(done: int, more: int):
    """The next `more` bytes of suffixes of (doc, part, text, places) that are equal for `done` bytes."""

    def run(batches):
        for b in batches:
            doc, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, offsets = text_buffers(b.column(2))
            flat = b.column(3).flatten()
            row = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            at, k, c = (flat.field(n).to_numpy() for n in ("a", "k", "c"))
            most = max(1, SLICE_BYTES // more)
            for i in range(0, len(row), most):
                d, a = row[i : i + most], at[i : i + most]
                s = offsets[d] + a
                length = np.minimum(offsets[d + 1] - s - done, more)
                left = np.where(a > 0, raw[np.maximum(s - 1, 0)].astype(np.int32), -1)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[runs(s + done, length)]))])
                place = a + (part[d].astype(np.int64) << repeats.PART)
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + most]), bytes_, pa.array(left), pa.array(doc[d]), pa.array(place), pa.array(c[i : i + most])], names=["k", "text", "left", "doc", "at", "c"])

    return run


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """(first_doc, first_at, length, doc_id, at): every occurrence of every maximal repeat of at least `size` bytes.

    A repeat is maximal if the bytes before its occurrences differ (a text's start
    differs from all) and so do those after. All windows enter the suffix array
    here, cut to `size` + BEYOND bytes. Repeats that reach the cut are compared
    further in rounds, each over the next bytes (as many as before, FURTHER at most) of the
    groups that are still equal, until none is. Groups whose occurrences follow one and the
    same byte hold nothing maximal and are left, so of two copies one suffix each goes on;
    within a long run of one byte or pattern all do. Rounds number about the longest repeat's
    length over FURTHER.
    """
    d = repeats.prepared(docs, id_col, text_col).dropDuplicates(["doc", "part"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.octet_length("text") - size + 1).alias("n")))
    every = d.where(F.octet_length("text") >= size).select("doc", "part", "text", whole.alias("ranges")).mapInArrow(lean(_suffixes(size, True)), _SUFFIX)
    done = size + BEYOND
    rows = cut(_sorted_suffixes(every).mapInArrow(lean(_scan(size, True, done)), repeats._STRETCH))
    found = rows.where("kind = 3")
    part = F.shiftright("at", repeats.PART).cast("int")
    place = F.col("at").bitwiseAND(F.lit((1 << repeats.PART) - 1))
    while not (equal := rows.where("kind = 4")).isEmpty():
        more = min(done, FURTHER)
        places = equal.select("doc", part.alias("part"), F.struct(place.alias("a"), "k", "c").alias("_s")).groupBy("doc", "part").agg(F.collect_list("_s").alias("places"))
        on = repeats.with_ranges(d, places, "inner").select("doc", "part", "text", "places").mapInArrow(lean(_suffixes_further(done, more)), _FURTHER)
        on = on.repartition("k", "c").sortWithinPartitions("k", "c", "text", "doc", "at")
        rows = cut(on.mapInArrow(lean(_scan(done, True, done + more, True)), repeats._STRETCH))
        found, done = found.unionByName(rows.where("kind = 3")), done + more
    return found.select(F.col("k").alias("first_doc"), F.col("c").bitwiseAND(F.lit((1 << repeats.PART) - 1)).alias("first_at"), F.col("n").alias("length"), F.col("doc").alias("doc_id"), place.alias("at"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row.

    Removes each byte that a string of `size` bytes covers which also starts
    earlier: in a document with a smaller id, or before in the same one. Strings are
    judged on the input. A null text is empty; a null id comes before all others;
    rows that share an id are parts of one document (repeats.prepared); an
    empty table gives no row. Other columns are not read.
    """
    d = repeats.prepared(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            for i, j in slices(offsets):
                text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                gone = repeats.covered(at, *repeats.ranges(b.column("ranges"), i, j), size)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edge = at[:-1][np.diff(at) > 0]
                opens[edge] = gone[edge]
                sums = np.concatenate([[0], np.cumsum(gone)])[at]
                n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[at])
                whole = text[~gone].tobytes()
                cuts = at - sums
                parts = [whole[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                sha = [hashlib.sha256(p).hexdigest() for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(sums)), pa.array(n_spans), pa.array(sha, pa.string()), pa.array(parts, pa.binary())],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    out = repeats.with_ranges(d, repeated_windows(d, size), "left").mapInArrow(lean(run), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("doc", F.lit(repeats.NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
