"""Substring de-duplication over words by recompression.

Rounds of recompression name pairs and runs of symbols: each symbol has a bit that
follows from its name and the round, a 0 followed by a 1 is a pair, and equal
neighbours that are in no pair form a run. A new name is a hash of what it is
made of, so every executor gives equal pairs and runs the same name with no
exchange. Beside each symbol stands the span of words that it follows from: equal
spans hold equal symbols wherever they stand. A window's anchor is the least of the
symbols that follow from it alone; a shared one reveals a repeat, and hashes of
all words (128 bits) confirm it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from ._columns import SLICE_BYTES, mix, slices, text_buffers, words
from ._store import cut, release
from ._worker import lean

ROUNDS = 3


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (name, start, end, from, to) after some rounds over the words of documents.

    first: each document's first word, and the end. [from, to) is the span that
    the symbol follows from; at a document's ends it reaches beyond the document.
    """
    n = len(names)
    start = np.arange(n)
    end = start + 1
    low, high = start.copy(), end.copy()
    opens = np.zeros(n, bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    for t in range(rounds):
        n = len(names)
        if not n:
            break
        closes = np.append(opens[1:], True)
        bit = (mix(names + np.uint64(0x51ED2701 * (t + 1))) & np.uint64(1)).astype(bool)
        heads = np.zeros(n, bool)
        heads[:-1] = ~bit[:-1] & bit[1:] & ~closes[:-1]
        tails = np.zeros(n, bool)
        tails[1:] = heads[:-1]
        single = ~heads & ~tails
        joins = np.zeros(n, bool)  # continues a run
        joins[1:] = single[1:] & single[:-1] & (names[1:] == names[:-1]) & ~opens[1:]
        begin = np.flatnonzero(~tails & ~joins)
        stop = np.append(begin[1:], n)
        length = stop - begin
        pair = heads[begin]
        new = names[begin].copy()
        new[pair] = mix(mix(names[begin[pair]]) + names[begin[pair] + 1] * np.uint64(3))
        run = ~pair & (length > 1)
        new[run] = mix(mix(names[begin[run]] ^ np.uint64(0xA5A5A5A5)) + length[run].astype(np.uint64))
        # a neighbour of the same name that is in a pair, and so not in the run, tells of its partner too
        before, after = np.concatenate([[0], low[:-1]]), np.append(high[1:], 0)
        equal = np.zeros(n + 1, bool)
        equal[1:-1] = (names[1:] == names[:-1]) & ~opens[1:]
        far_before = np.concatenate([[0, 0], low[:-2]])[:n]
        far_after = np.append(high[2:], [0, 0])[:n]
        left = np.where(opens, start - 1, np.where(equal[:-1] & tails[np.maximum(np.arange(n) - 1, 0)], far_before, before))
        right = np.where(closes, end + 1, np.where(equal[1:] & heads[np.minimum(np.arange(n) + 1, n - 1)], far_after, after))
        low = np.where(pair, low[begin], left[begin])
        high = np.where(pair, high[stop - 1], right[stop - 1])
        start, end, opens, names = start[begin], end[stop - 1], opens[begin], new
    return names, start, end, low, high


def scheme(size: int):
    """Stretches of windows of `size` words."""

    def make(raw, offsets):
        w = words(raw, offsets)
        one, two = w.hashes(1), w.hashes(2)
        at, doc = repeats.window_starts(w.first, size)
        empty = np.zeros(0, np.int64)
        if not len(at):
            return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
        h1, h2 = repeats.RangeHash(one), repeats.RangeHash(two)
        names, start, end, low, high = recompress(one, w.first)
        use = np.flatnonzero((high - low <= size) & (low >= 0) & (high <= len(one)))
        low, high = low[use], high[use]
        key = mix(names[use] ^ h1(low, high) ^ (start[use] - low).astype(np.uint64))
        n = len(one)
        lo = np.cumsum(np.bincount(low, minlength=n + 2))
        lo = np.concatenate([[0], lo])[at]  # symbols whose span begins before the window
        hi = np.cumsum(np.bincount(high, minlength=n + 2))[at + size]  # symbols whose span ends within it
        many = hi - lo
        best = np.minimum(lo, len(key) - 1) if len(key) else np.zeros(len(at), np.int64)
        rest, k = np.flatnonzero(many > 1), 1
        while len(rest):
            other = lo[rest] + k
            less = key[other] < key[best[rest]]
            best[rest[less]] = other[less]
            k += 1
            rest = rest[many[rest] > k]
        loose = many <= 0
        new = np.ones(len(at), bool)
        new[1:] = loose[1:] | loose[:-1] | (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        s = np.flatnonzero(new)
        count = np.diff(np.append(s, len(at)))
        first_word = at[s]
        c = h2(first_word, first_word + count - 1 + size)
        k = np.where(loose[s], h1(first_word, first_word + size), key[best[s]] if len(key) else 0)
        return k, c, doc[s], first_word - w.first[doc[s]], count

    return make


def _compare(size: int):
    """Single windows of the stretches that go on, as stretches of one window."""

    def run(batches):
        met = repeats.Met()
        for b in batches:
            doc, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, offsets = text_buffers(b.column(2))
            for i, j in slices(offsets, SLICE_BYTES // 2):
                w = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                d, a, n = repeats.ranges(b.column(3), i, j)
                at = repeats.runs(a, n)
                d = np.repeat(d, n)
                s = at + w.first[d]
                h1, h2 = repeats.RangeHash(w.hashes(1)), repeats.RangeHash(w.hashes(2))
                yield from repeats.unlike(h1(s, s + size), h2(s, s + size), doc[i:j][d], at + (part[i:j][d].astype(np.int64) << repeats.PART), np.ones(len(at), np.int32), met)

    return run


def repeated_windows(d: DataFrame, size: int) -> DataFrame:
    """(doc, part, ranges): windows that also start earlier, from (doc, part, text)."""
    met = cut(repeats.settle(repeats.stretches(d, scheme(size)), True))
    release(d.sparkSession)
    again = repeats.with_ranges(d, repeats.by_document(met.where("kind = 2"), "ranges"), "inner").select(*repeats.JOINED).mapInArrow(lean(_compare(size)), repeats._STRETCH)
    marks = met.where("kind = 1").unionByName(repeats.settle(again, False).where("kind = 1"))
    return repeats.by_document(marks, "ranges")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row; with `carry` also `row`, a struct of those columns as they are.

    kept_sha256 is of the kept words joined by spaces; kept_text is that too (so its
    line breaks are gone), or the text itself where nothing was removed. Carried
    columns may have any names, as they stay inside their struct.

    Removes each word that a window of `size` words covers which also starts
    earlier: in a document with a smaller id, or before in the same one. Windows
    are judged on the input. Null and empty texts have no words; a null id comes
    before all others; rows that share an id are parts of one document
    (repeats.prepared); an empty table gives no row. Other columns are not read.
    """
    d = repeats.prepared(docs, id_col, text_col, carry)

    def run(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            for i, j in slices(offsets):
                w = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                gone = repeats.covered(w.first, *repeats.ranges(b.column("ranges"), i, j), size)
                stay = np.flatnonzero(~gone)
                length = (w.end - w.start)[stay] + 1
                text = w.raw[np.minimum(repeats.runs(w.start[stay], length), max(len(w.raw) - 1, 0))]
                ends = np.cumsum(length)
                text[ends - 1] = 0x20
                at = np.concatenate([[0], ends])[np.searchsorted(stay, w.first)]
                whole = text.tobytes()
                parts = [whole[x : max(y - 1, x)] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                n_words = np.diff(w.first)
                n_removed = n_words - np.diff(np.searchsorted(stay, w.first))
                sha = [hashlib.sha256(p).hexdigest() for p in parts]
                source = raw[offsets[i] : offsets[j]].tobytes()
                base = (offsets[i : j + 1] - offsets[i]).tolist()
                kept = [p if n else source[x:y] for p, n, x, y in zip(parts, n_removed.tolist(), base[:-1], base[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), b.column("rest").slice(i, j - i)],
                    names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text", "rest"],
                )

    out = repeats.with_ranges(d, repeated_windows(d, size), "left")
    schema = f"doc long, n_words long, n_removed long, kept_sha256 string, kept_text string, rest {d.schema['rest'].dataType.simpleString()}"
    done = out.mapInArrow(lean(run), schema)
    row = [F.col("rest").alias("row")] if carry else []
    return done.select(F.nullif("doc", F.lit(repeats.NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", *row)
