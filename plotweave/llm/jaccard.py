"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes its set of word n-grams; equal sets are one node. A node
publishes the rarest tokens of its set. For sets x, y with Jaccard >= t, the first
|x| - ceil(t|x|) + m tokens of x and those of y share at least m tokens, for every
m: each node picks its own m by the estimated cost of its candidates, and a pair
must share as many prefix tokens as the smaller of its two m before it is verified.

A list of nodes that share a token is never paired off whole. First each node
meets only the list's most central one (its hub); verified links make components.
Then only pairs of different components are left to compare, in bounded blocks.
So groups of near copies cost about as much as they have members, and no link
that changes a component is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._columns import LOWER, NON_SPACE, mix, runs, slices, text_buffers, words
from ._store import cut, discard
from ._worker import lean

#: Frequencies are tracked for n-grams in at least this share of documents and for words of at least this share.
FREQUENT, COMMON = 1e-3, 2.0**-17
#: Most prefix tokens beyond the first that a pair may be asked to share.
MOST_MATCHES = 6
#: Nodes of a list that are compared at once.
BLOCK = 512
#: Rows of lists that one task compares one after another, so that a pair of nodes that share many tokens is named about once.
TOGETHER = 1 << 13
#: Pairs at which a task adds up those it holds.
HELD_PAIRS = 1 << 18
BROADCAST_ROWS = 100_000
#: Fewest and most bits of a set's parities. A posting carries them, so they don't grow with the longest texts; there they only rule out less.
PARITY_BITS = (256, 8192)
#: Words that are counted at a time.
COUNTED_WORDS = 1_000_000
#: Cells that n-grams are counted in before it is known which may be frequent, and cells that travel as one row.
CELLS, PIECE = 1 << 20, 1 << 14
_HASH_BITS = 54
_LOW = np.uint64((1 << _HASH_BITS) - 1)


def _grams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Hashes of a slice's words, and document, first word, length and hash of each of its n-grams."""
    w = words(LOWER[raw], offsets, NON_SPACE)
    h = w.hashes(4)
    count = np.diff(w.first)
    grams = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    start = runs(w.first[:-1], grams)
    doc = np.repeat(np.arange(len(count)), grams)
    size = np.minimum(count, n)[doc]
    v = size.astype(np.uint64)
    for k in range(n):
        inside = size > k
        v = np.where(inside, mix(v * np.uint64(0x9E3779B97F4A7C15) + h[np.where(inside, start + k, 0)]), v) if len(h) else v
    return h, doc, start, size, v & _LOW


class Shingles:
    """Sets of hashed n-grams of a slice of documents, sorted by document and hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, n: int):
        self.words, doc, start, size, v = _grams(raw, offsets, n)
        key = (doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | v
        order = np.argsort(key, kind="stable")
        key = key[order]
        one = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        self.key, self.at, self.size_of = key[one], start[order][one], size[order][one]
        self.token = self.key & _LOW
        self.doc = (self.key >> np.uint64(_HASH_BITS)).astype(np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.n = n

    def sums(self, of: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of, dtype=np.uint64)])
        return c[self.first[1:]] - c[self.first[:-1]]

    def nodes(self) -> np.ndarray:
        """A hash of each whole set; 0 for an empty one."""
        n = np.diff(self.first)
        h = mix(self.sums(mix(self.token)) ^ mix(self.sums(mix(self.token ^ np.uint64(0x5555))) + n.astype(np.uint64)))
        return np.where(n > 0, h | np.uint64(1), np.uint64(0))

    def parities(self, percent: int) -> list[bytes]:
        """Some bits for each set, one flipped by each token: sets that differ in d tokens differ in at most d bits.

        Four bits for each token by which a set may differ from one of its size, as a power of two within PARITY_BITS.
        """
        may = 8 * np.diff(self.first) * (100 - percent) // (100 + percent)
        bits = 1 << np.ceil(np.log2(np.clip(may, *PARITY_BITS))).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(bits)])
        cell = at[self.doc] + (mix(self.token + np.uint64(9)).astype(np.int64) & (bits[self.doc] - 1))
        packed = np.packbits((np.bincount(cell, minlength=at[-1]) & 1).astype(bool)).tobytes()
        return [packed[x:y] for x, y in zip((at[:-1] >> 3).tolist(), (at[1:] >> 3).tolist())]


def _folded(parities: list[bytes]) -> np.ndarray:
    """Parities of one width, that of the shortest: halves of longer ones are laid on each other, which is what fewer bits would have given."""
    width = np.array([len(p) for p in parities])
    out = np.zeros((len(parities), int(width.min()) // 8), np.uint64)
    for w in np.unique(width).tolist():
        on = np.flatnonzero(width == w)
        bits = np.frombuffer(b"".join(parities[i] for i in on), np.uint64).reshape(len(on), -1)
        while bits.shape[1] > out.shape[1]:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        out[on] = bits
    return out


def _sliced(batch, n: int, make=Shingles):
    raw, offsets = text_buffers(batch.column(1))
    for i, j in slices(offsets):
        for a in range(i, j, 1000):  # documents are numbered in the upper bits
            b = min(a + 1000, j)
            yield a, b, make(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return values.view(np.int64), n


def _cells(docs: DataFrame, n: int) -> tuple[np.ndarray, DataFrame, int, int]:
    """How many n-grams fall into each of CELLS cells, the words' counts, and how many documents and words there are.

    The driver gets CELLS numbers, whatever the input.
    """
    names = ["kind", "key", "n", "cells"]

    def rows(kind: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(count), pa.nulls(len(key), pa.binary())], names=names)

    def run(batches):
        cells, parts, held, n_docs, n_words = np.zeros(CELLS, np.int64), [], 0, 0, 0
        for b in batches:
            for i, j, (h, _, _, _, v) in _sliced(b, n, _grams):
                cells += np.bincount((v & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                parts.append(h)
                n_docs, n_words, held = n_docs + j - i, n_words + len(h), held + len(h)
                if held >= COUNTED_WORDS:
                    yield rows(1, *_tally(parts))
                    parts, held = [], 0
        yield rows(1, *_tally(parts))
        yield rows(2, np.zeros(1, np.int64), np.array([n_docs]))
        yield rows(3, np.zeros(1, np.int64), np.array([n_words]))
        pieces = [x.tobytes() for x in cells.reshape(-1, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), 4, np.int8)), pa.array(np.arange(len(pieces))), pa.array(np.zeros(len(pieces), np.int64)), pa.array(pieces, pa.binary())], names=names)

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, of in zip(b.column(0).to_pylist(), b.column(1)):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(of.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["key", "cells"])

    counts = cut(docs.mapInArrow(lean(run), "kind byte, key long, n long, cells binary"))
    total = {r["kind"]: r["n"] for r in counts.where("kind in (2, 3)").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    cells = np.zeros(CELLS, np.int64)
    for r in counts.where("kind = 4").select("key", "cells").repartition("key").mapInArrow(lean(added), "key long, cells binary").collect():
        cells.reshape(-1, PIECE)[r["key"]] += np.frombuffer(r["cells"], np.int64)
    by_word = counts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    return cells, by_word, total.get(2, 0), total.get(3, 0)


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes and frequencies of frequent n-grams and common words; both are exact counts over all documents.

    A first pass counts cells of n-grams; a cell holds at least as many as any n-gram in it is
    in documents, so frequent n-grams lie in full cells alone, and a second pass counts only what
    lies in those. The kept are at most the inverse of the two shares times the n-grams per document.
    """
    cells, by_word, n_docs, n_words = _cells(docs, n)
    least = max(2.0, FREQUENT * n_docs)
    full = np.packbits(cells >= least, bitorder="little")

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for _, _, (h, doc, _, _, v) in _sliced(b, n, _grams):
                cell = (v & np.uint64(CELLS - 1)).astype(np.int64)
                on = np.flatnonzero(full[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                parts.append(np.unique((doc[on].astype(np.uint64) << np.uint64(_HASH_BITS)) | v[on]) & _LOW)
                held += len(h)
                if held >= COUNTED_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tally(parts)], names=["key", "n"])
                    parts, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tally(parts)], names=["key", "n"])

    by_gram = docs.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    out = []
    for counts, from_ in ((by_gram, least), (by_word, max(1.0, COMMON * n_words))):
        t = counts.where(F.col("n") >= from_).toPandas()
        key, c = t["key"].to_numpy(np.int64).view(np.uint64), t["n"].to_numpy(np.int64)
        order = np.argsort(key)
        out += [key[order], c[order].astype(np.float64)]
    return (*out, max(n_words, 1))


def _look(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def _matches(df: np.ndarray, base: int, size: int) -> int:
    """How many prefix tokens a node asks to share: the m whose lists and verifications cost least.

    Reading the lists of a longer prefix costs their lengths; sets that share m
    of them number about that total over m, and verifying one costs its size.
    """
    most = min(MOST_MATCHES, size - base + 1)
    total = np.cumsum(df[: base - 1 + most])[base - 1 :]
    m = np.arange(1, len(total) + 1)
    return int(np.argmin(total * (1 + 0.1 * size / m) + m)) + 1


_ROW = "kind byte, key long, node long, aux long, doc long, n long, parity binary"


def _publish(docs: DataFrame, n: int, percent: int, tables) -> DataFrame:
    """Kind 0: postings (token, node, aux = place, size and asked matches); kind 1: documents (node, aux = hash of the text, doc, size, parities)."""
    grams, gram_df, common, word_n, n_words = tables

    def run(batches):
        names = [x.split()[0] for x in _ROW.split(", ")]
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        for b in batches:
            seen: set[int] = set()
            for i, j, s in _sliced(b, n):
                node, size = s.nodes(), np.diff(s.first)
                out = [[] for _ in range(3)]
                rare = np.log(_look(common, word_n, s.words, 0.5) / n_words).astype(np.float32)
                chance = np.zeros(len(s.token), np.float32)
                for k in range(n):
                    inside = s.size_of > k
                    chance += np.where(inside, rare[np.where(inside, s.at + k, 0)], 0) if len(rare) else 0
                df = _look(grams, gram_df, s.token, 0.0)
                order = np.lexsort((chance, df, s.doc))
                token, df = s.token[order], np.maximum(df[order], 0.05)
                for d in range(j - i):
                    a, z = s.first[d], s.first[d + 1]
                    if a == z or int(node[d]) in seen:
                        continue
                    seen.add(int(node[d]))
                    base = int(z - a) - (percent * int(z - a) + 99) // 100 + 1
                    m = _matches(df[a:z], base, int(z - a))
                    p = min(base - 1 + m, int(z - a))
                    out[0].append(token[a : a + p])
                    out[1].append(np.full(p, node[d]))
                    out[2].append((np.arange(p) << 40) | (int(z - a) << 8) | m)
                tok, nod, aux = join(out[0], np.uint64), join(out[1], np.uint64), join(out[2], np.int64)
                k = len(tok)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), pa.array(tok.view(np.int64)), pa.array(nod.view(np.int64)), pa.array(aux), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=names)
                spread = mix(node + np.arange(i, j, dtype=np.uint64)).view(np.int64)
                parity = s.parities(percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(j - i, np.int8)), pa.array(spread), pa.array(node.view(np.int64)), b.column(2).slice(i, j - i), b.column(0).slice(i, j - i), pa.array(size), pa.array(parity, pa.binary())], names=names)

    return docs.withColumn("row", F.xxhash64("text")).mapInArrow(lean(run), _ROW)


def _shared(rows: DataFrame) -> DataFrame:
    """Drops postings of tokens that one node alone publishes; each node's posting of a token stays once."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            key, node, kind = (t.column(c).to_numpy() for c in ("key", "node", "kind"))
            k = len(key)
            if not k:
                continue
            again = np.zeros(k, bool)
            again[1:] = (kind[1:] == 0) & (kind[:-1] == 0) & (key[1:] == key[:-1]) & (node[1:] == node[:-1])
            same = np.zeros(k + 1, bool)
            same[1:-1] = (kind[1:] == 0) & (kind[:-1] == 0) & (key[1:] == key[:-1])
            other = np.zeros(k + 1, bool)
            other[1:-1] = same[1:-1] & (node[1:] != node[:-1])
            # a list is shared if two neighbours in it differ; node order within the list makes that local to runs
            group = np.cumsum(~same[:-1]) - 1
            mixed = np.bincount(group, weights=other[:-1], minlength=group[-1] + 1) > 0
            keep = ~again & (mixed[group] | (kind == 1))
            last = group == group[-1]
            if kind[-1] == 0:
                # the last list may go on: hold one posting of it, or two that differ
                tail = np.flatnonzero(last & ~again)
                wait = tail if not mixed[-1] else tail[-2:]
                # with two held the list stays shared; those were not yet given out
                keep[wait] = False
                held_next = t.take(pa.array(wait)).combine_chunks().to_batches()[0]
            else:
                held_next = None
            out = t.filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()
            held = held_next
        if held is not None:
            nodes = held.column("node").to_numpy()
            if len(nodes) > 1:
                yield held

    return rows.repartition("key").sortWithinPartitions("kind", "key", "node").mapInArrow(lean(run), _ROW)


def _fits(a_aux, b_aux, percent: int) -> np.ndarray:
    """Whether two nodes can be similar, by their sizes and the places of a token that they share.

    Besides the tokens before the places they can share only what follows both.
    """
    place_a, size_a, place_b, size_b = a_aux >> 40, (a_aux >> 8) & 0xFFFFFFFF, b_aux >> 40, (b_aux >> 8) & 0xFFFFFFFF
    least = -(-percent * (size_a + size_b) // (100 + percent))
    return np.minimum(place_a, place_b) + np.minimum(size_a - place_a, size_b - place_b) >= least


_PAIR = "a long, b long, need int, m long"


def _pairs(a, b, a_aux, b_aux) -> pa.RecordBatch:
    need = np.minimum(a_aux & 0xFF, b_aux & 0xFF).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need), pa.array(np.ones(len(need), np.int64))], names=["a", "b", "need", "m"])


def _added(pairs: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One row of each pair: the least it has to share and how many tokens it has shared."""
    t = pa.Table.from_batches(pairs)
    if not len(t):
        return []
    a, b, need, m = (t.column(c).to_numpy() for c in range(4))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return [pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.minimum.reduceat(need[order], at)), pa.array(np.add.reduceat(m[order], at))], names=t.column_names)]


def _hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each node of a list with the list's hub: the node in whose order the token comes first, so with the fewest rarer ones."""

    def run(batches):
        hub = None
        for t in batches:
            key, node, aux = (t.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            new = np.concatenate([[hub is None or key[0] != hub[0]], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            h_node = np.where(first >= 0, node[first], hub[1] if hub else 0)
            h_aux = np.where(first >= 0, aux[first], hub[2] if hub else 0)
            on = ~new & (node != h_node) & _fits(aux, h_aux, percent)
            yield _pairs(node[on], h_node[on], aux[on], h_aux[on])
            hub = (key[-1], h_node[-1], h_aux[-1])

    # one list for each range of sizes: others can't match, and what hubs miss is compared later
    key = F.xxhash64("key", _sizes(percent)).alias("key")
    return lists.select(key, "node", "aux").repartition("key").sortWithinPartitions("key", "aux", "node").mapInArrow(lean(run), _PAIR)


def _sizes(percent: int) -> Column:
    """The range that a node's size lies in. Sets that can match lie in one range or in neighbours."""
    size = F.shiftright("aux", 8).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.floor(F.log(size.cast("double")) / (float(np.log(100 / percent)) * 1.0001)).cast("int") if percent < 100 else size.cast("int") * 2


def _cross_pairs(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list in different components that sizes, places and parities allow, in blocks of the list.

    A list falls into ranges of sizes; nodes also visit the next range, where they meet those at home there.
    Lists with one least node have much the same nodes: they are compared in one task, up to TOGETHER
    rows, which adds up what a pair shares in them.
    """
    rows = lists.select("key", "node", "aux").join(nodes.select("node", "component"), "node").withColumn("_range", _sizes(percent))
    rows = rows.withColumn("_visits", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", F.xxhash64("key", F.col("_range") + F.col("_visits"))).withColumn("_home", F.col("_visits") == 0)
    several = rows.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n"), F.max("_home").alias("_h"), F.min("node").alias("_least")).where("_a <> _b and _h").select("key", "_least", "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    # rows of lists before this one, in lists that could be compared with it: every TOGETHER of them a task takes over
    before = F.sum("_n").over(Window.partitionBy("_least", "_blocks").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    several = several.select("key", "_blocks", F.xxhash64("_least", "_blocks", F.floor(F.coalesce(before, F.lit(0)) / TOGETHER)).alias("_with"))
    # parities are most of a row's bytes: they come once it is known which lists are compared
    rows = rows.join(several, "key").join(nodes.select("node", "parity"), "node").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("_with", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "key", "node", "aux", "component", "parity", "_own", "_home")

    def compare(t: pa.Table):
        node, aux, comp, own, home = (t.column(c).to_numpy() for c in ("node", "aux", "component", "_own", "_home"))
        bits = _folded(t.column("parity").to_pylist())
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node)) if i == j else np.flatnonzero((own == j) & (own[x] == i))
            if not len(y):
                continue
            y = y[(comp[y] != comp[x]) & (home[y] | home[x])]
            y = y[_fits(aux[y], aux[x], percent)]
            sizes = ((aux[y] >> 8) & 0xFFFFFFFF) + ((aux[x] >> 8) & 0xFFFFFFFF)
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(1) * (100 + percent) <= (100 - percent) * sizes]
            if len(y):
                yield _pairs(node[y], np.full(len(y), node[x]), aux[y], np.full(len(y), aux[x]))

    def lists_of(batches):
        """(task's key, table) of each block of a list."""
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.column_stack([b.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for x, y in zip(cuts, cuts[1:]):
                if held and last != tuple(k[x]):
                    yield last[:3], pa.Table.from_batches(held)
                    held = []
                last = tuple(k[x])
                held.append(b.slice(x, y - x))
        if held:
            yield last[:3], pa.Table.from_batches(held)

    def run(batches):
        found: list[pa.RecordBatch] = []
        n, last = 0, None
        for at, t in lists_of(batches):
            if found and at != last:
                yield from _added(found)
                found, n = [], 0
            last = at
            pairs = list(compare(t))
            if not pairs:
                continue
            found += _added(pairs)
            n += len(found[-1])
            if n >= HELD_PAIRS:
                found = _added(found)
                n = len(found[0])
                if n >= HELD_PAIRS // 2:
                    yield from found
                    found, n = [], 0
        if found:
            yield from _added(found)

    return rows.repartition("_with", "i", "j").sortWithinPartitions("_with", "i", "j", "key").mapInArrow(lean(run), _PAIR)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that share enough prefix tokens and whose sets then are similar."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.sum("m").alias("m"), F.min("need").alias("need")).where("m >= need").select("a", "b"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "row"), "node")
    wanted = cut(wanted.select(F.col("row").alias("_row"), "node"))
    texts = docs.withColumn("_row", F.xxhash64("text"))
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted

    def sets(batches):
        for b in batches:
            seen = set()
            node = b.column(0).to_numpy()
            for i, _, s in _sliced(b, n):
                found, ids, out = s.nodes().view(np.int64), [], []
                for d in range(len(found)):
                    if node[i + d] == found[d] and found[d] not in seen:
                        seen.add(found[d])
                        ids.append(int(found[d]))
                        out.append(s.token[s.first[d] : s.first[d + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["node", "tokens"])

    tokens = texts.join(wanted, "_row").select("node", "text").mapInArrow(lean(sets), "node long, tokens binary")
    tokens = cut(tokens.groupBy("node").agg(F.first("tokens").alias("tokens")))

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("_x"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("_y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(lean(verify), "a long, b long"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, by rounds of least neighbours and pointer jumps."""
    label = cut(nodes.select("node", F.col("node").alias("component")))
    if links.isEmpty():
        return label
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("_to")).union(links.select("b", "a")))
    linked = cut(both.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        to = linked.select(F.col("node").alias("_to"), F.col("component").alias("_c"))
        near = both.join(to, "_to").groupBy("node").agg(F.min("_c").alias("_c"))
        step = linked.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("_j"))
        new = cut(step.join(jump, "component").select("node", "_old", F.least("component", "_j").alias("component")))
        discard(linked)
        linked = new.select("node", "component")
        if new.where("_old <> component").isEmpty():
            break
    return cut(label.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, doc, row = hash of the text, n), one for each document, and nodes (node, least, component)."""
    d = docs.select(docs[id_col].cast("long").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    published = cut(_shared(_publish(d, n, percent, _frequent(d, n))))
    members = published.where("kind = 1").select("node", "doc", F.col("aux").alias("row"), "n")
    lists = published.where("kind = 0").select("key", "node", "aux")
    nodes = published.where("kind = 1 and n > 0").groupBy("node").agg(F.min("doc").alias("least"), F.first("aux").alias("row"), F.first("parity").alias("parity"))
    nodes = cut(nodes)
    near = _verified(_hub_pairs(lists, percent), nodes, d, n, percent)
    first = components(nodes, near)
    rest = _verified(_cross_pairs(lists, nodes.join(first, "node"), percent), nodes, d, n, percent)
    whole = components(nodes, near.union(rest))
    return members, nodes.select("node", "least").join(whole, "node")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Links join documents whose sets of distinct word n-grams (A-Z lower-cased) have
    100 * |both| >= percent * |either|; component_id is the smallest id that links
    reach. A text of fewer than n words is one n-gram; null, empty and blank texts
    have none and no links. Rows are taken one by one, so repeated rows are
    linked like copies; a null id takes part but names no component unless it is
    alone; an empty table gives no row. Other columns are not read.
    """
    members, named = _grouped(docs, id_col, text_col, n, percent)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.select("node", "component").join(least, "component").select("node", "component_id")
    out = members.join(found, "node", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, then the least hash of its text.

    Null ids come last. Rows are told apart by id and text, so ids may be null or shared;
    of rows with the same id and text one stays. Texts without n-grams have no links and all stay.
    """
    members, named = _grouped(docs, id_col, text_col, n, percent)
    members = members.where("n > 0")
    by_node = members.groupBy("node").agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "row")).alias("stay"), F.count(F.lit(1)).alias("rows"))
    by_node = by_node.join(named.select("node", "component"), "node")
    stay = by_node.groupBy("component").agg(F.min("stay").alias("stay"), F.sum("rows").alias("rows")).where("rows > 1").select("component", "stay")
    judged = members.join(by_node.select("node", "component").join(stay, "component").select("node", "stay"), "node")
    judged = judged.withColumn("stays", F.col("doc").eqNullSafe(F.col("stay.doc")) & (F.col("row") == F.col("stay.row")))
    keys = judged.groupBy(F.col("doc").alias("_id"), F.col("row").alias("_row")).agg(F.first("stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    keys = cut(keys.where("not _stays or _rows > 1").select("_id", "_row", "_stays"))
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # rows travel inside a struct, so their columns may have any names
    whole = docs.select(docs[id_col].cast("long").alias("_doc"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_text"), F.struct(*(docs[c] for c in docs.columns)).alias("_all"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row"))
    columns = [F.col("_all")[c].alias(c) for c in docs.columns]
    kept = whole.join(F.broadcast(keys) if small else keys, same, "left_anti").select(*columns)
    repeated = keys.where("_stays")
    if repeated.isEmpty():
        return kept
    repeated = F.broadcast(repeated) if small else repeated
    one = whole.join(repeated, same).groupBy("_id", "_row").agg(F.first("_all").alias("_all"))
    return kept.union(one.select(*columns))
