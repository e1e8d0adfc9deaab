"""Ids of a public tokenizer for whole documents.

The tokenizer drops white space and never joins what white space parts, so a
document's ids are those of its chunks in turn. Each distinct chunk is given to
the tokenizer library once per worker and its ids are then gathered with array
operations.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from ._columns import LOWER, Words, runs, slices, text_buffers

#: Bytes of remembered chunks at which a Python worker starts afresh: bounds memory, not results.
REMEMBERED_BYTES = 24 << 20

_LETTER, _DIGIT, _PUNCTUATION, _OTHER, _SPACE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _LETTER
_CLASS[[*b"0123456789"]] = _DIGIT
_CLASS[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = _PUNCTUATION


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Parts of a text that the tokenizer treats one by one, and which bytes are plain letters.

    Besides at white space, the tokenizer's pattern always ends a match between
    a letter, a digit and ASCII punctuation. Apostrophes, angle brackets, bars
    and non-ASCII characters other than Latin-1 letters may bind to their
    neighbours, so nothing is parted next to them. Case is folded as the tokenizer does.
    """
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] < 0xC0) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    if b"<|" not in raw.tobytes():
        raw = LOWER[raw]
    n = len(raw)
    cut = np.ones(n + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = ((a != b) | (a == _DIGIT)) & (((a != _OTHER) & (b != _OTHER)) | (a == _SPACE) | (b == _SPACE))
    cut[offsets] = True
    at = np.flatnonzero(cut)
    inside = kind[at[:-1]] != _SPACE
    start, end = at[:-1][inside], at[1:][inside]
    return Words(raw, start, end, np.searchsorted(start, offsets)), kind == _LETTER


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """ids of chunks, by 64-bit hash; chunks are compared by a second hash too."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._only_if_spaces_part(path)
        self.clear()

    def _only_if_spaces_part(self, path: str) -> None:
        with open(path) as f:
            steps = json.load(f)
        if "Removed" not in json.dumps(steps.get("pre_tokenizer")) or not steps["model"].get("end_of_word_suffix"):
            raise ValueError("a tokenizer that drops white space and marks the ends of words is needed")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(steps["model"]["end_of_word_suffix"])]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _learn(self, w: Words, plain: np.ndarray, pick: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Adds the chunks w[pick], sorted by key and not yet known."""
        start, n_bytes = w.start[pick], (w.end - w.start)[pick]
        other = np.concatenate([[0], np.cumsum(~plain)])
        simple = other[start + n_bytes] == other[start]
        n = np.zeros(len(pick), np.int64)
        parts = [np.zeros(0, np.uint32)]
        group = np.flatnonzero(simple)
        if len(group):
            length = n_bytes[group] + 1
            joined = w.raw[np.minimum(runs(start[group], length), len(w.raw) - 1)]
            ends = np.cumsum(length)
            joined[ends - 1] = 0x20
            cut = [0, *ends[63::64].tolist(), int(ends[-1])]
            ids = self._encode([joined[a:b].tobytes().decode("utf-8") for a, b in zip(cut, cut[1:]) if a < b])
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(group):
                n[group] = np.diff(np.concatenate([[-1], last]))
                parts.append(ids)
            else:
                simple[:] = False
        group = np.flatnonzero(~simple)
        if len(group):
            each = [self._ids(bytes(w.raw[a : a + b]).decode("utf-8", "replace")) for a, b in zip(start[group].tolist(), n_bytes[group].tolist())]
            n[group] = [len(x) for x in each]
            parts.append(np.array([i for x in each for i in x], np.uint32))
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        at = np.zeros(len(pick), np.int64)
        at[order] = np.concatenate([[0], np.cumsum(n[order])[:-1]]) + len(self.ids)
        self.ids = np.concatenate([self.ids, *parts])
        where = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, where, key), np.insert(self.check, where, check)
        self.at, self.n = np.insert(self.at, where, at), np.insert(self.n, where, n)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of some documents one after another, and their n + 1 offsets."""
        w, plain = chunks(raw, offsets)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h, g = w.hashes(), w.hashes(7)
        key, back, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (g != g[back][inverse]).any():
            return self._plain(raw, offsets)
        if sum(x.nbytes for x in (self.key, self.check, self.at, self.n, self.ids)) > REMEMBERED_BYTES:
            self.clear()
        where = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = self.key[where] == key if len(self.key) else np.zeros(len(key), bool)
        if (self.check[where[known]] != g[back[known]]).any():
            return self._plain(raw, offsets)
        if not known.all():
            self._learn(w, plain, back[~known], key[~known], g[back[~known]])
            where = np.searchsorted(self.key, key)
        at, n = self.at[where][inverse], self.n[where][inverse].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1])].astype(np.uint32)
        return ids, np.concatenate([[0], ends])[w.first]

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without hashes, for the case that two different chunks share one."""
        each = [np.array(self._ids(bytes(raw[a:b]).decode("utf-8", "replace")), np.uint32) for a, b in zip(offsets, offsets[1:])]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])])


@functools.lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker, kept from task to task."""
    return ChunkIds(path)


def encoded(column, path: str):
    """For each slice of a text column: first document, ids, offsets of its documents' ids."""
    raw, offsets = text_buffers(column)
    coder = chunk_ids(path)
    for i, j in slices(offsets):
        ids, at = coder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, ids, at
