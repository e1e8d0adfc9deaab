"""Language spans: script ranges, per-word scores and Viterbi decoding with a switching penalty."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._columns import LOWER, Words, runs, slices, text_buffers, words
from ._labelled import held_out
from ._worker import lean

GRAM_BITS = 16
BLOCK = 512
#: Unicode ranges of scripts. What lies in no range (punctuation, symbols) has no script and tells nothing.
SCRIPTS = (
    ("latin", 0x41, 0x5B), ("latin", 0x61, 0x7B), ("latin", 0xAA, 0xAB), ("latin", 0xB5, 0xB6), ("latin", 0xBA, 0xBB), ("latin", 0xC0, 0xD7), ("latin", 0xD8, 0xF7), ("latin", 0xF8, 0x2B0), ("latin", 0x1E00, 0x1F00),
    ("greek", 0x370, 0x400), ("greek", 0x1F00, 0x2000), ("cyrillic", 0x400, 0x530), ("armenian", 0x530, 0x590), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x700), ("arabic", 0x750, 0x780),
    ("devanagari", 0x900, 0x980), ("bengali", 0x980, 0xA00), ("gurmukhi", 0xA00, 0xA80), ("gujarati", 0xA80, 0xB00), ("tamil", 0xB80, 0xC00), ("telugu", 0xC00, 0xC80), ("kannada", 0xC80, 0xD00),
    ("malayalam", 0xD00, 0xD80), ("sinhala", 0xD80, 0xE00), ("thai", 0xE00, 0xE80), ("lao", 0xE80, 0xF00), ("tibetan", 0xF00, 0x1000), ("myanmar", 0x1000, 0x10A0), ("georgian", 0x10A0, 0x1100),
    ("hangul", 0x1100, 0x1200), ("ethiopic", 0x1200, 0x13A0), ("khmer", 0x1780, 0x1800), ("mongolian", 0x1800, 0x18B0), ("kana", 0x3040, 0x3100), ("han", 0x3400, 0xA000), ("hangul", 0xAC00, 0xD7B0),
    ("han", 0x20000, 0x323B0),
)
NAMES = tuple(dict.fromkeys(["", *(s[0] for s in SCRIPTS)]))
_SCRIPT = np.zeros(1 << 21, np.int8)
for _name, _from, _to in SCRIPTS:
    _SCRIPT[_from:_to] = NAMES.index(_name)
#: Characters without a script that belong to the letter before: combining marks and joiners. All others part words.
_PARTS = _SCRIPT == 0
for _from, _to in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x200C, 0x200E), (0x20D0, 0x2100), (0xFE00, 0xFE10), (0xFE20, 0xFE30)):
    _PARTS[_from:_to] = False
#: ASCII letters and the bytes of non-ASCII characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _characters(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at `at`."""
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    a = padded[at].astype(np.int32)
    b, c, d = (padded[at + k].astype(np.int32) & 63 for k in (1, 2, 3))
    three = np.where(a < 0xF0, ((a & 15) << 12) | (b << 6) | c, ((a & 7) << 18) | (b << 12) | (c << 6) | d)
    return np.where(a < 0x80, a, np.where(a < 0xE0, ((a & 31) << 6) | b, three))


def _scripted(raw: np.ndarray) -> np.ndarray:
    """The bytes, with spaces for non-ASCII characters that have no script and so part words."""
    at = np.flatnonzero(raw >= 0xC0)
    if not len(at):
        return raw
    at = at[_PARTS[_characters(raw, at)]]
    n = 2 + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
    out = raw.copy()
    for k in range(4):
        out[at[n > k] + k] = 32
    return out


def _word_scripts(w: Words) -> np.ndarray:
    """The script of most of each word's characters; 0 for a word that has only marks."""
    if not len(w):
        return np.zeros(0, np.int8)
    at = np.flatnonzero(_IN_WORD[w.raw] & ((w.raw < 0x80) | (w.raw >= 0xC0)))
    script = _SCRIPT[_characters(w.raw, at)]
    at, script = at[script > 0], script[script > 0]
    first = np.searchsorted(at, w.start)
    count = np.searchsorted(at, w.end) - first
    out = np.zeros(len(w), np.int8)
    has = np.flatnonzero(count)
    if len(has):
        out[has] = np.minimum.reduceat(script, first[has])
        mixed = has[np.maximum.reduceat(script, first[has]) != out[has]]
        for word in np.array_split(mixed, len(mixed) // 10_000 + 1):
            n = count[word]
            cell = np.repeat(np.arange(len(word)) * len(NAMES), n) + script[runs(first[word], n)]
            out[word] = np.bincount(cell, minlength=len(word) * len(NAMES)).reshape(-1, len(NAMES)).argmax(1)
    return out


def _grams(w: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed three-byte grams of all words, one for each byte, and where each word's begin."""
    inside = _IN_WORD[w.raw]
    m = np.where(inside, w.raw, 32).astype(np.uint32)
    left, right = np.full(len(m), 32, np.uint32), np.full(len(m), 32, np.uint32)
    left[1:], right[:-1] = m[:-1], m[1:]
    left[offsets[offsets < len(m)]] = 32
    right[offsets[offsets > 0] - 1] = 32
    at = np.flatnonzero(inside)
    g = (left[at] << np.uint32(16)) | (m[at] << np.uint32(8)) | right[at]
    return (g * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS), np.concatenate([[0], np.cumsum(w.end - w.start)])


#: Bytes decoded at a time; a text over this many is decoded in pieces of about as many.
PIECE = 1 << 19


def _piece_ends(text: np.ndarray, most: int) -> list[int]:
    """Where a long text is cut: behind the last byte of each `most` that is in no word, or else between two characters."""
    at = [0]
    while len(text) - at[-1] > most:
        part = text[at[-1] : at[-1] + most]
        out = np.flatnonzero(~_IN_WORD[part])
        if not len(out):
            out = np.flatnonzero((text[at[-1] + 1 : at[-1] + most + 1] & 0xC0) != 0x80)
        at.append(at[-1] + int(out[-1]) + 1)
    return [*at, len(text)]


def _prepared(part: np.ndarray, at: np.ndarray) -> Words:
    return words(_scripted(LOWER[part]), at, _IN_WORD)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-probability of each gram by language, less the mean over languages
    candidate: np.ndarray  # by script and language
    penalty: float = 6.0
    clip: float = 6.0

    def slice_bytes(self) -> int:
        """Text decoded at a time: scores and back pointers take some bytes for each word and language (or pair of languages, if few)."""
        many = max(len(self.languages), 4)
        return max(1 << 12, min(PIECE, (32 << 20) // (many * self._entries(many))))

    @staticmethod
    def _entries(many: int) -> int:
        """Few languages: blocks are decoded side by side for each language that they may be entered with. Many: documents are, word by word."""
        return many if many <= 8 else 1

    def word_scores(self, w: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, and which words tell anything."""
        g, first = _grams(w, offsets)
        out = np.zeros((len(w), len(self.languages)), np.float32)
        if len(w):
            out = np.add.reduceat(self.table[g], first[:-1], axis=0)
        np.clip(out, -self.clip, self.clip, out=out)
        script = _word_scripts(w)
        out[script == 0] = 0
        return out + np.where(self.candidate[script], 0, -4 * self.clip).astype(np.float32), script > 0

    def decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of each word: most score less `penalty` for each switch within a document."""
        n_docs = len(first) - 1
        return self.path(score, first, np.zeros((n_docs, score.shape[1]), np.float32))[0]

    def path(self, score: np.ndarray, first: np.ndarray, total: np.ndarray, last: np.ndarray | None = None, back_too: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray | None]:
        """Labels, gains at the end by language, and the languages that documents were entered with.

        total: gains at the start by document and language (what came before a piece of a
        text); last: the languages to end with, or those of most gain. Documents
        are decoded side by side. With few languages long ones fall into blocks, each
        decoded for every language that it may be entered with, and the blocks'
        gains are then chained, so the labels are the best over the whole document.
        """
        n_docs, many = len(first) - 1, score.shape[1]
        entries = self._entries(many)
        n = np.diff(first)
        total = total.copy()
        blocks = -(-n // BLOCK) if entries == many else np.minimum(n, 1)
        doc = np.repeat(np.arange(n_docs), blocks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[doc] + k * BLOCK
        size = np.minimum(n[doc] - k * BLOCK, BLOCK) if entries == many else n[doc]
        order = np.argsort(-size, kind="stable")
        start_o, size_o = start[order], size[order]
        if entries == many:
            gain = np.broadcast_to(np.where(np.eye(many, dtype=bool), 0, -np.inf).astype(np.float32), (len(doc), many, many)).copy()
        else:
            gain = total[doc[order]][:, None, :]
        kind = np.int8 if many < 128 else np.int16
        back = np.zeros((len(score), entries, many), kind) if back_too else None
        for t in range(int(size_o[0]) if len(doc) else 0):
            m = int(np.searchsorted(-size_o, -t, "left"))
            g = gain[:m]
            top, arg = g.max(2), g.argmax(2)
            switch = (top - self.penalty)[:, :, None] > g
            at = start_o[:m] + t
            if back_too:
                back[at] = np.where(switch, arg[:, :, None], np.arange(many))
            gain[:m] = np.where(switch, (top - self.penalty)[:, :, None], g) + score[at][:, None, :]
        whole = np.empty_like(gain)
        whole[order] = gain
        at0 = np.cumsum(blocks) - blocks
        most = int(blocks.max()) if n_docs else 0
        came = np.zeros((len(doc), many), kind)
        for step in range(most):
            on = np.flatnonzero(blocks > step)
            b = at0[on] + step
            if entries == 1:
                total[on] = whole[b, 0]
                continue
            # the first word may be entered with any language at the cost of what came before
            way = total[on][:, :, None] + whole[b]
            came[b] = way.argmax(1)
            total[on] = way.max(1)
        if not back_too:
            return None, total, None
        last = total.argmax(1) if last is None else last.copy()
        leave, enter = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for step in range(most - 1, -1, -1):
            on = np.flatnonzero(blocks > step)
            b = at0[on] + step
            leave[b] = last[on]
            enter[b] = came[b, last[on]]
            last[on] = enter[b]
        out = np.zeros(len(score), np.int64)
        state, entered = leave[order], enter[order] if entries == many else np.zeros(len(doc), np.int64)
        for t in range(int(size_o[0]) - 1 if len(doc) else -1, -1, -1):
            m = int(np.searchsorted(-size_o, -t, "left"))
            at = start_o[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, entered[:m], state[:m]]
        if entries == 1:
            last[doc[order]] = state
        return out, total, last

    def decoded(self, column: pa.Array):
        """(first document, end, words, their documents' offsets, labels, which words tell anything, bytes before) of each slice.

        A text over PIECE bytes comes alone and in pieces, the last one first: the way to its end is
        weighed piece by piece, keeping one gain for each language between pieces, and then
        traced back, each piece's words scored once more. So memory doesn't grow with a text.
        """
        raw, offsets = text_buffers(column)
        most = self.slice_bytes()
        for i, j in slices(offsets, most):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if j - i > 1 or len(part) <= most:
                w = _prepared(part, at)
                score, tells = self.word_scores(w, at)
                yield i, j, w, at, self.decode(score, w.first), tells, 0
                continue
            ends = _piece_ends(part, min(most, PIECE))
            total, totals, last = np.zeros((1, len(self.languages)), np.float32), [], None
            for a, z in zip(ends, ends[1:]):
                totals.append(total)
                w = _prepared(part[a:z], np.array([0, z - a]))
                score, _ = self.word_scores(w, np.array([0, z - a]))
                _, total, _ = self.path(score, w.first, total, back_too=False)
            for k in range(len(totals) - 1, -1, -1):
                a, z = ends[k], ends[k + 1]
                w = _prepared(part[a:z], np.array([0, z - a]))
                score, tells = self.word_scores(w, np.array([0, z - a]))
                label, _, last = self.path(score, w.first, totals[k], last)
                yield i, j, w, np.array([0, z - a]), label, tells, a

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language with the most bytes in each document, and its share of the bytes that tell anything."""
        names, share = ["und"] * len(column), np.zeros(len(column))
        if not self.languages:
            return names, share
        many = len(self.languages)
        mass, has, ascii_letter = np.zeros((len(column), many)), np.zeros(len(column), bool), np.zeros(len(column), bool)
        for i, j, w, _, label, tells, _ in self.decoded(column):
            doc = w.doc()
            size = np.where(tells, w.end - w.start, 1e-6)
            mass[i:j] += np.bincount(doc * many + label, weights=size, minlength=(j - i) * many).reshape(-1, many)
            has[i + doc[tells]] = True
            ascii_letter[i + doc[w.raw[w.start] < 128]] = True
        best = mass.argmax(1)
        for d in np.flatnonzero(has & ~ascii_letter).tolist():
            has[d] = any(c.isalpha() for c in (column[d].as_py() or ""))
        for d in np.flatnonzero(has).tolist():
            names[d] = self.languages[best[d]]
            share[d] = mass[d, best[d]] / mass[d].sum()
        return names, share

    def spans(self, column: pa.Array):
        """(document, first byte, end byte, language) of each run of words with one language."""
        later: list[tuple[int, int, int, int]] = []  # of the pieces of one text behind the one at hand
        for i, _, w, at, label, _, before in self.decoded(column):
            doc, found = w.doc(), []
            if len(label):
                new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                end = np.concatenate([new[1:], [len(label)]]) - 1
                base = at[doc[new]] - before
                found = list(zip((i + doc[new]).tolist(), (w.start[new] - base).tolist(), (w.end[end] - base).tolist(), label[new].tolist()))
            if found and later and found[-1][0] == later[0][0] and found[-1][3] == later[0][3]:
                later[0] = (*found.pop()[:2], *later[0][2:])
            later = found + later
            if not before:
                yield from ((d, a, z, self.languages[x]) for d, a, z, x in later)
                later = []


def _counts(batches):
    """(lang, gram, n): grams of each batch; script s counts as gram 2^16 + s."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j in slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            w = words(_scripted(LOWER[raw[offsets[i] : offsets[j]]]), at, _IN_WORD)
            g, first = _grams(w, at)
            doc = w.doc()
            doc_of_gram = np.repeat(doc, np.diff(first))
            script = _word_scripts(w)
            for lang in sorted(set(langs[i:j])):
                on = langs[i:j] == lang
                n = np.concatenate([np.bincount(g[on[doc_of_gram]], minlength=1 << GRAM_BITS), np.bincount(script[on[doc]], minlength=len(NAMES))])
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, **settings) -> Model:
    """Gram statistics of about `per_language` documents of each language, picked by a hash of the id.

    Rows with a null language, text or id teach nothing. Without any the model knows no language.
    """
    d = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_t"), docs[lang_col].alias("lang")).where("_id is not null and _t is not null and lang is not null")
    size = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return Model([], np.zeros((1 << GRAM_BITS, 0)), np.zeros((len(NAMES), 0), bool), **settings)
    limit = docs.sparkSession.createDataFrame([(k, min(per_language / n, 1.0)) for k, n in size.items()], "_l string, _p double")
    d = d.join(F.broadcast(limit), F.col("lang") == F.col("_l")).where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < F.col("_p") * 1_000_003)
    got = d.select("lang", "_t").mapInArrow(lean(_counts), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    n = np.zeros(((1 << GRAM_BITS) + len(NAMES), len(languages)))
    n[got["gram"].to_numpy(), np.searchsorted(np.array(languages, object), got["lang"].to_numpy(object))] = got["n"]
    grams, scripts = n[: 1 << GRAM_BITS] + 0.2, n[1 << GRAM_BITS :]
    logs = np.log(grams / grams.sum(0))
    candidate = scripts / np.maximum(scripts.sum(0), 1) >= 0.01
    candidate[0] = True
    candidate[~candidate.any(1)] = True
    return Model(languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32), candidate, **settings)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 for a text that is null or has no letter of a script in SCRIPTS."""

    def run(batches):
        for b in batches:
            names, share = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text has a span in any language, of however many; all columns as they are.

    Only null texts and texts without a letter of a script in SCRIPTS go. A model that has learned
    no language can't label spans: then every text with a letter of any script stays. One narrow
    pass, so repeated and null ids don't matter.
    """
    if not model.languages:
        return docs.where(F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            names, _ = model.predict(b.column(at))
            yield b.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_byte, end_byte (in the UTF-8 text), lang: each run of words that was given one language."""
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, first_byte long, end_byte long, lang string"

    def run(batches):
        for b in batches:
            rows = list(model.spans(b.column(1)))
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))], names=["doc_id", "first_byte", "end_byte", "lang"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, rest: int = 2, per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns only from rows that are not held out.

    Repeated rows repeat, null ids are not held out and teach nothing, an empty table gives no row.
    """
    model = fit(docs.where(~held_out(docs[id_col], modulus, rest)), id_col, text_col, lang_col, per_language)
    out = predict_languages(docs, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "lang_pred", "score")
