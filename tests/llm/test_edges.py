"""Odd inputs: pipeline stages on nulls, empty tables, repeated rows and clashing columns; many languages and very long texts."""

import random
import subprocess
import sys
import tracemalloc
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotweave.llm import _labelled, decontamination, jaccard, languages, packing, recompression, repeats, suffixes

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, n_removed string, kept_text string, row string, rest int, matches string, node long, _id long"


def odd(spark, rows, n_chars=False):
    """Documents whose further columns are named as the stages' own."""
    out = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", 7, "a", "b", "c", 1, "d", 5, 6) for i, t in rows], SCHEMA).repartition(3)
    return out.withColumn("n_chars", F.length("text")) if n_chars else out


def words(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("n_chars", [False, True])
def test_stages_on_odd_rows(spark, n_chars):
    shared = words(1, 30)
    rows = [(1, words(2)), (2, words(2) + " more"), (3, None), (4, ""), (5, " \t"), (None, words(3)), (None, words(4)), (7, words(5)), (7, words(6)), (8, words(7)), (8, words(7)), (9, words(8) + " " + shared), (10, words(9) + "\n" + shared), (11, "12 34")]
    docs = odd(spark, rows, n_chars)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        assert all((r.n_words, r.n_removed, r.kept_text, r.row, r.rest, r.matches, r.node, r._id) == (7, "a", "b", "c", 1, "d", 5, 6) for r in seen[name])
    text = lambda name: sorted((r.doc_id or 0, r.text) for r in seen[name])
    lettered = sorted((i or 0, t) for i, t in rows if t and any(c.isalpha() for c in t))
    assert text("language identification") == lettered
    once = sorted(set(lettered) - {(2, words(2) + " more")})
    assert text("n-gram Jaccard join") == once
    cut = sorted((i, words(9)) if i == 10 else (i, t) for i, t in once)
    assert text("substring dedup") == cut == text("benchmark decontamination")
    if n_chars:
        assert all(r.n_chars == len(r.text) for r in seen["substring dedup"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in seen["benchmark decontamination"]}


def test_passage_stage_keeps_null_texts(spark):
    got = corpus_pipeline.cut_repeated_passages(spark, odd(spark, [(1, None), (2, ""), (3, words(1)), (4, words(1))]), DIR).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, None), (2, ""), (3, words(1))], key=lambda x: x[0])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd(spark, []), DIR)
    assert out.count() == 0 and (stage == 4 or out.columns == odd(spark, []).columns)


def test_many_languages(spark):
    r = np.random.default_rng(0)
    m = languages.Model([f"l{k:03}" for k in range(200)], None, None, penalty=1.5)
    first = np.array([0, 40, 40, 300])
    s = r.normal(size=(300, 200)).astype("f4")
    label = m.decode(s, first)
    for a, b in ((0, 40), (40, 300)):
        v = s[a].astype(float)
        for t in range(a + 1, b):
            v = np.maximum(v, v.max() - 1.5) + s[t]
        assert abs(sum(s[t, label[t]] for t in range(a, b)) - 1.5 * (label[a : b - 1] != label[a + 1 : b]).sum() - v.max()) < 1e-2
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k % 5}x" for k in range(30)).replace("0", "q").replace("1", "w").replace("2", "z").replace("3", "k").replace("4", "j"), f"l{i:03}") for i in range(200)], "doc_id long, text string, lang string")
    model = languages.fit(docs)
    assert len(model.languages) == 200
    got = languages.predict_languages(docs, model).join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() > 180


@pytest.mark.parametrize("many", [3, 12])
def test_long_texts_are_decoded_like_whole_ones(monkeypatch, many):
    r = random.Random(many)
    vocabulary = [["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(40)] for _ in range(many)]
    rng = np.random.default_rng(many)
    m = languages.Model([f"l{k}" for k in range(many)], rng.normal(size=(1 << languages.GRAM_BITS, many)).astype("f4"), np.ones((len(languages.NAMES), many), bool), penalty=2.0)
    text = " ".join(r.choice(vocabulary[(k // 50) % many]) for k in range(3000)) + " " + "é" * 500
    column = pa.array([text, None, "ab cd", text + " zz"])
    whole, spans = m.predict(column), list(m.spans(column))
    monkeypatch.setattr(languages.Model, "slice_bytes", lambda self: 700)
    pieces = m.predict(column)
    assert pieces[0] == whole[0] and np.allclose(pieces[1], whole[1], atol=2e-3)
    again = list(m.spans(column))
    assert len(again) == len(spans) and again == sorted(again)
    assert sum(a == b for a, b in zip(again, spans)) >= 0.99 * len(spans)


_CHILD = """
import resource, sys
import numpy as np, pyarrow as pa
from plotweave.llm import languages
m = languages.Model(list("abcd"), np.random.default_rng(0).normal(size=(1 << languages.GRAM_BITS, 4)).astype("f4"), np.ones((len(languages.NAMES), 4), bool))
text = pa.array(["some words of a text " * 1_000_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m.predict(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_text_of_20_mb_takes_little_memory():
    got = subprocess.run([sys.executable, "-c", _CHILD], capture_output=True, text=True, check=True)
    assert int(got.stdout) < 200


def test_very_long_text_through_the_operators(spark):
    long = words(3, 150_000)  # 1 MB, more than a slice
    rows = [(1, long), (2, "x " + long[: len(long) // 2]), (3, words(4))]
    docs = odd(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompression.deduplicate(docs).collect()}
    half = len((rows[1][1]).split())
    assert got[1] == (150_000, 0) and got[3] == (60, 0) and got[2][0] == half and got[2][1] >= half - 2
    bytes_ = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.deduplicate(docs).collect()}
    assert bytes_[1] == (len(long), 0, 0) and bytes_[2][1] >= len(rows[1][1]) - 2 and bytes_[2][2] == 1
    assert {r.doc_id for r in packing.pack(docs).collect()} == {1, 2, 3}


def test_what_recurs_leaves_a_task_about_once():
    r = np.random.default_rng(1)
    met, out, marked = repeats.Met(), 0, 0
    for n in range(200):
        k = np.concatenate([np.arange(50, dtype=np.uint64) + np.uint64(7), r.integers(0, 1 << 63, 300).astype(np.uint64)])
        for b in repeats.unlike(k, k, np.full(350, n), np.arange(350), np.ones(350, np.int32), met):
            kind = b.column(0).to_numpy()
            out, marked = out + int((kind == 0).sum()), marked + int(b.column(5).to_numpy()[kind == 1].sum())
    assert out - 200 * 300 <= 2 * 50 and marked >= 198 * 50


def test_repeated_ids_are_settled_before_they_are_collected(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(300)] + [(2, None), (None, "x")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0)], "_id long, _y int")
    got = _labelled.sampled_features(docs, sample, "doc_id", "text", lambda c: [(t or "").encode() for t in c.to_pylist()])
    assert len(got) == 2 and got[1] == (0, b"")


def test_links_between_sizes_at_the_bound(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(n, " ".join(base[:n])) for n in range(40, 400, 3)]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(odd(spark, rows)).collect()}
    root = {}
    for n in range(40, 400, 3):
        near = n - 3 in root and 100 * (n - 5) >= 90 * (n - 2)
        root[n] = root[n - 3] if near else n
    assert got == root


def test_parities_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 9000)]
    texts = [" ".join(base[:n]) for n in (0, 1, 40, 1500, 2000, 4300, 4700, 9000)]
    texts += [" ".join(x if rng.random() > 0.03 else "other" for x in base[:n]) for n in (40, 2000, 4700, 9000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    shingles = jaccard.Shingles(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 3)
    sets = [set(shingles.token[a:z].tolist()) for a, z in zip(shingles.first, shingles.first[1:])]
    for percent in (80, 90, 100):
        parities = shingles.parities(percent)
        assert all(jaccard.PARITY_BITS[0] <= 8 * len(p) <= jaccard.PARITY_BITS[1] for p in parities)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                a, b = jaccard._folded([parities[i], parities[j]])
                assert np.bitwise_count(a ^ b).sum() <= len(x ^ y)
    assert len({len(p) for p in shingles.parities(90)}) > 1


@pytest.mark.parametrize("together,held", [(1 << 15, 1 << 18), (40, 3)])
def test_pairs_that_share_many_tokens_are_named_about_once(spark, monkeypatch, together, held):
    """Texts with a passage in common share up to 30 prefix tokens a pair but aren't similar; whatever the parts, the counts stay exact."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    monkeypatch.setattr(jaccard, "HELD_PAIRS", held)
    r = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[:260] + [f"x{i}" for _ in range(r.randint(30, 40))]) if i % 2 else " ".join(f"y{i}" if k % 29 == i % 29 else w for k, w in enumerate(base)) for i in range(40)]
    docs = odd(spark, list(enumerate(texts))).select("doc_id", "text").cache()
    published = jaccard._shared(jaccard._publish(docs, 3, 90, jaccard._frequent(docs, 3))).cache()
    lists = published.where("kind = 0").select("key", "node", "aux")
    nodes = published.where("kind = 1").select("node", F.col("node").alias("component"), "parity")
    got = jaccard._cross_pairs(lists, nodes, 90).collect()
    postings = defaultdict(dict)
    for x in lists.collect():
        postings[x.key][x.node] = x.aux
    parity = {x.node: x.parity for x in nodes.collect()}
    want = defaultdict(int)
    for held_by in postings.values():
        for a in held_by:
            for b in held_by:
                if a < b and jaccard._fits(np.array([held_by[a]]), np.array([held_by[b]]), 90)[0]:
                    p, q = jaccard._folded([parity[a], parity[b]])
                    size = sum((held_by[x] >> 8) & 0xFFFFFFFF for x in (a, b))
                    want[a, b] += int(np.bitwise_count(p ^ q).sum() * 190 <= 10 * size)
    sums = defaultdict(int)
    for x in got:
        sums[x.a, x.b] += x.m
    assert dict(sums) == {k: m for k, m in want.items() if m}
    assert max(sums.values()) >= 10
    if together > 40:
        assert len(got) <= 4 * len(sums) < sum(sums.values()) / 2


def test_words_are_counted_without_a_match_object_each(spark):
    """Counting regular-expression matches took 15 times as long as splitting; both count what `terms` gives."""
    texts = [None, "", " ", "...", "a", " a", "a ", "-a-B-", "É é", "x\x00y\x7fz", "@A[Z`a{z/0:9", "\n\nSome words, 2 numbers.\n", "漢字  x", "a" * 5000, "?" * 5000 + "Z"]
    docs = odd(spark, list(enumerate(texts)))
    counted = docs.select("text", decontamination.word_count(F.col("text")).alias("n"), F.size(decontamination.terms(F.col("text"))).alias("want"))
    assert all(x.n == x.want for x in counted.collect())
    assert {x.text: x.n for x in counted.collect()}["@A[Z`a{z/0:9"] == 6
    plan = counted.select("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan


def test_a_batch_of_short_texts_is_decoded_in_little_memory():
    rng = np.random.default_rng(3)
    many = 4
    model = languages.Model([f"l{k}" for k in range(many)], rng.normal(size=(1 << languages.GRAM_BITS, many)).astype(np.float32), np.ones((len(languages.NAMES), many), bool))
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    texts = pa.array([" ".join(rng.choice(words, 300)) for _ in range(1500)])
    model.predict(texts.slice(0, 5))
    tracemalloc.start()
    model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20, peak
