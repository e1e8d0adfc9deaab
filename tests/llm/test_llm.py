"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotweave.llm import decontamination, jaccard, languages, lengths, nearest, packing, quality, queries, recompression, repeats, suffixes, tokens, toxicity

WORD = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, doc string, kind int, row string, node string, lang string"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 7, "y", None, "en") for i, t in rows], SCHEMA).repartition(parts)


def odd_texts(seed=3, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = [r.choice("a b c d É".split()) for _ in range(r.randint(0, 60))]
        if r.random() < 0.3:
            t = ["a"] * r.randint(5, 60)
        if r.random() < 0.2:
            t = ["a", "b"] * r.randint(5, 40)
        if rows and r.random() < 0.4:
            t += (rows[r.randrange(len(rows))][1] or "").split()
        rows.append((i * 7 % (n + 3) - 20, r.choice([" ", "\n", "  "]).join(t)))
    return [*rows, (5000, None), (5001, ""), (5002, " \t"), (5003, rows[0][1]), (5004, "z " * 3000 + rows[1][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_texts())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        toxicity.toxicity(empty, labels), quality.quality(empty, labels), languages.identify(empty), packing.pack(empty),
        lengths.context_totals(lengths.length_histogram(lengths.token_lengths(empty))), recompression.deduplicate(empty), suffixes.deduplicate(empty),
        jaccard.similar_documents(empty), decontamination.contamination(empty, items), nearest.nearest(vectors),
    ):
        assert out.count() == 0


# Tokens, lengths and packing


def test_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    r = random.Random(1)
    parts = [*"aAbs'tdmre  \n\t.,!|<>()-_12é×÷çÉ…²̸́= ßΣσ漢字İ\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "n't", " ", "👍"]
    texts = [*("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)), None, ""]
    got = [ids[a:b].tolist() for _, ids, at in tokens.encoded(pa.array(texts), tokens.default_path()) for a, b in zip(at, at[1:])]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_balance_fills_sequences():
    r = np.random.default_rng(0)
    n = np.concatenate([r.integers(1, 900, 200), [5000, 2048, 1]])
    pieces = packing.balance(n, 2048, 1.0, 1 / 2048)
    assert len({p[3] for p in pieces}) == -(-int(n.sum()) // 2048)
    used = defaultdict(int)
    for _, _, length, sequence, offset in pieces:
        assert used[sequence] == offset
        used[sequence] += length
    assert max(used.values()) <= 2048
    covered = defaultdict(list)
    for d, start, length, _, _ in pieces:
        covered[d] += range(start, start + length)
    assert all(sorted(covered[d]) == list(range(n[d])) for d in range(len(n)))
    cost = defaultdict(float)
    for _, _, length, sequence, _ in pieces:
        cost[sequence] += length + length * length / 2048
    assert max(cost.values()) <= 2 * 2048 and min(cost.values()) > 0


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    seen = defaultdict(list)
    places = defaultdict(list)
    for p in packing.pack(docs, block_tokens=5000).collect():
        piece = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[p.doc_id] += range(p.start, p.start + p.length)
        places[p.sequence_id] += range(p.offset, p.offset + p.length)
    assert {d: sorted(v) for d, v in seen.items()} == {d: list(range(len(v))) for d, v in ids.items()}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 2048 for v in places.values())


def test_context_totals(spark):
    n = [0, 0, 3, 5, 5, 5, 9, 5000, 9000, None]
    rows = lengths.context_totals(lengths.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens int"))).collect()
    n = [x or 0 for x in n]
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        assert r.n_docs == n.count(r.n_tokens) and r.docs_longer == sum(x > r.n_tokens for x in n) and r.docs_within == sum(x <= r.n_tokens for x in n)
        assert r.tokens_total == sum(n) and r.tokens_truncated == sum(min(x, r.n_tokens) for x in n) and r.tokens_lost == sum(n) - r.tokens_truncated
        assert r.quantile == pytest.approx(r.docs_within / len(n))


# Repeats


def first_seen(rows, split, size):
    """Units and removed flags of each document by the plain rule."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        u = split(t or "")
        gone = [False] * len(u)
        for s in range(len(u) - size + 1):
            k = tuple(u[s : s + size])
            if k in seen:
                gone[s : s + size] = [True] * size
            seen.add(k)
        out[i] = (u, gone)
    return out


@pytest.mark.parametrize("size", [4, 8, 20])
def test_word_repeats(spark, docs, size):
    want = {}
    for i, (w, gone) in first_seen([(r.doc_id, r.text) for r in docs.collect()], lambda t: re.findall(WORD, t), size).items():
        kept = [x for x, g in zip(w, gone) if not g]
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate(docs, size=size).collect()}
    assert got == want


@pytest.mark.parametrize("size", [6, 20])
def test_byte_repeats(spark, docs, size):
    want = {}
    for i, (b, gone) in first_seen([(r.doc_id, r.text) for r in docs.collect()], lambda t: t.encode(), size).items():
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs, size=size).collect()}
    assert got == want


def test_maximal_repeats(spark):
    r = random.Random(2)
    text = {i: "".join(r.choice("ab") for _ in range(30)) for i in range(6)}
    places = defaultdict(set)
    for i, t in text.items():
        for a in range(len(t)):
            for b in range(a + 6, len(t) + 1):
                places[t[a:b]].add((i, a))
    want = {}
    for s, v in places.items():
        before = {text[i][a - 1] if a else (i, a) for i, a in v}
        after = {text[i][a + len(s)] if a + len(s) < len(text[i]) else (i, a) for i, a in v}
        if len(v) > 1 and len(before) > 1 and len(after) > 1:
            want[s] = v
    got = defaultdict(set)
    for x in suffixes.maximal_repeats(table(spark, text.items()), size=6).collect():
        got[text[x.doc_id][x.at : x.at + x.length]].add((x.doc_id, x.at))
    assert got == want


def test_maximal_repeats_beyond_the_sorted_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FURTHER", 50)
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    size, shared = 20, make(500)
    cut = size + suffixes.BEYOND
    text = {1: make(30) + shared + make(30), 2: make(40) + shared + make(9), 3: make(11) + shared[:200] + make(60), 4: make(25) + shared[:cut], 5: make(13) + shared[:cut], 6: "x" * 150, 7: make(300)}
    text[8] = text[7]
    text[9] = "z" + text[7][: 2 * cut]

    def common(x, y):
        n = 0
        while n < len(x) and n < len(y) and x[n] == y[n]:
            n += 1
        return n

    every = sorted((t[a:], i, a) for i, t in text.items() for a in range(len(t)))
    places = defaultdict(set)
    deep = [common(every[k][0], every[k - 1][0]) for k in range(1, len(every))]
    for k, n in enumerate(deep):
        if n >= size:
            lo = hi = k
            while lo and deep[lo - 1] >= n:
                lo -= 1
            while hi + 1 < len(deep) and deep[hi + 1] >= n:
                hi += 1
            places[every[k][0][:n]] = {x[1:] for x in every[lo : hi + 2]}
    want = {s: v for s, v in places.items() if len({text[i][a - 1] if a else (i, a) for i, a in v}) > 1}
    assert max(map(len, want)) >= 500 and any(len(s) == cut for s in want)
    got, firsts = defaultdict(set), defaultdict(set)
    rows = suffixes.maximal_repeats(table(spark, [*text.items(), (1, text[1])]), size=size).collect()
    for x in rows:
        got[text[x.doc_id][x.at : x.at + x.length]].add((x.doc_id, x.at))
        firsts[text[x.doc_id][x.at : x.at + x.length]].add((x.first_doc, x.first_at))
    assert got == want and len(rows) == sum(map(len, want.values())) and all(firsts[s] == {min(v)} for s, v in want.items())


def test_equal_spans_hold_equal_symbols():
    r = random.Random(5)
    names = np.array([r.randrange(3) for _ in range(4000)], np.uint64)
    name, start, end, low, high = recompression.recompress(names, np.array([0, 1500, 1500, 4000]))
    assert (np.diff(start) > 0).all() and (start[1:] == end[:-1]).all() and (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
    held = {}
    for m, s, e, a, b in zip(name, start, end, low, high):
        if 0 <= a and b <= 4000 and not (a < 1500 < b):
            here = (tuple(names[a:b]), s - a)
            assert held.setdefault(here, (m, e - s)) == (m, e - s)
    spans = {(tuple(names[a:b])): 0 for a, b in zip(low, high)}
    assert len(spans) < len(low)


def test_rows_that_share_an_id_are_parts(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = [(1, t), (1, t), (2, t), (2, "other words"), (None, t)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in recompression.deduplicate(table(spark, rows)).collect())
    assert got == [(0, 30, 0), (1, 30, 30), (1, 30, 30), (2, 2, 0), (2, 30, 30)]
    assert repeats.prepared(table(spark, rows), "doc_id", "text").where("part > 0").count() == 1


# Similar documents


def linked(rows, n, percent):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = re.findall(WORD, (t or "").translate(LOW))
        sets[k] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k in sets:
        i = rows[k][0]
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if i is not None or least.get(find(k)) is not None else None
    return sorted((i if i is not None else -1, len(sets[k]), least[find(k)] if least[find(k)] is not None else -1) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("counted,cells", [(50, 1 << 14), (1_000_000, 1 << 20)])
def test_frequencies_are_exact(spark, monkeypatch, counted, cells):
    """Counts of n-grams and words don't depend on the parts in which they are counted, nor on how cells are shared."""
    monkeypatch.setattr(jaccard, "COUNTED_WORDS", counted)
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rows = [(i, t) for i, t in odd_texts() if t]
    docs, by_word = defaultdict(int), defaultdict(int)
    for _, t in rows:
        w = re.findall(WORD, t.translate(LOW))
        for x in w:
            by_word[x] += 1
        for g in {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, min(len(w), 1)))}:
            docs[g] += 1
    d = table(spark, rows, 5).select("doc_id", "text")
    grams, gram_n, common, word_n, n_words = jaccard._frequent(d, 3)
    assert sorted(gram_n.tolist()) == sorted(x for x in docs.values() if x >= 2)
    assert sorted(word_n.tolist()) == sorted(by_word.values()) and n_words == sum(by_word.values())
    assert len(set(grams.tolist())) == len(grams) and len(set(common.tolist())) == len(common)


@pytest.mark.parametrize("n,percent,block", [(3, 90, 512), (5, 80, 4)])
def test_similar_documents(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(5)
    words, rows = [f"W{k}" for k in range(60)], []
    for i in range(220):
        x = r.random()
        t = [r.choice(words) for _ in range(r.randint(0, 4) if x < 0.15 else r.randint(3, 90))]
        if 0.15 <= x < 0.65 and rows:
            t = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 3)):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
        rows.append((i * 7 % 223, " ".join(t)))
    rows += [(5000, None), (5001, " \t"), (None, rows[5][1]), (3, rows[5][1].lower())]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard.similar_documents(table(spark, rows), n=n, percent=percent).collect())
    assert got == linked(rows, n, percent)
    kept = jaccard.keep_one(table(spark, rows), n=n, percent=percent)
    assert {x.doc_id for x in kept.collect()} == {c for _, _, c in got}


def test_one_row_of_each_group_stays(spark):
    near = [" ".join(f"{x}{k}" for k in range(60)) for x in "pqrstu"]
    p, q, r, s, t, u = near
    rows = [
        (None, p), (1, p + " more"), (None, q), (None, r), (None, r + " more"),  # a copy of 1; linked to nothing; two near copies without an id
        (2, s), (7, s + " more"), (7, t), (3, u), (3, u), (3, u), (8, u + " more"),  # another text of an id that goes; rows that repeat the smallest id
        (9, None), (9, ""), (None, " "),  # no n-grams
    ]
    kept = jaccard.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    r_of = [x for x in got if x[0] is None and x[1] in (r, r + " more")]
    assert len(r_of) == 1
    want = [(1, p + " more"), (None, q), (2, s), (7, t), (3, u), (9, None), (9, ""), (None, " ")]
    assert sorted(map(repr, got)) == sorted(map(repr, want + r_of))
    assert all(x.kind == 7 and x.lang == "en" and x.node is None for x in kept.collect())


def test_large_group_of_near_copies_is_not_paired_off(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(i % 4):
            t[r.randrange(len(t))] = f"x{i}{r.random()}"
        rows.append((i, " ".join(t)))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similar_documents(table(spark, rows)).collect())
    assert got == linked(rows, 3, 90)


# Decontamination


def test_contamination(spark):
    r = random.Random(4)
    word = lambda: r.choice([f"t{k}" for k in range(40)])
    items = [(i, " ".join(word() for _ in range(r.randint(1, 25)))) for i in range(30)] + [(77, None), (78, "..!"), (79, "t1"), (9, "T1, t2")]
    rows = []
    for i in range(80):
        t = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            t += (r.choice(items)[1] or "").upper().replace(" ", "-- ").split(" ")
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "é t1 ?"), (3, rows[7][1]), (None, rows[7][1])]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if w]
    want = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, p in items:
            p = split(p)
            for s in range(max(len(p) - 9, 1) if p else 0):
                q = p[s : s + 10]
                for a in range(len(w) - len(q) + 1):
                    if w[a : a + len(q)] == q:
                        hit.update(range(a, a + len(q)))
                        ids.add(str(item))
        want.append((i if i is not None else -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contamination(table(spark, rows), bench)
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == sorted(want)
    clean = decontamination.decontaminate(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns and clean.count() == sum(not x[5] for x in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_an_id_hit(spark):
    import duckdb

    long = " ".join(f"w{k}" for k in range(14))
    items = spark.createDataFrame([(None, long), (None, "x1 x2"), (None, None), (None, "..!"), (4, "y1 y2 y3"), (5, "x2")], "item_id long, text string")
    docs = table(spark, [(1, "a b " + long), (2, "x1 x2 y1 y2 y3"), (3, "x1 y1 y2"), (4, "y1 y2 y3"), (5, None), (6, "x1 x2 " + long)])
    got = decontamination.contamination(docs, items)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    want = con.sql(queries.OP8_SQL).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [r.doc_id for r in got.where("contaminated").orderBy("doc_id").collect()] == [1, 2, 4, 6]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).collect()) == [3, 5]


def test_proximity(spark):
    docs = table(spark, [(1, "a x c b y"), (2, "a b c"), (3, "a x x x x x x x x b c")])
    phrases = spark.createDataFrame([(5, ["a", "b", "c"])], "no long, phrase array<string>")
    got = decontamination.proximity_matches(decontamination.positional_index(docs), phrases, slop=2).collect()
    assert {(r.doc_id, r.no, r.pos) for r in got} == {(1, 5, 0), (2, 5, 0)}


# Nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 32)).astype(np.float32)
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 32), (1200, [float("nan")] * 32), (1300, [None, *[1.0] * 31]), (1400, []), (None, x[0].tolist())]
    vectors = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(3)
    got = defaultdict(list)
    for q in nearest.nearest(vectors).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert sorted(got) == list(range(0, 700, 100))
    right = 0
    for q, near in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        right += len({v for v, _ in near} & set(want))
        assert all(abs(d[v] - s) < 1e-9 for v, s in near)
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
    assert right >= 0.95 * 10 * len(got)


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((3000, 48)), r.standard_normal((20, 48))
    model = nearest.Rotation(x.mean(0), np.linalg.qr(r.standard_normal((48, 48)))[0])
    low = model.lower(*model.encode(x), q)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (low <= true + 1e-6).mean() > 0.995 and np.corrcoef(low.ravel(), true.ravel())[0, 1] > 0.7


# Classifiers and languages


def test_identity_swaps_lower_the_gap(spark):
    r = random.Random(0)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        t = [r.choice([f"w{k}" for k in range(80)]) for _ in range(20)] + ["vile"] * bad
        if r.random() < (0.6 if bad else 0.1):
            t.append("women")
        if r.random() < 0.1:
            t.append("men")
        r.shuffle(t)
        rows.append((int(bad), " ".join(t)))
    x = list(zip([y for y, _ in rows], toxicity.presence(pa.array([t for _, t in rows]))))
    share = {1: 1 / 3, 0: 2 / 3}
    gap = {}
    for swap in (0.0, 50.0):
        m = toxicity.fit(x, share, swap=swap)
        a, b, v = m.score(pa.array(["w1 women", "w1 men", "w1 vile"]))
        gap[swap] = abs(a - b)
        assert v > 0.8
    assert gap[50.0] < 0.2 * gap[0.0] + 1e-3


@pytest.mark.parametrize("name,label,least", [("op1_counterfactual_toxicity", "toxic", 0.97), ("op6_factorisation_quality", "quality", 0.95), ("op5_script_viterbi", "lang", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{d}/documents.parquet" if label == "lang" else f"{d}/labels.parquet").select("doc_id", label)
    out = queries.QUERIES[name](spark, d)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    got = out.where("held_out").join(truth, "doc_id")
    found = F.col("lang_pred" if label == "lang" else "predicted") == F.col(label)
    assert got.agg(F.avg(found.cast("int"))).first()[0] >= least


def test_factorisation_identity():
    r = np.random.default_rng(2)
    size = (1 << quality.WORD_BITS) + len(quality.STATISTICS) * quality.BINS
    m = quality.Model(0.3, r.standard_normal(size), r.standard_normal((size, 4)), np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    f, x = np.array([5, 900, 70]), np.array([0.5, 1.0, -2.0])
    got, _ = m.margin(np.zeros(3, int), f, x, 1)
    pairs = sum(m.v[f[a]] @ m.v[f[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert got[0] == pytest.approx(0.3 + m.w[f] @ x + pairs)


def test_scores_of_odd_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (41, None, None)], "doc_id long, toxic int, quality int")
    for f in (toxicity.toxicity, quality.quality):
        rows = f(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        none = f(docs, labels.where("false")).collect()
        assert len(none) == len(rows) and all(0 <= r.score <= 1 for r in none)


def test_viterbi_is_the_best_path(monkeypatch):
    monkeypatch.setattr(languages, "BLOCK", 7)
    r = np.random.default_rng(0)
    m = languages.Model(["a", "b", "c"], None, None, penalty=1.5)
    for _ in range(40):
        n = r.integers(0, 30, 5)
        first = np.concatenate([[0], np.cumsum(n)])
        s = r.normal(size=(first[-1], 3)).astype("f4")
        label = m.decode(s, first)
        for a, b in zip(first, first[1:]):
            if a < b:
                v = s[a].astype(float)
                for t in range(a + 1, b):
                    v = (v[:, None] - 1.5 * (1 - np.eye(3))).max(0) + s[t]
                got = sum(s[t, label[t]] for t in range(a, b)) - 1.5 * sum(label[t] != label[t - 1] for t in range(a + 1, b))
                assert abs(got - v.max()) < 1e-3


def test_spans_scripts_and_und(spark):
    en, ru, el = "the cat sat on the mat and saw the rat", "кошка сидела на коврике и видела крысу", "η γάτα κάθισε στο χαλί και είδε"
    rows = [(i, [en, ru, el][i % 3], ["en", "ru", "el"][i % 3]) for i in range(30)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["el", "en", "ru"]
    asked = table(spark, [(1, en + " " + ru), (2, "12 … 34"), (3, None), (4, ""), (5, el), (None, ru)], 1)
    spans = sorted((r.doc_id, r.first_byte, r.end_byte, r.lang) for r in languages.language_spans(asked.where("doc_id = 1"), model).collect())
    assert [s[3] for s in spans] == ["en", "ru"] and spans[0][2] == len(en) and spans[1][2] == len((en + " " + ru).encode())
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict_languages(asked, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[5] == ("el", 1.0) and got[None] == ("ru", 1.0)
    assert {r.doc_id for r in languages.keep_identified(asked, model).collect()} == {1, 5, None}


def test_leading_marks_and_mixed_words_keep_their_script(spark):
    en, zh, ja = "the cat sat on the mat and saw the rat", "我们今天去北京看长城和故宫", "わたしはきょうとうきょうへいきます"
    rows = [(i, [en, zh, ja][i % 3], ["en", "zh", "ja"][i % 3]) for i in range(30)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = {1: ("\u300c" + zh + "\u300d", "zh"), 2: ("\u300e" + ja, "ja"), 3: ("\u201cthe\u201d \u00abcat\u00bb \u00bfsat", "en"), 4: ("\U0001f600" + zh, "zh"), 5: ("NHK" + ja, "ja"), 6: ("\U00020000\U00020001" + zh, "zh"), 7: ("\u2014" + ja + "\u2026", "ja")}
    docs = table(spark, [(i, t) for i, (t, _) in asked.items()] + [(8, "\u300c\u300d \U0001f600"), (9, "e\u0301t"), (10, "\u0301 12")], 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict_languages(docs, model).collect()}
    assert all(got[i] == (lang, 1.0) for i, (_, lang) in asked.items())
    assert got[8] == got[10] == ("und", 0.0) and got[9][1] == 1.0
    spans = [(r.first_byte, r.end_byte, r.lang) for r in languages.language_spans(docs.where("doc_id = 1"), model).collect()]
    assert spans == [(3, 3 + len(zh.encode()), "zh")]


def test_mixed_and_unlearned_texts_stay(spark):
    en, ru, el = "the cat sat on the mat and saw the rat", "кошка сидела на коврике и видела крысу", "η γάτα κάθισε στο χαλί και είδε"
    rows = [(i, [en, ru, el][i % 3], ["en", "ru", "el"][i % 3]) for i in range(30)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = table(spark, [(1, " ".join([en, ru[:37], el])), (2, "12 … 34"), (3, None), (4, ""), (5, ru), (None, en), (5, ru)], 1)
    mixed = languages.predict_languages(asked.where("doc_id = 1"), model).first()
    assert 0 < mixed.score < 0.5
    unlearned = languages.fit(asked.withColumn("lang", F.lit(None).cast("string")))
    assert unlearned.languages == []
    for m in (model, unlearned):
        kept = languages.keep_identified(asked, m)
        assert kept.columns == asked.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5, 5]


def test_nearest_in_blocks_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MOST_QUERIES", 3)
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 70))
    ids = [*range(0, 3000, 20), *[500] * 100, *range(100_001, 100_051)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for q in nearest.nearest(vectors, k=7).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert sorted(got) == sorted({i for i in ids if i % 100 == 0}) and all(len(v) == 7 for v in got.values())
    ids, right = np.array(ids), 0
    for q, near in got.items():
        want = []
        for own in x[ids == q]:
            d = np.sqrt(((x - own) ** 2).sum(1))
            d[ids == q] = np.inf
            order = np.lexsort((ids, d))[:7]
            want.append([(int(ids[i]), round(float(d[i]), 9)) for i in order])
        assert q not in {i for i, _ in near}
        right += max(len(set(w) & {(i, round(s, 9)) for i, s in near}) for w in want)
    assert right >= 0.95 * 7 * len(got)


@pytest.mark.parametrize("bits", [1 << 25, 64, 1])
def test_map_of_documents_loses_none(spark, monkeypatch, bits):
    monkeypatch.setattr(decontamination, "MAP_BITS", bits)
    docs = spark.range(3000).select(F.when(F.col("id") < 2999, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("_k"))
    found = docs.where("doc_id % 50 = 0 or doc_id is null").select(F.col("doc_id").alias("_id"), F.col("_k").alias("_key"))
    got = decontamination._may_match(docs, found)
    assert got.count() == 3000 and got.where("_may and (doc_id % 50 = 0 or doc_id is null)").count() == 61
    others = got.where("_may").count() - 61
    assert others == 0 if bits > 3000 else others > 0
    none = decontamination._may_match(docs, found.where("false"))
    assert none.where("_may").count() == 0


def test_phrases_and_proximity_from_a_stored_index(spark, tmp_path):
    docs = table(spark, [(1, "A x c b y"), (2, "a b c"), (3, "a x x x x x x x x b c"), (4, None), (None, "zz a b c")])
    decontamination.positional_index(docs).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    items = decontamination.test_items(spark.createDataFrame([(7, "a b c")], "item_id long, text string"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    found = decontamination.aligned(index, decontamination.rarest_terms(decontamination.windows(items), counts), items)
    assert {(r.doc_id, r.start) for r in found.collect()} == {(2, 0), (None, 1)}
    phrases = spark.createDataFrame([(5, ["a", "b", "c"])], "no long, phrase array<string>")
    assert {(r.doc_id, r.pos) for r in decontamination.proximity_matches(index, phrases, slop=2).collect()} == {(1, 0), (2, 0), (None, 1)}
