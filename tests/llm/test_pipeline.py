"""The pipeline's stages, each by a plain rule on what the one before has kept."""

import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from plotweave.llm import queries

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns
    before, after = seen["language identification"]
    assert after.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
    before, after = seen["n-gram Jaccard join"]
    kept = {r.doc_id for r in after.collect()}
    sets = {}
    for r in before.collect():
        w = re.findall(WORD, r.text.lower())
        sets[r.doc_id] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    group = {d: d for d in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    assert kept == set(group.values())
    before, after = seen["substring dedup"]
    earlier, want = set(), {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        w = re.findall(WORD, r.text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in earlier:
                gone[s : s + 20] = [True] * 20
            earlier.add(g)
        if not any(gone):
            want[r.doc_id] = r.text
        elif not all(gone):
            want[r.doc_id] = " ".join(x for x, g in zip(w, gone) if not g)
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count()
    before, after = seen["benchmark decontamination"]
    before.createOrReplaceTempView("before")
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DIR}/benchmark.parquet'")
    clean = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.OP8_SQL}) WHERE NOT contaminated").fetchall()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = seen["packing"]
    totals = {r["doc_id"]: (r["n"], r["t"]) for r in after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()}
    assert set(totals) == {r.doc_id for r in before.collect()} and all(n == t for n, t in totals.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    want = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
