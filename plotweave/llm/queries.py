"""The subpackage's queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, languages, lengths, nearest, packing, quality, recompression, suffixes, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_totals(lengths.length_histogram(lengths.token_lengths(_read(spark, sf_dir, "documents"))))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicate(_read(spark, sf_dir, "documents")).drop("kept_text")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM t
), gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE r > 1) GROUP BY doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS k, count(*) AS n
  FROM words LEFT JOIN (SELECT doc_id, unnest(g) AS i FROM gone) x ON words.doc_id = x.doc_id AND words.i = x.i WHERE x.i IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op4_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents")).drop("kept")


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), t AS (SELECT doc_id, s, substr(h, 2 * s - 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS s FROM d WHERE len(h) >= 200)
), f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM t
), m AS (SELECT doc_id, s, CASE WHEN s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS opens FROM f WHERE r > 1
), n AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM m
), spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 99 AS b FROM n GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
  UNION ALL SELECT d.doc_id, len(h) // 2 + 1 AS a, coalesce(max(b), 0) AS before FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id, h
), kept AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS k FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY gaps.doc_id
), sums AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id
"""


def op5_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_read(spark, sf_dir, "documents"))


def op6_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT rowid AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), places AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, s, win.n, item_id FROM places JOIN win ON places.p = win.p AND places.n = win.n
), words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM hits) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op9_rotated_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_counterfactual_toxicity, op2_token_lengths, op3_recompression, op4_interval_tree, op5_script_viterbi, op6_factorisation_quality, op7_adaptive_prefix_join, op8_positional_index, op9_rotated_one_bit_codes, op10_cost_balanced_packing)}
ORACLE_SQL = {"op3_recompression": OP3_SQL, "op4_interval_tree": OP4_SQL, "op7_adaptive_prefix_join": OP7_SQL, "op8_positional_index": OP8_SQL, "op9_rotated_one_bit_codes": OP9_SQL}
