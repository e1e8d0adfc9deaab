"""The corpus pipeline: stages over the documents table, each over all that the one before has kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotweave.llm import decontamination, jaccard, languages, packing, recompression
from plotweave.llm._store import cut


#: Rows that go to a Python worker at a time: some MB of texts, where Spark's default of 10,000 rows is some ten times that.
BATCH_ROWS = 2000


def _stage(run):
    """Has the session hand texts to Python in small batches before the stage is planned; results don't depend on it."""

    @functools.wraps(run)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if int(spark.conf.get(key)) > BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return run(spark, docs, sf_dir)

    return bounded


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no span of any language is found; if no row has a language to learn from, only texts without letters."""
    return languages.keep_identified(docs, languages.fit(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: sets of five-word shingles, Jaccard of 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that also stand earlier; a document that has nothing else goes.

    A cut text's words are joined by spaces, so its line breaks go too; other texts stay as they
    are. n_chars, where there is such a column, follows the text. Null texts stay.
    """
    none = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = recompression.deduplicate(docs.withColumn(none, F.isnull("text")), carry=(*others, none))
    kept = kept.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    columns = {c: F.col("row")[c] for c in others}
    columns["doc_id"] = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    columns["text"] = F.when(~F.col("row")[none], F.col("kept_text"))
    if "n_chars" in others:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and no Viterbi decoding; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
