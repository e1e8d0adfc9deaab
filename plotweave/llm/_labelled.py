"""Bounded samples of labelled documents, and which documents are held out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._worker import lean


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text leaves `rest`; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def class_samples(labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """Up to `most` ids of each class, by order of a hash of the id, and each class's share of all labelled ids.

    An id that is labelled twice counts as its larger label; null ids and labels other than 0 and 1 are left out.
    """
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values()) or 1
    rows = [r for y in (0, 1) for r in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()]
    spark = labels.sparkSession
    kind = labels.schema[id_col].dataType.simpleString()
    return spark.createDataFrame([(r["_id"], r["_y"]) for r in rows], f"_id {kind}, _y int"), {y: n / total for y, n in share.items()}


def sampled_features(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, make: Callable[[pa.Array], list[bytes]]) -> list[tuple[int, bytes]]:
    """(label, features) of the sampled documents, one for each id (of several texts the one with the least hash).

    `sample` is bounded by class_samples, and so are its broadcast and what is collected.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(make(b.column(2)), pa.binary())], names=["_id", "_y", "x"])

    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).where("_id is not null")
    d = d.join(F.broadcast(sample), "_id").withColumn("_text", F.coalesce("_text", F.lit("")))
    # an id's text is settled before rows reach the driver: one for each sampled id, however often the id repeats
    d = d.groupBy("_id").agg(F.first("_y").alias("_y"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    got = d.select("_id", "_y", "_text").mapInArrow(lean(run), f"_id {id_type}, _y int, x binary")
    return [(r["_y"], bytes(r["x"])) for r in sorted(got.collect(), key=lambda r: r["_id"])]


def scored(docs: DataFrame, id_col: str, text_col: str, score: Callable[[pa.Array], "object"]) -> DataFrame:
    """doc_id and score for every row, in one narrow pass over id and text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double")
