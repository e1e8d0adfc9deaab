"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tables-")


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only on one machine may it be unset: a temporary folder stands in."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_folder()).rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The rows as a compressed table, cut loose from their plan."""
    spark = frame.sparkSession
    at = path(spark, "rows")
    frame.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(frame.schema).parquet(at)
