"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import folder


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written as a compressed table to the shared folder and read again.

    A lost executor costs at most the tasks since the last table. The rows' size
    is known from then on, which also tells the optimizer how to join them.
    """
    spark = frame.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Removes the table behind a frame made by `cut`, once a later table holds all that is needed of it."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if at.getName().startswith("table-"):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing reads any more, now that a table stands in for them.

    It drops them when the driver's garbage collector meets their plans, which on
    a roomy driver may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
