"""Clustering along the Hilbert curve, and pages of a bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import bounds, hilbert
from .shared import folder, stored


def _kept(frame: DataFrame) -> DataFrame:
    """The rows cut loose from their plan, in the partitions and the order that they are in."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return frame.checkpoint()


def extent(features: DataFrame) -> bounds.Box | None:
    """The bounds of all features (one aggregate row); None if all are empty."""
    row = features.agg(*bounds.total()).first()
    return None if row["min_lng"] is None else bounds.Box(*(row[n] for n in bounds.NAMES))


def with_hilbert(features: DataFrame, box: bounds.Box | None = None) -> DataFrame:
    """Adds `hilbert`: the curve's distance at the centre of each feature's bounds, scaled to the dataset's extent.

    NULL for empty geometries; an axis without size counts as 0.
    """
    box = box or extent(features)
    if box is None:
        return features.withColumn("hilbert", F.lit(None).cast("long"))
    lng, lat = bounds.center()
    x = hilbert.cell(lng, F.lit(box.min_lng), F.lit(box.max_lng - box.min_lng).cast("long"))
    y = hilbert.cell(lat, F.lit(box.min_lat), F.lit(box.max_lat - box.min_lat).cast("long"))
    return features.withColumn("hilbert", hilbert.distance(x, y))


def order() -> list:
    """Stored order: along the curve from its end, empty geometries last, insertion order among equals."""
    return [F.col("hilbert").desc_nulls_last(), F.col("feature_id")]


def clustered(features: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted in stored order: one shuffle, no global sort in one task."""
    by = features.repartitionByRange(partitions, *order()) if partitions else features.repartitionByRange(*order())
    return by.sortWithinPartitions(*order())


def ranked(features: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds `pos`, each row's place in stored order from 0.

    Rows are numbered within range partitions and moved by the rows before them; only
    one count per partition reaches the driver.
    """
    numbered = stored(clustered(features, partitions).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    counts = {r["_p"]: r["n"] for r in numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    moved = _before(numbered, counts, "_p", "_before")
    return numbered.join(F.broadcast(moved), "_p").withColumn("pos", F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i", "_p", "_before")


def _before(frame: DataFrame, sums: dict[int, int], part: str, name: str) -> DataFrame:
    """(part, name): the sum over the parts before each; one row for each partition."""
    rows, total = [], 0
    for p in sorted(sums):
        rows.append((p, total))
        total += sums[p]
    return frame.sparkSession.createDataFrame(rows, f"{part} int, {name} long")


def pages_fixed(positioned: DataFrame, size: int, goal: int) -> DataFrame:
    """Adds `page_id` where every feature takes `size` bytes: a page closes once it holds more than `goal`."""
    return positioned.withColumn("page_id", F.call_function("div", F.col("pos"), F.lit(goal // size + 1).cast("long")))


def _filled(size: np.ndarray, held: int, goal: int) -> tuple[np.ndarray, int, int]:
    """Page of each row, from 0; pages closed; bytes held at the end, with `held` bytes at the start."""
    sums = held + np.cumsum(size)
    ends, base = [], 0
    while (k := int(np.searchsorted(sums, base + goal, "right"))) < len(sums):
        ends.append(k + 1)
        base = int(sums[k])
    return np.searchsorted(np.array(ends, np.int64), np.arange(len(size)), "right"), len(ends), int(sums[-1]) - base if len(size) else held


def pages(positioned: DataFrame, size_col: str, goal: int, exact: bool = False) -> DataFrame:
    """Adds `page_id`: rows in stored order fill a page until it holds more than `goal` bytes.

    Range partitions are filled side by side, over places and sizes only. Without
    `exact` each begins a page. With it pages run on across partitions, so the result
    doesn't depend on them: each partition is filled again with what the one before
    leaves open, until no partition's end changes. As a page's end soon falls where it fell before,
    that mostly takes two or three rounds; sizes that are all equal may take as many as there
    are partitions, and have pages_fixed.
    """
    sizes = positioned.select("pos", F.col(size_col).cast("long").alias("_s")).repartitionByRange("pos").sortWithinPartitions("pos")
    sizes = _kept(sizes.withColumn("_part", F.spark_partition_id()))

    def filled(entry: dict[int, int], rows: bool):
        def run(batches):
            held, closed, part = None, 0, None
            for b in batches:
                if not b.num_rows:
                    continue
                if part is None:
                    part = b.column(2)[0].as_py()
                    held = entry.get(part, 0)
                page, n, held = _filled(b.column(1).to_numpy(), held, goal)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(page + closed), b.column(2)], names=["pos", "_page", "_part"])
                closed += n
            if part is not None and not rows:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([closed], pa.int64()), pa.array([held], pa.int64())], names=["_part", "closed", "held"])

        return run

    entry: dict[int, int] = {}
    while True:
        ends = sorted((r["_part"], r["closed"], r["held"]) for r in sizes.mapInArrow(filled(entry, False), "_part int, closed long, held long").collect())
        after = {p: held for (p, *_), (_, _, held) in zip(ends[1:], ends)} if exact else {}
        if after == entry:
            break
        entry = after
    # without `exact` what a partition leaves open is a page of its own
    base = _before(positioned, {p: closed + (not exact and held > 0) for p, closed, held in ends}, "_part", "_base")
    ids = sizes.mapInArrow(filled(entry, True), "pos long, _page long, _part int").join(F.broadcast(base), "_part")
    return positioned.join(ids.select("pos", (F.col("_page") + F.col("_base")).alias("page_id")), "pos")


def page_stats(paged: DataFrame, size_col: str | None = None) -> DataFrame:
    """Per page: bounds, feature_count and, with `size_col`, its bytes."""
    size = [] if size_col is None else [F.sum(size_col).alias("bytes")]
    return paged.groupBy("page_id").agg(*bounds.total(), F.count(F.lit(1)).alias("feature_count"), *size)


def sums_before(frame: DataFrame, order_col: str, value_col: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value_col` over all rows before, by `order_col` (unique).

    Sums run within range partitions, and one sum for each partition reaches the driver.
    """
    dealt = stored(frame.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: int(r["s"] or 0) for r in dealt.groupBy("_part").agg(F.sum(value_col).alias("s")).collect()}
    own = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(_before(frame, sums, "_part", "_before")), "_part").withColumn(name, F.col("_before") + F.coalesce(F.sum(value_col).over(own), F.lit(0))).drop("_part", "_before")


def addresses(paged: DataFrame, size_col: str, header: int = 12) -> DataFrame:
    """Adds page_starting_offset and feature_offset: encoded bytes of earlier pages with their headers, and bytes before a feature in its page."""
    within = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums_before(page_stats(paged, size_col).select("page_id", (F.col("bytes") + header).alias("_b")), "page_id", "_b", "page_starting_offset")
    return paged.join(starts.select("page_id", "page_starting_offset"), "page_id").withColumn("feature_offset", F.coalesce(F.sum(size_col).over(within), F.lit(0)))
