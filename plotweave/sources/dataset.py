"""Datasets: clustered Parquet with bounds columns, and a manifest beside it."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..errors import FeatureCountMismatch, StorageError
from ..functions import bounds, geometry
from ..operators import layout, rtree, select
from ..operators.shared import stored

PAGE_BYTES = 64 * 1024
#: Places that a stored search reads needlessly rather than part two ranges.
GAP = 4096
_MANIFEST = "is_compressed boolean, page_count long, feature_count long, page_bytes long, min_lng int, min_lat int, max_lng int, max_lat int"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Dataset:
    """A stored dataset; queries are DataFrames and can be run again and again."""

    spark: SparkSession
    path: str

    @property
    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features")

    @property
    def header(self) -> DataFrame:
        """One row: is_compressed, page_count, feature_count, page_bytes and the extent."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def select_all(self, ordered: bool = False) -> DataFrame:
        return select.select_all(self.features, ordered)

    def select_bbox(self, box: bounds.Box, ordered: bool = False) -> DataFrame:
        return select.select_bbox(self.features, box, ordered)

    def search(self, box: bounds.Box) -> DataFrame:
        """`select_bbox` by way of the stored tree: its hits on the lowest inner level, as merged ranges of places, reach the scan's filters too."""
        tree = self.spark.read.parquet(f"{self.path}/nodes")
        lowest = tree.agg(F.min("level").alias("m")).first()["m"]
        if lowest is None:
            return self.select_bbox(box)
        ranges = rtree.merged_ranges(rtree.descend(tree, box, lowest), rtree.FANOUT**lowest, GAP)
        log.info("box %s: %d ranges of places", box, len(ranges))
        within = F.lit(False)
        for a, z in ranges:
            within = within | ((F.col("pos") >= a) & (F.col("pos") < z))
        return self.select_bbox(box).where(within)

    def cursor(self, box: bounds.Box | None = None) -> Iterator[Row]:
        """Features one by one in stored order, a partition at a time, the next one fetched ahead; stop whenever you like."""
        found = self.features if box is None else self.search(box)
        yield from found.orderBy("pos").toLocalIterator(prefetchPartitions=True)

    def pages(self) -> DataFrame:
        """Per page: page_id, bounds, feature_count, bytes (estimated as pages were assigned)."""
        return layout.page_stats(self.features, "bytes")

    def describe(self) -> DataFrame:
        """One row: counts, sizes of the header and of the packed index, and bytes stored."""
        h = self.header.first()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/features")
        kept = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        row = (h["feature_count"], h["page_count"], h["is_compressed"], 17, rtree.index_bytes(h["feature_count"]), int(kept))
        return self.spark.createDataFrame([row], "feature_count long, page_count long, is_compressed boolean, header_bytes long, index_bytes long, feature_bytes long")


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    """Raises StorageError where no manifest is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise StorageError(f"no dataset at {path}")
    return Dataset(spark, path)


def feature_bytes(features: DataFrame) -> Column:
    """About what a feature takes in a page: 8 bytes of length, 12 for each part, 8 for each point, and its properties' keys and values as text."""
    size = F.lit(8) + geometry.point_count(F.col("geom")) * 8 + F.size("geom") * 12
    if "properties" in features.columns:
        size = size + F.aggregate("properties", F.lit(8), lambda n, p: n + F.octet_length(p["key"]) + F.coalesce(F.octet_length(F.to_json(p["value"])), F.lit(0)) + 12)
    return F.coalesce(size, F.lit(8)).cast("long")


def write_manifest(spark: SparkSession, path: str, compressed: bool = True, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Counts, pages and extent of the features under `path` as they are now, by one aggregation; replaces the manifest."""
    f = spark.read.parquet(f"{path}/features")
    pages = [F.count_distinct("page_id").alias("p")] if "page_id" in f.columns else [F.ceil(F.sum(feature_bytes(f)) / page_bytes).alias("p")]
    r = f.agg(F.count(F.lit(1)).alias("n"), *bounds.total(), *pages).first()
    row = (compressed, max(r["p"] or 0, 1), r["n"], page_bytes, *(r[c] for c in bounds.NAMES))
    out = spark.createDataFrame([row], _MANIFEST)
    out.write.mode("overwrite").parquet(f"{path}/manifest")
    return out


def write_clustered(features: DataFrame, path: str, compressed: bool = True, page_bytes: int = PAGE_BYTES, rows_per_file: int = 5_000_000, partitions: int | None = None, announced: int | None = None) -> Dataset:
    """Writes features (feature_id, geom, properties, bounds, ...) in stored order, with their places and pages, the tree above them and a manifest.

    The source is read once: its rows are stored first, so ids that a reader makes stay what they
    are. Rows are range-partitioned by place on the curve and sorted, so the bounds'
    minima and maxima of each Parquet page and row group are narrow and a box query
    skips the others. `page_bytes` is the pages' goal and sets Parquet's page size. An empty
    dataset is written too; a count other than `announced` is an error.
    """
    spark = features.sparkSession
    rows = stored(features)
    count = rows.count()
    if announced is not None and announced != count:
        raise FeatureCountMismatch(f"{announced} features were announced, {count} came")
    placed = layout.ranked(layout.with_hilbert(rows), partitions)
    placed = layout.pages(placed.withColumn("bytes", feature_bytes(placed)), "bytes", page_bytes, exact=True)
    dealt = placed.repartitionByRange(partitions, "pos") if partitions else placed.repartitionByRange("pos")
    writer = dealt.sortWithinPartitions("pos").write.mode("overwrite").option("compression", "zstd" if compressed else "uncompressed")
    writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", 2000).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/features")
    written = spark.read.parquet(f"{path}/features")
    rtree.nodes(written, count, min(1, max(len(rtree.nodes_per_level(count)) - 1, 0))).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    write_manifest(spark, path, compressed, page_bytes)
    log.info("%d features written to %s", count, path)
    return Dataset(spark, path)
