"""Geometry for the test tables, by integer formulas that any engine computes alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry, properties


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lng_of(key: str) -> Column:
    return F.expr(f"cast(({key} * 2654435761) % 3600000001 - 1800000000 as int)")


def lat_of(key: str) -> Column:
    return F.expr(f"cast(({key} * 1597334677) % 1800000001 - 900000000 as int)")


def with_bounds(frame: DataFrame) -> DataFrame:
    return frame.select("*", *geometry.bounds(F.col("geom")))


def _point(lng: str = "lng", lat: str = "lat") -> Column:
    return F.struct(F.col(lng).cast("int").alias("lng"), F.col(lat).cast("int").alias("lat"))


def pt_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("*", lng_of("c_custkey").alias("lng"), lat_of("c_custkey").alias("lat"))
    props = properties.of(
        properties.entry("c_name", F.col("c_name"), "string"),
        properties.entry("c_nationkey", F.col("c_nationkey"), "int32"),
        properties.entry("c_acctbal", F.col("c_acctbal"), "float64"),
        properties.entry("c_mktsegment", F.col("c_mktsegment"), "string"),
    )
    return c.select(F.col("c_custkey").alias("feature_id"), geometry.point(_point()).alias("geom"), props.alias("properties"), *(F.col(v).alias(n) for v, n in (("lng", "min_lng"), ("lat", "min_lat"), ("lng", "max_lng"), ("lat", "max_lat"))))


def pt_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.expr("(event_id * 7919) % 2000001 - 1000000")
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props", (lng_of("user_id") + off).cast("int").alias("lng"), (lat_of("user_id") + off).cast("int").alias("lat"))
    return e.select(F.col("event_id").alias("feature_id"), geometry.point(_point()).alias("geom"), "event_type", "value", "props", *(F.col(v).alias(n) for v, n in (("lng", "min_lng"), ("lat", "min_lat"), ("lng", "max_lng"), ("lat", "max_lat"))))


def rect_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed five-point rings round a centre."""
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("feature_id"), "p_size",
        F.expr("cast((p_partkey * 2654435761) % 3500000001 - 1750000000 as int)").alias("x"),
        F.expr("cast((p_partkey * 1597334677) % 1700000001 - 850000000 as int)").alias("y"),
        (F.col("p_size") * 100000).alias("h"),
    )
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("h")).cast("int").alias("lng"), (F.col("y") + b * F.col("h")).cast("int").alias("lat"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return with_bounds(p.select("feature_id", geometry.polygon(F.array(ring)).alias("geom"), "p_size"))


def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vertex for each line item of an order; an order without any is an empty line."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", lng_of("l_partkey").alias("lng"), lat_of("l_partkey").alias("lat"))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(v)).alias("v"))
    pts = F.coalesce(F.transform("v", lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat"))), F.expr("cast(array() as array<struct<lng:int,lat:int>>)"))
    return with_bounds(o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("feature_id"), geometry.line_string(pts).alias("geom")))


def mpt_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each nation; every fifth nation has none and so is empty."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = read(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0")
    at = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", lng_of("s_suppkey").alias("lng"), lat_of("s_suppkey").alias("lat")))).alias("v"))
    pts = F.coalesce(F.transform("v", lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat"))), F.expr("cast(array() as array<struct<lng:int,lat:int>>)"))
    joined = n.join(at, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return with_bounds(joined.select(F.col("n_nationkey").cast("long").alias("feature_id"), "n_name", geometry.multi_point(pts).alias("geom")))
