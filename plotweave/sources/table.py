"""Delimited text in and out: geometry as well-known text or as two columns of degrees, properties as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import coords, geometry, properties, wkt


def parsed_text(text: Column, mode: str = "fail") -> Column:
    """A geometry column of well-known texts, NULL for NULL; what is none raises an error, or is NULL with mode='null'."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return wkt.to_nodes(wkt.parse(t))
            except (ValueError, TypeError):
                if mode == "fail":
                    raise
                return None

        return pd.Series([[(n["kind"], n["arity"], [(p["lng"], p["lat"]) for p in n["pts"]]) for n in g] if g is not None else None for g in map(one, texts)], dtype="object")

    nodes = F.pandas_udf(run, "array<struct<kind:int,arity:int,pts:array<struct<lng:int,lat:int>>>>")(text)
    return nodes.cast(geometry.TYPE)


def read(spark: SparkSession, path: str, wkt_col: str | None = "geometry", lng_col: str | None = None, lat_col: str | None = None, mode: str = "fail", **options) -> DataFrame:
    """Features (feature_id, geom, properties, bounds) of CSV files with a header.

    The geometry is the well-known text of `wkt_col`, or the point of `lng_col` and `lat_col` in
    degrees. All other columns are string properties; a null value is no property.
    """
    rows = spark.read.options(header=True, escape='"', **options).csv(path)
    if lng_col and lat_col:
        geom = F.when(F.col(lng_col).isNotNull() & F.col(lat_col).isNotNull(), geometry.point(coords.point(F.col(lng_col).cast("double"), F.col(lat_col).cast("double"))))
        taken = {lng_col, lat_col}
    else:
        geom, taken = parsed_text(F.col(wkt_col), mode), {wkt_col}
    entries = [properties.entry(c, F.col(c), "string") for c in rows.columns if c not in taken]
    props = F.filter(properties.of(*entries), lambda p: p["value"].isNotNull() & (F.to_json(p["value"]) != "null"))
    out = rows.select(F.monotonically_increasing_id().alias("feature_id"), geom.alias("geom"), props.alias("properties"))
    return out.select("*", *geometry.bounds(F.col("geom")))


def columns(features: DataFrame, keys: list[str]) -> DataFrame:
    """geometry (well-known text) and one string column for each property of `keys`, NULL where missing."""
    value = lambda k: F.coalesce(properties.get(F.col("properties"), k, "string"), F.to_json(F.get(F.filter("properties", lambda p: p["key"] == F.lit(k)), F.lit(0))["value"]))
    return features.select(wkt.text(F.col("geom")).alias("geometry"), *(value(k).alias(k) for k in keys))


def write(features: DataFrame, path: str, keys: list[str]) -> None:
    columns(features, keys).write.mode("overwrite").options(header=True, escape='"').csv(path)
