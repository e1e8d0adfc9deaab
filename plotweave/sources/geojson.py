"""GeoJSON in and out.

A file is one JSON text: a bare geometry, a feature, a feature collection, or one
feature per line. Files are read in parallel, each by one task, as the format
can't be split; newline-delimited files split by line.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..errors import DecodeError
from ..functions import geometry, properties, wkt
from ..functions.coords import unit_of

_KIND = {n: k for k, n in enumerate(geometry.NAMES)}
_ROW = f"geom {geometry.TYPE.replace(':', ': ')}, entries array<struct<key: string, tag: tinyint, json: string>>"
_BOOL, _INT, _FLOAT, _TEXT = (properties.TAGS.index(t) for t in ("bool", "int64", "float64", "string"))


def shape_of(value: dict) -> wkt.Shape:
    """A JSON geometry as a shape. Coordinates beyond the second, such as heights, are left out; a position of fewer is an error."""
    if not isinstance(value, dict) or value.get("type") not in _KIND:
        raise DecodeError(f"no geometry: {str(value)[:80]}")
    kind = _KIND[value["type"]]
    if kind == geometry.COLLECTION:
        return kind, [shape_of(g) for g in value["geometries"]]

    def point(p) -> tuple[int, int]:
        if not isinstance(p, list) or len(p) < 2:
            raise DecodeError("a position needs two coordinates")
        return unit_of(float(p[0])), unit_of(float(p[1]))

    c = value["coordinates"]
    if kind == geometry.POINT:
        return kind, [point(c)]
    if kind in (geometry.LINE_STRING, geometry.MULTI_POINT):
        return kind, [point(p) for p in c]
    line = lambda ring: (geometry.LINE_STRING, [point(p) for p in ring])
    if kind == geometry.MULTI_POLYGON:
        return kind, [(geometry.POLYGON, [line(r) for r in polygon]) for polygon in c]
    return kind, [line(r) for r in c]


def coordinates(shape: wkt.Shape) -> dict:
    """A shape as a JSON geometry in degrees."""
    kind, members = shape
    out: dict = {"type": geometry.NAMES[kind]}
    if kind == geometry.COLLECTION:
        return out | {"geometries": [coordinates(m) for m in members]}
    pair = lambda p: [p[0] / 1e7, p[1] / 1e7]
    if kind == geometry.POINT:
        return out | {"coordinates": pair(members[0])}
    if kind in (geometry.LINE_STRING, geometry.MULTI_POINT):
        return out | {"coordinates": [pair(p) for p in members]}
    return out | {"coordinates": [coordinates(m)["coordinates"] for m in members]}


def entries_of(value: dict | None) -> list[dict]:
    """Ordered properties; null values are left out, objects and arrays become strings of JSON."""
    out = []
    for key, v in (value or {}).items():
        if v is None:
            continue
        if isinstance(v, bool):
            tag = _BOOL
        elif isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
            tag = _INT
        elif isinstance(v, (int, float)):
            tag, v = _FLOAT, float(v)
        else:
            tag, v = _TEXT, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        out.append({"key": key, "tag": tag, "json": json.dumps(v, ensure_ascii=False)})
    return out


#: What becomes of a feature that can't be read: an error, no row, or a row without geometry.
MODES = ("fail", "drop", "null")


def features_of(text: str, null_geometry: str, mode: str = "fail") -> Iterator[dict]:
    try:
        value = json.loads(text)
        if value["type"] == "FeatureCollection":
            found = value["features"]
        elif value["type"] == "Feature":
            found = [value]
        else:
            found = [{"geometry": value, "properties": None}]
    except (ValueError, TypeError, KeyError) as error:
        if mode == "fail":
            raise DecodeError(f"no GeoJSON: {text[:80]}") from error
        found = [{"geometry": {}, "properties": None}] if mode == "null" else []
    for f in found:
        g, nodes = f.get("geometry"), None
        try:
            if g is not None:
                nodes = wkt.to_nodes(shape_of(g))
            elif null_geometry == "origin":
                nodes = wkt.to_nodes((geometry.POINT, [(0, 0)]))
        except (ValueError, TypeError, KeyError) as error:
            if mode == "fail":
                raise DecodeError(f"no geometry: {str(g)[:80]}") from error
            if mode == "drop":
                continue
        yield {"geom": nodes, "entries": entries_of(f.get("properties"))}


def parse(texts: DataFrame, text_col: str = "value", null_geometry: str = "null", mode: str = "fail") -> DataFrame:
    """Features (feature_id, geom, properties, bounds) of a column of GeoJSON texts; ids, boxes and foreign members are dropped.

    A null geometry stays NULL, or becomes POINT(0 0) with null_geometry='origin'. Null and blank
    texts have no features. A text or geometry that can't be read (an empty point, say) raises
    DecodeError with mode='fail', has no row with 'drop', and no geometry with 'null'.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    kind = texts.sparkSession.createDataFrame([], _ROW).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and t.strip():
                    yield pa.RecordBatch.from_pylist(list(features_of(t, null_geometry, mode)), schema=schema)

    return _features(texts.select(texts[text_col].alias("value")).mapInArrow(run, kind))


def _features(parsed: DataFrame) -> DataFrame:
    out = parsed.select(F.monotonically_increasing_id().alias("feature_id"), "geom", properties.from_json_entries(F.col("entries")).alias("properties"))
    return out.select("*", *geometry.bounds(F.col("geom")))


def parse_geometries(texts: DataFrame, group: str, text_col: str = "value") -> DataFrame:
    """One feature for each `group` of bare geometries, kept in a column of that name: their collection, or the only one by itself.

    A group's geometries come in the order of their parts; it becomes one row, so it must fit one.
    """
    schema = f"_g string, geom {geometry.TYPE}"

    def run(batches):
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"_g": g, "geom": wkt.to_nodes(shape_of(json.loads(t)))}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = texts.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)
    rows = texts.where(F.col(text_col).isNotNull())
    one = rows.select(F.col(group).cast("string").alias("_g"), F.col(text_col)).mapInArrow(run, kind)
    made = one.groupBy("_g").agg(geometry.unwrapped(F.array_sort(F.collect_list("geom"))).alias("geom"))
    made = made.select(F.col("_g").alias(group), "geom", properties.empty().alias("properties"))
    return made.select("*", *geometry.bounds(F.col("geom")))


def read(spark: SparkSession, path: str, by_line: bool = False, null_geometry: str = "null", mode: str = "fail") -> DataFrame:
    return parse(spark.read.text(path, wholetext=not by_line), "value", null_geometry, mode)


def feature_text(geom: Column, props: Column) -> Column:
    """One GeoJSON feature for each row; empty properties are null, as is a NULL geometry; bytes become arrays of numbers."""

    def run(geoms: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for g, e in zip(geoms, entries):
            values = {}
            for p in [] if e is None else e:
                v = json.loads(p["json"]) if p["json"] is not None else None
                if properties.TAGS[p["tag"]] == "bytes" and isinstance(v, str):
                    v = list(base64.b64decode(v))
                values[p["key"]] = v
            out.append(json.dumps({"type": "Feature", "geometry": None if g is None else coordinates(wkt.from_nodes(g)), "properties": values or None}, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, StringType())(geom, properties.to_json_entries(props))


def write(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file for each partition."""
    features.select(feature_text(F.col("geom"), F.col("properties")).alias("value")).write.mode("overwrite").text(path)


def collection(features: DataFrame) -> Iterator[str]:
    """A feature collection as pieces of text, row by row in stored order, without gathering it on the driver."""
    yield '{"type":"FeatureCollection","features":['
    first = True
    for r in features.select(feature_text(F.col("geom"), F.col("properties")).alias("value")).toLocalIterator():
        yield ("" if first else ",") + r["value"]
        first = False
    yield "]}"
