"""Geometries as columns: the tree of parts in pre-order.

array<struct<kind tinyint, arity int, pts array<struct<lng int, lat int>>>>, where
arity counts a node's direct children. It holds all seven kinds and any nesting,
and bounds, counts and members are native array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TYPE = "array<struct<kind:tinyint,arity:int,pts:array<struct<lng:int,lat:int>>>>"
#: Kinds by tag (fixed values of the data model).
POINT, LINE_STRING, POLYGON, MULTI_POINT, MULTI_LINE_STRING, MULTI_POLYGON, COLLECTION = range(7)
NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def _node(kind: int, arity: Column, pts: Column) -> Column:
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), arity.cast("int").alias("arity"), pts.alias("pts"))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<lng:int,lat:int>>)")


def point(p: Column) -> Column:
    return F.array(_node(POINT, F.lit(0), F.array(p)))


def line_string(pts: Column) -> Column:
    return F.array(_node(LINE_STRING, F.lit(0), pts))


def multi_point(pts: Column) -> Column:
    return F.array(_node(MULTI_POINT, F.lit(0), pts))


def polygon(rings: Column) -> Column:
    """From array<array<point>>, the outer ring first."""
    return F.concat(F.array(_node(POLYGON, F.size(rings), _none())), F.transform(rings, lambda r: _node(LINE_STRING, F.lit(0), r)))


def multi_line_string(lines: Column) -> Column:
    return F.concat(F.array(_node(MULTI_LINE_STRING, F.size(lines), _none())), F.transform(lines, lambda r: _node(LINE_STRING, F.lit(0), r)))


def multi_polygon(polygons: Column) -> Column:
    """From array<array<array<point>>>."""
    return F.concat(F.array(_node(MULTI_POLYGON, F.size(polygons), _none())), F.flatten(F.transform(polygons, polygon)))


def collection(geometries: Column) -> Column:
    """From array<geometry>, whatever their kinds."""
    return F.concat(F.array(_node(COLLECTION, F.size(geometries), _none())), F.flatten(geometries))


def unwrapped(geometries: Column) -> Column:
    """A collection's only member, or else the collection."""
    return F.when(F.size(geometries) == 1, F.get(geometries, F.lit(0))).otherwise(collection(geometries))


def kind(geom: Column) -> Column:
    return F.get(geom, F.lit(0))["kind"]


def kind_name(geom: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in NAMES)), kind(geom).cast("int"))


def points(geom: Column) -> Column:
    """All points of all parts, in order."""
    return F.flatten(F.transform(geom, lambda n: n["pts"]))


def point_count(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda acc, n: acc + F.size(n["pts"]))


def is_empty(geom: Column) -> Column:
    return point_count(geom) == 0


def bounds(geom: Column) -> list[Column]:
    """min_lng, min_lat, max_lng, max_lat over all points, holes included; NULL for an empty geometry."""
    pts = points(geom)
    lng, lat = F.transform(pts, lambda p: p["lng"]), F.transform(pts, lambda p: p["lat"])
    return [F.array_min(lng).alias("min_lng"), F.array_min(lat).alias("min_lat"), F.array_max(lng).alias("max_lng"), F.array_max(lat).alias("max_lat")]


def member_count(geom: Column) -> Column:
    """Direct parts: points of a line or multi-point, rings, lines, polygons or members."""
    root = F.get(geom, F.lit(0))
    return F.when(root["kind"].isin(POINT, LINE_STRING, MULTI_POINT), F.size(root["pts"])).otherwise(root["arity"])


def push_point(geom: Column, p: Column) -> Column:
    """A line or multi-point with one more point."""
    root = F.get(geom, F.lit(0))
    return F.array(root.withField("pts", F.array_append(root["pts"], p)))


def push(geom: Column, member: Column) -> Column:
    """A polygon (a ring given as a line), multi-geometry or collection with one more member."""
    root = F.get(geom, F.lit(0))
    return F.concat(F.array(root.withField("arity", root["arity"] + 1)), F.slice(geom, F.lit(2), F.greatest(F.size(geom) - 1, F.lit(0))), member)


def members(geom: Column) -> Column:
    """array<geometry>: the direct members of a nested kind, each with its own parts; empty for the others.

    One fold over the nodes: `left` counts the parts still due to the open member.
    """
    start = F.struct(F.expr(f"cast(array() as array<{TYPE}>)").alias("out"), F.lit(0).alias("left"))

    def step(acc: Column, n: Column) -> Column:
        fresh = acc["left"] == 0
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc["out"], F.lit(-1)), F.expr(f"cast(array() as {TYPE})")), F.array(n))))
        return F.struct(F.when(fresh, F.array_append(acc["out"], F.array(n))).otherwise(grown).alias("out"), F.when(fresh, n["arity"]).otherwise(acc["left"] - 1 + n["arity"]).alias("left"))

    return F.aggregate(F.slice(geom, F.lit(2), F.greatest(F.size(geom) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def first(geom: Column) -> Column:
    """The first member, or NULL."""
    return F.try_element_at(members(geom), F.lit(1))


def last(geom: Column) -> Column:
    return F.try_element_at(members(geom), F.lit(-1))


def pop(geom: Column) -> Column:
    """The geometry without its last member."""
    m = members(geom)
    root = F.get(geom, F.lit(0))
    return F.concat(F.array(root.withField("arity", F.greatest(root["arity"] - 1, F.lit(0)))), F.flatten(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))))


def near(a: Column, b: Column, eps: float) -> Column:
    """Points (struct lng, lat) that agree within `eps` degrees."""
    e = F.lit(eps * 1e7)
    return (F.abs(a["lng"].cast("long") - b["lng"]) <= e) & (F.abs(a["lat"].cast("long") - b["lat"]) <= e)


def same(a: Column, b: Column) -> Column:
    """Equal kinds, parts and points in the same order; NULL equals NULL."""
    return a.eqNullSafe(b)
