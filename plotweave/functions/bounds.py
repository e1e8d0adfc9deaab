"""Bounding boxes: four INT columns, or struct<min_lng, min_lat, max_lng, max_lat>. NULL bounds are empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .coords import unit_of

NAMES = ("min_lng", "min_lat", "max_lng", "max_lat")


@dataclass(frozen=True)
class Box:
    """A query box in units. Corners may be given in any order; the date line is not crossed."""

    min_lng: int
    min_lat: int
    max_lng: int
    max_lat: int

    @classmethod
    def corners(cls, lng1: int, lat1: int, lng2: int, lat2: int) -> Box:
        return cls(min(lng1, lng2), min(lat1, lat2), max(lng1, lng2), max(lat1, lat2))

    @classmethod
    def degrees(cls, lng1: float, lat1: float, lng2: float, lat2: float) -> Box:
        return cls.corners(*(unit_of(v) for v in (lng1, lat1, lng2, lat2)))

    @classmethod
    def css(cls, top: float, right: float, bottom: float, left: float) -> Box:
        """Degrees in the order top, right, bottom, left."""
        return cls.degrees(left, bottom, right, top)

    @classmethod
    def extent(cls, text: str) -> Box:
        """Degrees as "west,south,east,north"."""
        return cls.degrees(*(float(v) for v in text.split(",")))

    @classmethod
    def around(cls, lng: float, lat: float, half: float) -> Box:
        """A square of `half` degrees to each side."""
        return cls.degrees(lng - half, lat - half, lng + half, lat + half)

    @classmethod
    def viewport(cls, west: float, south: float, east: float, north: float, share: float = 0.8) -> Box:
        """A square round a view's centre: `share` of the smaller half-extent to each side."""
        half = share * min((east - west) / 2, (north - south) / 2)
        return cls.around((west + east) / 2, (south + north) / 2, half)


def of(prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in NAMES]


def intersects(box: Box, prefix: str = "") -> Column:
    """Closed boxes: a shared edge or corner counts. Plain comparisons, so that scans can push them down; empty bounds never match."""
    a, b, c, d = of(prefix)
    return (c >= F.lit(box.min_lng)) & (d >= F.lit(box.min_lat)) & (a <= F.lit(box.max_lng)) & (b <= F.lit(box.max_lat))


def overlap(left: str, right: str) -> Column:
    """`intersects` for two sets of bounds columns, by prefix."""
    a, b = of(left), of(right)
    return (a[2] >= b[0]) & (a[3] >= b[1]) & (a[0] <= b[2]) & (a[1] <= b[3])


def from_corners(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> list[Column]:
    values = (F.least(lng1, lng2), F.least(lat1, lat2), F.greatest(lng1, lng2), F.greatest(lat1, lat2))
    return [v.alias(n) for v, n in zip(values, NAMES)]


def union(left: str, right: str) -> list[Column]:
    """Bounds of two boxes together; an empty one changes nothing."""
    a, b = of(left), of(right)
    return [F.least(a[0], b[0]).alias(NAMES[0]), F.least(a[1], b[1]).alias(NAMES[1]), F.greatest(a[2], b[2]).alias(NAMES[2]), F.greatest(a[3], b[3]).alias(NAMES[3])]


def with_point(lng: Column, lat: Column, prefix: str = "") -> list[Column]:
    a = of(prefix)
    return [F.least(a[0], lng).alias(NAMES[0]), F.least(a[1], lat).alias(NAMES[1]), F.greatest(a[2], lng).alias(NAMES[2]), F.greatest(a[3], lat).alias(NAMES[3])]


def total(prefix: str = "") -> list[Column]:
    """Aggregates: the bounds of a group. Empty bounds are NULL and so count for nothing."""
    a = of(prefix)
    return [F.min(a[0]).alias(NAMES[0]), F.min(a[1]).alias(NAMES[1]), F.max(a[2]).alias(NAMES[2]), F.max(a[3]).alias(NAMES[3])]


def width(prefix: str = "") -> Column:
    """In units, as BIGINT: 360 degrees don't fit an INT."""
    return F.col(prefix + "max_lng").cast("long") - F.col(prefix + "min_lng").cast("long")


def height(prefix: str = "") -> Column:
    return F.col(prefix + "max_lat").cast("long") - F.col(prefix + "min_lat").cast("long")


def center(prefix: str = "") -> tuple[Column, Column]:
    """(lng, lat) as INT: the lower corner plus half the size, cut down."""
    lng = F.col(prefix + "min_lng").cast("long") + F.call_function("div", width(prefix), F.lit(2).cast("long"))
    lat = F.col(prefix + "min_lat").cast("long") + F.call_function("div", height(prefix), F.lit(2).cast("long"))
    return lng.cast("int"), lat.cast("int")


def text(prefix: str = "") -> Column:
    """RECT(minx miny,maxx maxy) in degrees."""
    v = [F.regexp_replace((c / F.lit(1e7)).cast("string"), r"\.0$", "") for c in of(prefix)]
    return F.concat(F.lit("RECT("), v[0], F.lit(" "), v[1], F.lit(","), v[2], F.lit(" "), v[3], F.lit(")"))
