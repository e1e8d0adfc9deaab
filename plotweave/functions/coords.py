"""Fixed-point coordinates: degrees times 10^7, cut toward zero, as 32-bit integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Units per degree (a fixed value of the data model).
UNITS = 10_000_000.0
_LEAST, _MOST = -2147483648.0, 2147483647.0


def to_units(degrees: Column) -> Column:
    """Truncates toward zero, saturates at the 32-bit limits, and maps NaN to 0; null stays null."""
    scaled = F.nanvl(degrees.cast("double") * F.lit(UNITS), F.lit(0.0))
    return F.when(degrees.isNotNull(), F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), scaled))).cast("int")


def to_degrees(units: Column) -> Column:
    return units / F.lit(UNITS)


def point(lng: Column, lat: Column) -> Column:
    """struct<lng int, lat int> from degrees."""
    return F.struct(to_units(lng).alias("lng"), to_units(lat).alias("lat"))


def point_units(lng: Column, lat: Column) -> Column:
    """struct<lng int, lat int> from units."""
    return F.struct(lng.cast("int").alias("lng"), lat.cast("int").alias("lat"))


def with_lng(p: Column, lng: Column) -> Column:
    """The point with another longitude, in units (`to_units` gives them)."""
    return p.withField("lng", lng.cast("int"))


def with_lat(p: Column, lat: Column) -> Column:
    return p.withField("lat", lat.cast("int"))


def unit_of(degrees: float) -> int:
    """`to_units` for one Python number, for query boxes."""
    if degrees != degrees:
        return 0
    return int(max(_LEAST, min(_MOST, degrees * UNITS)))
