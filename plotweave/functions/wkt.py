"""Well-known text: literals for the driver, and text of geometry columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import geometry
from .bounds import Box
from .coords import unit_of

#: Python's form of a geometry: (kind, points) for points, lines and multi-points, else (kind, members).
Shape = tuple[int, list]

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")
_KINDS = {n.upper(): k for k, n in enumerate(geometry.NAMES)}
#: The kind of a nested kind's members.
_MEMBER = {geometry.POLYGON: geometry.LINE_STRING, geometry.MULTI_LINE_STRING: geometry.LINE_STRING, geometry.MULTI_POLYGON: geometry.POLYGON}


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not well-known text at {text[at : at + 20]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.i = 0

    def peek(self) -> str:
        return self.tokens[self.i].upper() if self.i < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or (wanted and got not in wanted):
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'}")
        self.i += 1
        return got

    def pair(self) -> tuple[int, int]:
        return unit_of(float(self.take())), unit_of(float(self.take()))

    def listed(self, one) -> list:
        if self.peek() == "EMPTY":
            self.take()
            return []
        self.take("(")
        out = [one()]
        while self.take(",", ")") == ",":
            out.append(one())
        return out

    def body(self, kind: int) -> Shape:
        if kind == geometry.POINT:
            self.take("(")
            p = self.pair()
            self.take(")")
            return kind, [p]
        if kind in (geometry.LINE_STRING, geometry.MULTI_POINT):
            return kind, self.listed(self.multi_point_member if kind == geometry.MULTI_POINT else self.pair)
        if kind == geometry.COLLECTION:
            return kind, self.listed(self.shape)
        return kind, self.listed(lambda: self.body(_MEMBER[kind]))

    def multi_point_member(self) -> tuple[int, int]:
        if self.peek() != "(":
            return self.pair()
        self.take("(")
        p = self.pair()
        self.take(")")
        return p

    def shape(self) -> Shape:
        return self.body(_KINDS[self.take(*_KINDS)])


def parse(text: str) -> Shape | Box:
    """A geometry, or a Box from RECT(x y,x y). Coordinates in degrees; `EMPTY` for all kinds but points."""
    r = _Reader(text)
    if r.peek() == "RECT":
        r.take()
        a, b = r.listed(r.pair)
        out = Box.corners(*a, *b)
    else:
        out = r.shape()
    if r.peek():
        raise ValueError(f"unexpected {r.peek()}")
    return out


def to_nodes(shape: Shape) -> list[dict]:
    """The node array of a shape."""
    kind, members = shape
    if kind in (geometry.POINT, geometry.LINE_STRING, geometry.MULTI_POINT):
        return [{"kind": kind, "arity": 0, "pts": [{"lng": x, "lat": y} for x, y in members]}]
    return [{"kind": kind, "arity": len(members), "pts": []}, *(n for m in members for n in to_nodes(m))]


def from_nodes(nodes) -> Shape:
    """The shape of a node array (rows or dicts)."""

    def read(i: int) -> tuple[Shape, int]:
        n = nodes[i]
        if n["kind"] in (geometry.POINT, geometry.LINE_STRING, geometry.MULTI_POINT):
            return (int(n["kind"]), [(int(p["lng"]), int(p["lat"])) for p in n["pts"]]), i + 1
        members, i = [], i + 1
        for _ in range(n["arity"]):
            m, i = read(i)
            members.append(m)
        return (int(n["kind"]), members), i

    return read(0)[0]


def literal(text: str) -> Column:
    """A geometry column of one well-known text."""
    nodes = to_nodes(parse(text))
    parts = [F.struct(F.lit(n["kind"]).cast("tinyint").alias("kind"), F.lit(n["arity"]).alias("arity"), F.array(*(F.struct(F.lit(p["lng"]).alias("lng"), F.lit(p["lat"]).alias("lat")) for p in n["pts"])).cast("array<struct<lng:int,lat:int>>").alias("pts")) for n in nodes]
    return F.array(*parts)


def _number(units: int) -> str:
    return f"{units / 1e7:.7f}".rstrip("0").rstrip(".")


def render(shape: Shape) -> str:
    """Well-known text of all seven kinds, in degrees."""
    kind, members = shape
    name = geometry.NAMES[kind].upper()
    return f"{name} EMPTY" if not members else f"{name}{' ' if kind else ''}{_body(shape)}"


def _body(shape: Shape) -> str:
    kind, members = shape
    if kind in (geometry.POINT, geometry.LINE_STRING, geometry.MULTI_POINT):
        inner = [f"{_number(x)} {_number(y)}" for x, y in members]
    elif kind == geometry.COLLECTION:
        inner = [render(m) for m in members]
    else:
        inner = [_body(m) for m in members]
    return f"({','.join(inner)})" if inner else "EMPTY"


def text(geom: Column) -> Column:
    """Well-known text of a geometry column, NULL for NULL. Nesting has no bound, so this is an Arrow UDF; use it at sinks."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda nodes: None if nodes is None else render(from_nodes(nodes)))

    return F.pandas_udf(run, StringType())(geom)


def line_text_units(geom: Column) -> Column:
    """Native text of a single-part geometry in integer units: KIND (x y,x y) or KIND EMPTY."""
    root = F.get(geom, F.lit(0))
    pts = F.array_join(F.transform(root["pts"], lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))), ",")
    return F.concat(F.upper(geometry.kind_name(geom)), F.when(F.size(root["pts"]) == 0, F.lit(" EMPTY")).otherwise(F.concat(F.lit(" ("), pts, F.lit(")"))))
