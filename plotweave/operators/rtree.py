"""A packed tree of bounds over features in stored order: 16 children a node, the root first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import FeatureCountMismatch
from ..functions import bounds
from .shared import stored

#: Children of a node, and bytes of a node in the binary format (fixed values of the data model).
FANOUT, NODE_BYTES = 16, 28



def nodes_per_level(n: int) -> list[int]:
    """Root first; the last level has one node for each feature. No level for no feature."""
    out = [n] if n else []
    while out and out[0] > 1:
        out.insert(0, -(-out[0] // FANOUT))
    return out


def node_count(n: int) -> int:
    return sum(nodes_per_level(n))


def index_bytes(n: int) -> int:
    return node_count(n) * NODE_BYTES


def node_ranges(n: int) -> list[tuple[int, int]]:
    """Half-open ranges of node numbers by level, root first."""
    out, at = [], 0
    for size in nodes_per_level(n):
        out.append((at, at + size))
        at += size
    return out


def byte_ranges(n: int) -> list[tuple[int, int]]:
    return [(a * NODE_BYTES, b * NODE_BYTES) for a, b in node_ranges(n)]


def level_of(n: int, node: int) -> int:
    """0 for leaves, more towards the root."""
    for height, (a, b) in enumerate(reversed(node_ranges(n))):
        if a <= node < b:
            return height
    raise IndexError(node)


def level_column(n: int, node: Column) -> Column:
    """`level_of` for a column of node numbers; NULL for unknown nodes."""
    out = F.lit(None).cast("int")
    for height, (a, b) in enumerate(reversed(node_ranges(n))):
        out = F.when((node >= a) & (node < b), F.lit(height)).otherwise(out)
    return out


def is_leaf(n: int, node: int) -> bool:
    return level_of(n, node) == 0


def children(n: int, node: int) -> tuple[int, int] | None:
    """The node numbers of a node's children; None for leaves and unknown nodes."""
    ranges = node_ranges(n)
    for (a, b), (low, high) in zip(ranges, ranges[1:]):
        if a <= node < b:
            first = low + (node - a) * FANOUT
            return first, min(first + FANOUT, high)
    return None


def _inner(positioned: DataFrame, n: int) -> DataFrame:
    """(level, pos, bounds) of all inner nodes: the lowest level sums up the features, and one more aggregation sums up that one for every level."""
    parents = positioned.groupBy(_parent().alias("pos")).agg(*bounds.total())
    each = parents.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(len(nodes_per_level(n)) - 1))))
    span = F.element_at(F.array(*(F.lit(FANOUT**k).cast("long") for k in range(len(nodes_per_level(n)) - 1))), F.col("level"))
    return each.withColumn("pos", F.call_function("div", F.col("pos"), span)).groupBy("level", "pos").agg(*bounds.total())


def levels(positioned: DataFrame, announced: int | None = None, n: int | None = None) -> list[DataFrame]:
    """(pos, bounds) by level, root first, from `n` features with `pos` (counted if not given). Store `nodes` to go through many levels."""
    n = positioned.count() if n is None else n
    if announced is not None and announced != n:
        raise FeatureCountMismatch(f"{announced} features were announced, {n} came")
    above = range(len(nodes_per_level(n)) - 1, 0, -1)
    inner = [_inner(positioned, n).where(F.col("level") == k).select("pos", *bounds.NAMES) for k in above]
    return [*inner, positioned.select("pos", *bounds.NAMES)] if n else []


def nodes(positioned: DataFrame, n: int | None = None, least: int = 0) -> DataFrame:
    """All nodes: node (number, root first), level (0 = leaf), pos (in the level) and bounds; with `least` only levels from that on.

    The plan has the same two aggregations however many levels there are.
    """
    n = positioned.count() if n is None else n
    starts = [a for a, _ in reversed(node_ranges(n))]
    first = F.element_at(F.array(*(F.lit(a).cast("long") for a in starts or [0])), F.col("level") + 1)
    out = positioned.where(F.lit(n > 0 and least <= 0)).select(F.lit(0).alias("level"), "pos", *bounds.NAMES)
    if len(starts) > 1:
        out = out.unionByName(_inner(positioned, n).where(F.col("level") >= least))
    return out.select((F.col("pos") + first).alias("node"), "level", "pos", *bounds.NAMES)


def _parent() -> Column:
    return F.call_function("div", F.col("pos"), F.lit(FANOUT).cast("long"))


def descend(tree: DataFrame, box: bounds.Box, down_to: int = 0, top: int | None = None) -> DataFrame:
    """(pos) of level `down_to`'s nodes that meet the box, from stored `nodes`: only children of nodes that meet it are looked at.

    An upper level is small beside the next, so the walk is a chain of semi-joins whose
    left sides are scans with the box pushed down. `top` is the root's level, looked up if not given.
    """
    top = tree.agg(F.max("level").alias("m")).first()["m"] if top is None else top
    found = None
    for level in range(-1 if top is None else top, down_to - 1, -1):
        hit = tree.where((F.col("level") == level) & bounds.intersects(box))
        found = hit if found is None else hit.join(found.select(F.col("pos").alias("_up")), _parent() == F.col("_up"), "left_semi")
    return tree.where("false").select("pos") if found is None else found.select("pos")


def merged_ranges(pos: DataFrame, span: int = 1, gap: int = 0, most: int = 1024) -> list[tuple[int, int]]:
    """Half-open ranges of places that cover [pos * span, pos * span + span) of every row, neighbours within `gap` made one.

    Places fall into blocks, as wide as needed for at most `most` of them to reach the driver:
    more rows widen the ranges, but none is lost.
    """
    ends = pos.agg(F.min("pos").alias("a"), F.max("pos").alias("z")).first()
    if ends["a"] is None:
        return []
    width = max(1, -(-(ends["z"] - ends["a"] + 1) // most))
    blocks = pos.groupBy(F.call_function("div", F.col("pos") - F.lit(ends["a"]), F.lit(width).cast("long")).alias("b")).agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    out: list[tuple[int, int]] = []
    for r in sorted(blocks.collect(), key=lambda r: r["b"]):
        a, z = r["a"] * span, (r["z"] + 1) * span
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def search(positioned: DataFrame, box: bounds.Box) -> DataFrame:
    """Positions of the features whose bounds meet the box, from the root down. Builds the inner nodes and stores them; a stored dataset keeps them."""
    n = positioned.count()
    leaves = positioned.select(F.lit(0).alias("level"), "pos", *bounds.NAMES)
    inner = stored(nodes(positioned, n, 1)).drop("node")
    return descend(leaves.unionByName(inner), box, top=len(nodes_per_level(n)) - 1)
