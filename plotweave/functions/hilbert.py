"""Distance along a Hilbert curve over 2^16 by 2^16 cells, as a native expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ORDER = 16
TOP = (1 << ORDER) - 1


def distance(x: Column, y: Column) -> Column:
    """The textbook bit-by-bit walk from the largest quadrant down; 0 .. 2^32 - 1 as BIGINT.

    Each step adds the quadrant's rank and turns the rest of the path to the
    quadrant's orientation.
    """
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx = F.when(acc["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        rank = (F.lit(3) * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), F.lit(TOP) - acc["x"]).otherwise(acc["x"])
        fy = F.when((ry == 0) & (rx == 1), F.lit(TOP) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (acc["d"] + s * s * rank).alias("d"))

    sides = F.array(*(F.lit(1 << k).cast("long") for k in range(ORDER - 1, -1, -1)))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(sides, start, step, lambda acc: acc["d"]))


def cell(value: Column, low: Column, size: Column) -> Column:
    """An axis scaled to 0 .. 2^16 - 1, cut down; 0 where the extent has no size. BIGINT throughout."""
    moved = value.cast("long") - low.cast("long")
    return F.when(size == 0, F.when(moved.isNotNull(), F.lit(0).cast("long"))).otherwise(F.call_function("div", moved * F.lit(TOP), size))
