"""Seeded query points (G4) and query windows.

The reference draws them from an unseeded ``java.util.Random``.  Here they come
from ``spark.range(n)`` and an integer hash of (row, seed): deterministic, the
same on any partitioning (``rand(seed)`` is not), and reproducible in any SQL
engine, which is what makes the result checkable.  The hash is a Weyl sequence
per axis and corner, so successive rows spread over the whole extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The workload extent (degrees), as in the reference programs.
MIN_X, MAX_X = -120.284557, -117.618988
MIN_Y, MAX_Y = 32.806193, 36.485821
SPAN_X = 2.665569   # MAX_X - MIN_X, written out so that it is an exact literal
SPAN_Y = 3.679628   # MAX_Y - MIN_Y

# Hash parameters (ours): modulus, row multiplier and offset per corner, seed multiplier.
X_HASH = dict(mod=1000003, mult=(618034, 757577), seed_mult=7919, offset=(13, 381979))
Y_HASH = dict(mod=1000033, mult=(414214, 302776), seed_mult=104729, offset=(71, 618049))


def unit_hash(row: Column, seed: int, axis: dict, corner: int = 0) -> Column:
    """Uniform-looking value in [0, 1) from a non-negative integer row number."""
    inner = row * axis["mult"][corner] + (seed * axis["seed_mult"] + axis["offset"][corner])
    return (inner % axis["mod"]) / F.lit(float(axis["mod"]))


def scaled_x(u: Column) -> Column:
    return F.lit(MIN_X) + u * F.lit(SPAN_X)


def scaled_y(u: Column) -> Column:
    return F.lit(MIN_Y) + u * F.lit(SPAN_Y)


def query_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` query points ``(q, qx, qy)`` in the extent, uniform over [min, max)."""
    q = F.col("id")
    return spark.range(n).select(
        q.alias("q"),
        scaled_x(unit_hash(q, seed, X_HASH)).alias("qx"),
        scaled_y(unit_hash(q, seed, Y_HASH)).alias("qy"),
    )


def query_windows(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` rectangles ``(window_id, mnx, mxx, mny, mxy)`` from two random corners."""
    w = F.col("id")
    x1 = scaled_x(unit_hash(w, seed, X_HASH, 0))
    x2 = scaled_x(unit_hash(w, seed, X_HASH, 1))
    y1 = scaled_y(unit_hash(w, seed, Y_HASH, 0))
    y2 = scaled_y(unit_hash(w, seed, Y_HASH, 1))
    return spark.range(n).select(
        w.alias("window_id"),
        F.least(x1, x2).alias("mnx"), F.greatest(x1, x2).alias("mxx"),
        F.least(y1, y2).alias("mny"), F.greatest(y1, y2).alias("mxy"),
    )


def points_for(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """G4 for a table: a random query point ``(q, qx, qy)`` per row, from its non-negative integer ``key``."""
    q = F.col(key).cast("bigint")
    return df.select(q.alias("q"), scaled_x(unit_hash(q, seed, X_HASH)).alias("qx"), scaled_y(unit_hash(q, seed, Y_HASH)).alias("qy"))


def windows_for(df: DataFrame, key: str, seed: int = 0, share: float = 1.0) -> DataFrame:
    """G5 for a table: a random window per row, between the key's random corners, drawn in to ``share`` of their distance."""
    w = F.col(key).cast("bigint")
    axes = {}
    for axis, scaled, h in (("x", scaled_x, X_HASH), ("y", scaled_y, Y_HASH)):
        a, b = scaled(unit_hash(w, seed, h, 0)), scaled(unit_hash(w, seed, h, 1))
        axes[axis] = (a, a + (b - a) * F.lit(float(share)))
    (x1, x2), (y1, y2) = axes["x"], axes["y"]
    return df.select(w.alias("window_id"), F.least(x1, x2).alias("mnx"), F.greatest(x1, x2).alias("mxx"),
                     F.least(y1, y2).alias("mny"), F.greatest(y1, y2).alias("mxy"))


def _unit_value(row: int, seed: int, axis: dict, corner: int = 0) -> float:
    inner = row * axis["mult"][corner] + (seed * axis["seed_mult"] + axis["offset"][corner])
    return (inner % axis["mod"]) / float(axis["mod"])


def query_point_value(row: int, seed: int = 0) -> tuple[float, float]:
    """Row ``row`` of ``query_points(.., seed)`` as Python floats (same doubles)."""
    return (MIN_X + _unit_value(row, seed, X_HASH) * SPAN_X,
            MIN_Y + _unit_value(row, seed, Y_HASH) * SPAN_Y)


def query_window_value(row: int, seed: int = 0) -> tuple[float, float, float, float]:
    """Row ``row`` of ``query_windows(.., seed)`` as ``(mnx, mxx, mny, mxy)`` floats."""
    x1 = MIN_X + _unit_value(row, seed, X_HASH, 0) * SPAN_X
    x2 = MIN_X + _unit_value(row, seed, X_HASH, 1) * SPAN_X
    y1 = MIN_Y + _unit_value(row, seed, Y_HASH, 0) * SPAN_Y
    y2 = MIN_Y + _unit_value(row, seed, Y_HASH, 1) * SPAN_Y
    return min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)


def point_literal(spark: SparkSession, qx: float, qy: float, q: int = 0) -> DataFrame:
    """G1: a one-row query table for a single literal point."""
    return spark.range(1).select(F.lit(q).cast("bigint").alias("q"),
                                 F.lit(float(qx)).alias("qx"), F.lit(float(qy)).alias("qy"))


__all__ = ["MIN_X", "MAX_X", "MIN_Y", "MAX_Y", "SPAN_X", "SPAN_Y",
           "query_points", "query_windows", "points_for", "windows_for", "point_literal", "unit_hash",
           "query_point_value", "query_window_value"]
