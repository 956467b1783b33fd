"""Column builders for planar 2-D geometry.

Everything here returns a ``pyspark.sql.Column`` made of built-in functions, so
it stays inside Catalyst (pushdown, codegen) and needs no Python at run time.

Coordinates are plain DOUBLE columns.  Distances are planar (the data are
longitude/latitude degrees treated as a plane, as in the reference workloads).
Formulas avoid division and ``pow``/``hypot`` so that any SQL engine evaluating
the same expression in the same order gets bit-equal doubles.
"""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]
Number = Union[int, float]


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(float(c))


# --- G1 / G2: points and envelopes --------------------------------------------

def envelope_bounds(x1, x2, y1, y2) -> tuple[Column, Column, Column, Column]:
    """Corners given in any order -> (mnx, mxx, mny, mxy); reversed corners swap."""
    a, b, c, d = _col(x1), _col(x2), _col(y1), _col(y2)
    return F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)


def envelope_literals(x1: Number, x2: Number, y1: Number, y2: Number) -> tuple[float, float, float, float]:
    """Driver-side normalisation of a literal envelope."""
    return (float(min(x1, x2)), float(max(x1, x2)), float(min(y1, y2)), float(max(y1, y2)))


# --- P1: point in envelope (closed on all sides) ------------------------------

def in_envelope(x: ColumnOrName, y: ColumnOrName, mnx, mxx, mny, mxy) -> Column:
    """``x BETWEEN mnx AND mxx AND y BETWEEN mny AND mxy``.

    On stored columns with literal bounds this reaches the Parquet scan as
    PushedFilters.  For a point, "covered by" and "intersects" a closed
    rectangle coincide, so one predicate serves both.
    """
    x, y = _col(x), _col(y)
    return (x >= _col(mnx)) & (x <= _col(mxx)) & (y >= _col(mny)) & (y <= _col(mxy))


# --- P4: planar distance --------------------------------------------------------

def dist2(x: ColumnOrName, y: ColumnOrName, qx, qy) -> Column:
    """Squared planar distance, ``dx*dx + dy*dy``; used for ordering."""
    dx = _col(x) - _col(qx)
    dy = _col(y) - _col(qy)
    return dx * dx + dy * dy


# --- P2 / P3: point in polygon (even-odd + on-edge) -----------------------------
# A polygon is an ARRAY<STRUCT<x1,y1,x2,y2 DOUBLE>> of directed edges.  Rings made
# from nearest neighbours in distance order usually cross themselves, and the
# even-odd rule is the one that is defined for such rings.

def _edge_cross(e: Column, x: Column, y: Column) -> Column:
    return (e["x1"] - x) * (e["y2"] - y) - (e["x2"] - x) * (e["y1"] - y)


def _edge_hit(e: Column, x: Column, y: Column) -> Column:
    straddles = (e["y1"] > y) != (e["y2"] > y)
    return straddles & ((_edge_cross(e, x, y) > 0) == (e["y2"] > e["y1"]))


def _edge_touch(e: Column, x: Column, y: Column) -> Column:
    return (
        (_edge_cross(e, x, y) == 0)
        & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))
    )


def crossings(edges: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """Number of edges a ray from (x, y) towards +x crosses."""
    x, y = _col(x), _col(y)
    return F.aggregate(_col(edges), F.lit(0),
                       lambda acc, e: acc + F.when(_edge_hit(e, x, y), 1).otherwise(0))


def on_boundary(edges: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """True when (x, y) lies exactly on some edge."""
    x, y = _col(x), _col(y)
    return F.exists(_col(edges), lambda e: _edge_touch(e, x, y))


PREDICATES = ("intersects", "covers", "interior")


def in_polygon(edges: ColumnOrName, x: ColumnOrName, y: ColumnOrName,
               predicate: str = "intersects") -> Column:
    """Point-in-polygon test.

    ``intersects`` and ``covers`` are the same closed test for a point (inside
    by even-odd, or on an edge); ``interior`` is strict (on-edge excluded).
    """
    odd = (crossings(edges, x, y) % 2) == 1
    touch = on_boundary(edges, x, y)
    if predicate in ("intersects", "covers"):
        return odd | touch
    if predicate == "interior":
        return odd & ~touch
    raise ValueError(f"unknown predicate {predicate!r}; expected one of {PREDICATES}")


def guarded_in_polygon(edges, x, y, mnx, mxx, mny, mxy, predicate: str = "intersects") -> Column:
    """Bounding-box test first, polygon test only for rows inside the box.

    The ``CASE WHEN`` is what keeps the order: inside a plain AND, Catalyst is
    free to evaluate the (interpreted, per-edge) array lambda first.
    """
    box = in_envelope(x, y, mnx, mxx, mny, mxy)
    return box & F.when(box, in_polygon(edges, x, y, predicate)).otherwise(F.lit(False))


# --- Morton (Z-order) codes ------------------------------------------------------
# Bit-spreading masks for interleaving two 32-bit integers into one 64-bit code.
# Shift 16, 8, 4, 2, 1 with the standard "magic number" masks.
_SPREAD_STEPS = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread_step(v: Column, shift: int, mask: int) -> Column:
    return F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask))


def grid_coord(v: ColumnOrName, lo, hi, depth: int) -> Column:
    """Integer cell coordinate of ``v`` on a 2^depth grid over [lo, hi].

    A degenerate extent (hi == lo) maps every value to cell 0; values outside
    [lo, hi] are clamped into the border cells.
    """
    side = 1 << depth
    span = F.nullif(_col(hi) - _col(lo), F.lit(0.0))
    g = F.coalesce(F.floor((_col(v) - _col(lo)) / span * F.lit(float(side))), F.lit(0).cast("bigint"))
    return F.least(F.lit(side - 1).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), g))


def with_morton(df, gx: ColumnOrName, gy: ColumnOrName, name: str = "zkey"):
    """Add column ``name``: the bits of two non-negative cell coordinates interleaved
    (x in the even bits).

    Each spreading step is its own projection.  Written as one nested
    expression, every step would copy its input twice, and the copies (which
    contain the whole coordinate derivation) would grow as 2^5 per axis.
    """
    df = df.withColumn("_mx", _col(gx).cast("bigint")).withColumn("_my", _col(gy).cast("bigint"))
    for shift, mask in _SPREAD_STEPS:
        df = (df.withColumn("_mx", _spread_step(F.col("_mx"), shift, mask))
              .withColumn("_my", _spread_step(F.col("_my"), shift, mask)))
    return (df.withColumn(name, F.col("_mx").bitwiseOR(F.shiftleft(F.col("_my"), 1)))
            .drop("_mx", "_my"))


def morton_prefix(code: ColumnOrName, depth: ColumnOrName | int, max_depth: int) -> Column:
    """Quad-tree node at ``depth`` that contains a depth-``max_depth`` code."""
    if isinstance(depth, int):
        return F.shiftright(_col(code), 2 * (max_depth - depth))
    shift = ((F.lit(max_depth) - _col(depth)) * 2).cast("int")
    return F.call_function("shiftright", _col(code), shift)


__all__ = [
    "envelope_bounds", "envelope_literals", "in_envelope", "dist2",
    "crossings", "on_boundary", "in_polygon", "guarded_in_polygon", "PREDICATES",
    "grid_coord", "with_morton", "morton_prefix",
]
