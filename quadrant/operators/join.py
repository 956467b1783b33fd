"""Spatial joins of points with polygon windows.

Polygon windows: ``(window_id, edges ARRAY<STRUCT<x1,y1,x2,y2>>, mnx, mxx, mny, mxy)``.
The join is inner and keeps row multiplicity: two input rows at one place are
two matches.

* ``broadcast`` (J1): the window table is broadcast; every point is tested
  against each window's bounding box, and only points inside a box run the
  per-edge polygon test (``CASE WHEN`` guard).  ``auto`` uses it for up to
  ``MAX_LOOP_ROWS`` windows (the loop costs points x windows).
* ``cells`` (J2): points and windows meet on quad-tree leaf keys, then the
  same guarded test.  Same rows as ``broadcast`` by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.functions.geometry import guarded_in_polygon
from quadrant.operators.quadtree import LEAF_KEY, QuadTree, assign_leaves, pair_windows, quadtree
from quadrant.operators.sizing import MAX_BROADCAST_ROWS, MAX_LOOP_ROWS, maybe_broadcast_polygons, shielded
from quadrant.session import materialize

_WINDOW_GEOM = ("edges", "mnx", "mxx", "mny", "mxy")


def _pip(predicate: str):
    return guarded_in_polygon("edges", "x", "y", "mnx", "mxx", "mny", "mxy", predicate)


def pip_join(pts: DataFrame, windows: DataFrame, predicate: str = "intersects",
             strategy: str = "auto", qt: QuadTree | None = None,
             max_broadcast_rows: int = MAX_BROADCAST_ROWS,
             known_windows: int | None = None, known_edges: int | None = None) -> DataFrame:
    """``(window_id, ...point columns)`` for every point in a window.

    ``predicate``: ``intersects`` / ``covers`` (closed: inside or on an edge),
    or ``interior`` (strictly inside).  A window table over the broadcast bounds goes
    through cells whatever the strategy; all give the same rows, also for repeated or NULL window
    ids and for a tree (``qt``) of another point set.  ``known_windows`` / ``known_edges``
    are the caller's word and not relied on: the table is measured before it is broadcast.
    """
    if strategy not in ("auto", "broadcast", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    inner, back = shielded(pts, ["window_id"])
    # Written once: the window table (often a kNN result) is computed a single
    # time although the size check, the leaf pairing and the join all need it.
    geo = materialize(windows.select(F.col("window_id").alias("_w_window_id"), *_WINDOW_GEOM), "windows")
    out = [F.col("_w_window_id").alias("window_id"), *back]
    if strategy in ("auto", "broadcast"):
        limit = min(max_broadcast_rows, MAX_LOOP_ROWS) if strategy == "auto" else max_broadcast_rows
        w, small = maybe_broadcast_polygons(geo, limit)
        if small:
            return inner.join(w, _pip(predicate)).select(*out)
    qt = qt or quadtree(pts)
    pairs = materialize(pair_windows(geo, qt), "window-leaf-pairs")
    pairs, _ = maybe_broadcast_polygons(pairs, max_broadcast_rows)
    tagged = assign_leaves(inner, qt, max_broadcast_rows)
    return tagged.join(pairs, LEAF_KEY).where(_pip(predicate)).select(*out)


def grouped(matches: DataFrame) -> DataFrame:
    """The set of point ids matched by each window, as distinct ``(window_id, id)`` rows.

    The set stays distributed (a shuffle on both columns) instead of being
    collected into one array per window, so a window holding a third of all
    points is spread over many tasks like any other.
    """
    return matches.select("window_id", "id").distinct()


def grouped_summary(matches: DataFrame) -> DataFrame:
    """J3, scalar form: per window, matches, distinct ids, min and max id.

    Uses only mergeable aggregates, so it never gathers one window's points
    into one task.
    """
    return matches.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.countDistinct("id").alias("n_ids"),
        F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def grouped_summary_bitmap(matches: DataFrame) -> DataFrame:
    """J3, the same rows as :func:`grouped_summary`: distinct ids counted in bitmaps.

    Ids share a bitmap of 4 KB per window and bucket of 32,768 ids, built map-side, so the shuffle carries bitmaps in place of one row per
    (window, id).  Meant for dense ids; sparse ones would fill a bitmap each, for them :func:`grouped_summary` ships less.
    """
    m = matches.select("window_id", "id")
    buckets = m.groupBy("window_id", F.bitmap_bucket_number("id").alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("_bits"), F.min("id").alias("low"), F.max("id").alias("high"))
    return buckets.groupBy("window_id").agg(
        F.sum("n").alias("n_matches"), F.sum(F.when(F.col("_bucket").isNotNull(), F.bitmap_count("_bits")).otherwise(0)).alias("n_ids"),
        F.min("low").alias("min_id"), F.max("high").alias("max_id"))


def matched_window_count(matches: DataFrame) -> DataFrame:
    """How many windows have at least one point (one row, ``n_windows``)."""
    return matches.select("window_id").distinct().agg(F.count(F.lit(1)).alias("n_windows"))


__all__ = ["pip_join", "grouped", "grouped_summary", "grouped_summary_bitmap", "matched_window_count"]
