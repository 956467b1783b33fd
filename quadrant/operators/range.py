"""Range queries (Q1-Q3): points inside axis-aligned windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.functions.geometry import envelope_literals, in_envelope
from quadrant.operators.quadtree import LEAF_KEY, QuadTree, assign_leaves, pair_windows, quadtree
from quadrant.operators.sizing import MAX_BROADCAST_ROWS, MAX_LOOP_ROWS, maybe_broadcast, shielded
from quadrant.session import materialize


def range_query(pts: DataFrame, x1: float, x2: float, y1: float, y2: float) -> DataFrame:
    """Q1: points inside one window, corners in any order, closed on all sides.

    Literal bounds on stored x/y columns reach the Parquet reader as pushed
    filters; on a space-clustered table (``layout.write_clustered``) they also
    prune row groups and files, which is what the reference's index buys (Q2).
    """
    mnx, mxx, mny, mxy = envelope_literals(x1, x2, y1, y2)
    return pts.where(in_envelope("x", "y", mnx, mxx, mny, mxy))


def normalize_windows(windows: DataFrame) -> DataFrame:
    """G2 for a window table: swap reversed corners."""
    return windows.select(
        "window_id",
        F.least("mnx", "mxx").alias("mnx"), F.greatest("mnx", "mxx").alias("mxx"),
        F.least("mny", "mxy").alias("mny"), F.greatest("mny", "mxy").alias("mxy"),
        *[c for c in windows.columns if c not in ("window_id", "mnx", "mxx", "mny", "mxy")])


def range_join(pts: DataFrame, windows: DataFrame, strategy: str = "auto",
               qt: QuadTree | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
               known_windows: int | None = None) -> DataFrame:
    """Q3: every (window, point) pair with the point inside the window.

    ``broadcast``: the window table is broadcast and each point is tested
    against every window (nested loop, no shuffle of points): points x windows
    tests, so ``auto`` uses it for up to ``MAX_LOOP_ROWS`` windows.
    ``cells``: points and windows meet on quad-tree leaf keys (an equi-join);
    each point has one leaf, so no pair is produced twice.  ``broadcast`` becomes ``cells``
    for a window table over the broadcast bound.  All give the same rows, also for
    repeated or NULL window ids and for a tree (``qt``) of another point set.

    ``known_windows`` is the caller's word on the number of windows; it is not relied on.
    """
    windows = normalize_windows(windows)
    wcols = [c for c in windows.columns if c not in ("mnx", "mxx", "mny", "mxy")]
    if strategy not in ("auto", "broadcast", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    inner, back = shielded(pts, wcols)
    out = [*(F.col(f"_w_{c}").alias(c) for c in wcols), *back]
    geo = windows.select(*(F.col(f"`{c}`").alias(f"_w_{c}") for c in wcols), "mnx", "mxx", "mny", "mxy")
    if strategy in ("auto", "broadcast"):
        limit = min(max_broadcast_rows, MAX_LOOP_ROWS) if strategy == "auto" else max_broadcast_rows
        w, small = maybe_broadcast(geo, limit)
        if small:
            return inner.join(w, in_envelope("x", "y", "mnx", "mxx", "mny", "mxy")).select(*out)
    qt = qt or quadtree(pts)
    pairs = materialize(pair_windows(geo, qt), "window-leaf-pairs")
    pairs, _ = maybe_broadcast(pairs, max_broadcast_rows)
    tagged = assign_leaves(inner, qt, max_broadcast_rows)
    return tagged.join(pairs, LEAF_KEY).where(in_envelope("x", "y", "mnx", "mxx", "mny", "mxy")).select(*out)


def range_counts(pts: DataFrame, windows: DataFrame, **kw) -> DataFrame:
    """Q3 + A1: ``(window_id, n)`` for every window, 0 for empty ones.

    The count is partially aggregated before the shuffle, so the shuffle
    carries one row per window per task whatever the data size.
    """
    counts = range_join(pts.select("id", "x", "y"), windows, **kw).groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"))
    return (windows.select("window_id").join(counts, "window_id", "left")
            .select("window_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


__all__ = ["range_query", "range_join", "range_counts", "normalize_windows"]
