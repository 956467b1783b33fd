"""Close a ring through ordered points and make a polygon window.

The reference takes the k nearest neighbours of a seed in distance order,
appends the first one again and builds a polygon from that ring.  Here the
ring stays a DataFrame: each vertex is joined to the next by ``lead`` and the
last one back to the first by ``first``; no collect, no parallelize.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring_edges(ordered: DataFrame, group: str = "q", order: str = "rank") -> DataFrame:
    """``(q, seq, x1, y1, x2, y2)``: one directed edge per vertex, closing the ring.

    ``ordered`` holds the vertices ``(q, rank, x, y)``; ``rank`` gives the order.
    """
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ordered.select(
        F.col(group), F.col(order).cast("int").alias("seq"),
        F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"))


def ring_polygons(ordered: DataFrame, group: str = "q", order: str = "rank",
                  min_vertices: int = 3) -> DataFrame:
    """Polygon windows ``(window_id, edges, mnx, mxx, mny, mxy, n_vertices)``.

    Groups with fewer than ``min_vertices`` points yield no window.  Each group
    has at most k vertices (the kNN bound), so the collected edge array is
    bounded by the caller's own parameter.
    """
    edges = ring_edges(ordered, group, order)
    return (edges.groupBy(group)
            .agg(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("_e"),
                 F.min("x1").alias("mnx"), F.max("x1").alias("mxx"),
                 F.min("y1").alias("mny"), F.max("y1").alias("mxy"),
                 F.count(F.lit(1)).alias("n_vertices"))
            .where(F.col("n_vertices") >= min_vertices)
            .select(F.col(group).cast("bigint").alias("window_id"),
                    F.transform("_e", lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"),
                                                         e["x2"].alias("x2"), e["y2"].alias("y2")))
                    .alias("edges"),
                    "mnx", "mxx", "mny", "mxy", "n_vertices"))


def polygon_from_vertices(vertices: DataFrame, window_id: str = "window_id",
                          order: str = "seq") -> DataFrame:
    """A polygon window table from explicit vertex rows ``(window_id, seq, x, y)``."""
    ordered = vertices.select(F.col(window_id).alias("q"), F.col(order).alias("rank"), "x", "y")
    return ring_polygons(ordered)


__all__ = ["ring_edges", "ring_polygons", "polygon_from_vertices"]
