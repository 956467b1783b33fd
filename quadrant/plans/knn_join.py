"""K nearest neighbours of a seed -> ring polygon -> spatial join.

One lazy DataFrame plan: kNN over the first point set, the ring of those k
points in distance order, then a point-in-polygon join with the second set.
The ring table has at most one row per seed and k edges per row, a bound set
by the call's parameters, so it is broadcast without a measurement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadrant.functions.generators import point_literal
from quadrant.operators.join import pip_join
from quadrant.operators.knn import DEFAULT_CELL, knn_batch
from quadrant.operators.quadtree import QuadTree
from quadrant.operators.ring import ring_polygons


def knn_rings(pts: DataFrame, seeds: DataFrame, k: int = 100, knn_strategy: str = "auto",
              cell: float | str = DEFAULT_CELL, known_seeds: int | None = None) -> DataFrame:
    """Rings ``(window_id = q, edges, bbox, n_vertices)`` from each seed's k neighbours."""
    nn = knn_batch(pts.select("id", "x", "y"), seeds, k, strategy=knn_strategy, cell=cell,
                   known_queries=known_seeds)
    return ring_polygons(nn.select("q", "rank", "x", "y"))


def knn_join(pts_a: DataFrame, pts_b: DataFrame, seeds: DataFrame, k: int = 100,
             predicate: str = "intersects", strategy: str = "broadcast",
             knn_strategy: str = "auto", qt: QuadTree | None = None,
             cell: float | str = DEFAULT_CELL, known_seeds: int | None = None) -> DataFrame:
    """``(window_id, ...points of B)`` for every seed's ring.

    ``strategy='broadcast'`` is J5 (ring broadcast, bbox-guarded test);
    ``strategy='cells'`` is J6 (quad-tree leaf equi-join).  Several seed rows
    make it J7, each seed running its own ring.
    """
    rings = knn_rings(pts_a, seeds, k, knn_strategy, cell, known_seeds)
    return pip_join(pts_b, rings, predicate=predicate, strategy=strategy, qt=qt,
                    known_windows=known_seeds, known_edges=k)


def knn_join_point(pts_a: DataFrame, pts_b: DataFrame, qx: float, qy: float, k: int = 100,
                   **kw) -> DataFrame:
    """J5/J6 for one literal seed point."""
    seeds = point_literal(pts_a.sparkSession, qx, qy)
    return knn_join(pts_a, pts_b, seeds, k, known_seeds=1, **kw)


__all__ = ["knn_rings", "knn_join", "knn_join_point"]
