"""quadrant: spatial queries over 2-D point sets on Spark DataFrames.

Range queries, k-nearest neighbours, point-in-polygon joins and the composite
kNN -> ring polygon -> join, each as DataFrame -> DataFrame operators with
plain and cell-based strategies that return the same rows.
"""

from quadrant.sources import points, read_points, points_sql, extent  # noqa: F401
from quadrant.operators import (  # noqa: F401
    range_query, range_join, range_counts, knn, knn_batch, ring_edges, ring_polygons,
    polygon_from_vertices, pip_join, grouped, grouped_summary, matched_window_count,
    quadtree, assign_leaves, windows_to_leaves, zorder, write_clustered, read_clustered,
    SpatialIndex, build_index, open_index, index_range, index_range_join, index_knn, index_knn_batch,
    index_pip_join, index_knn_join, LeafPartitioned, partition_by_leaves, leaf_pip_join, leaf_range_join,
)
from quadrant.plans import knn_join, knn_join_point, knn_rings  # noqa: F401
