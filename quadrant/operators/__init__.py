from quadrant.operators.range import range_query, range_join, range_counts, normalize_windows  # noqa: F401
from quadrant.operators.knn import knn, knn_batch, candidate_cells  # noqa: F401
from quadrant.operators.ring import ring_edges, ring_polygons, polygon_from_vertices  # noqa: F401
from quadrant.operators.join import pip_join, grouped, grouped_summary, matched_window_count  # noqa: F401
from quadrant.operators.quadtree import QuadTree, quadtree, assign_leaves, pair_windows, windows_to_leaves  # noqa: F401
from quadrant.operators.layout import zorder, write_clustered, read_clustered  # noqa: F401
from quadrant.operators.sizing import rows_at_most, maybe_broadcast  # noqa: F401
from quadrant.operators.index import (  # noqa: F401
    SpatialIndex, build_index, indexed, open_index, index_range, index_range_join, index_knn, index_knn_batch,
    index_pip_join, index_knn_join,
)
from quadrant.operators.partitioned import (  # noqa: F401
    LeafPartitioned, partition_by_leaves, leaf_pip_join, leaf_range_join,
)
