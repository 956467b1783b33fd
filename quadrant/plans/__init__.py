from quadrant.plans.knn_join import knn_join, knn_join_point, knn_rings  # noqa: F401
