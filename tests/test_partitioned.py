"""Leaf-partitioned points: same rows as the broadcast joins, reading only the touched leaves."""

from data_dirs import SF001
from quadrant.functions.generators import query_points, query_windows
from quadrant.operators.join import pip_join
from quadrant.operators.partitioned import leaf_pip_join, leaf_range_join, partition_by_leaves
from quadrant.operators.quadtree import quadtree
from quadrant.operators.range import range_join
from quadrant.plans.knn_join import knn_rings
from quadrant.sources.derived import points_a, points_b, points_d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_leaf_partitioned_joins_equal_broadcast(spark):
    a, b = points_a(spark, SF001), points_b(spark, SF001)
    lp = partition_by_leaves(b, quadtree(b, max_depth=8, cap=100), partitions=4)
    assert lp.points(spark).count() == b.count()
    rings = knn_rings(a, query_points(spark, 3, seed=14), 40, known_seeds=3)
    for pred in ("intersects", "interior"):
        want = pip_join(b, rings, pred, known_windows=3).select("window_id", "id", "x", "y")
        got = leaf_pip_join(spark, lp, rings, pred).select("window_id", "id", "x", "y")
        assert rows(got) == rows(want)
    files = [f for f in lp.points(spark).inputFiles() if f.endswith(".parquet")]
    assert len(files) <= 4  # files follow the partitions, not the leaves
    plan = leaf_pip_join(spark, lp, rings)._jdf.queryExecution().executedPlan().toString()
    assert "In(_leaf" in plan or "EqualTo(_leaf" in plan  # the touched leaves reach the reader


def test_leaf_partitioned_range_on_skewed_points(spark):
    d = points_d(spark, SF001)
    lp = partition_by_leaves(d, quadtree(d, max_depth=10, cap=50), partitions=4)
    w = query_windows(spark, 5, seed=3)
    want = range_join(d, w, known_windows=5).select("window_id", "id", "x", "y")
    got = leaf_range_join(spark, lp, w).select("window_id", "id", "x", "y")
    assert rows(got) == rows(want)
