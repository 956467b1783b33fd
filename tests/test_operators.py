"""Operators on the driver's tables: equivalence pairs, properties and edge inputs."""

import math
import sys

import pytest
from pyspark.sql import functions as F

from data_dirs import SF001, SF01
from quadrant.functions.generators import query_points, query_windows, query_point_value, query_window_value
from quadrant.operators.join import grouped, grouped_summary, matched_window_count, pip_join
from quadrant.operators.knn import knn, knn_batch
from quadrant.operators.quadtree import assign_leaves, quadtree
from quadrant.operators.range import range_counts, range_join, range_query
from quadrant.plans.knn_join import knn_join, knn_join_point, knn_rings
from quadrant.sources.derived import points_a, points_b, points_c, points_d
from quadrant.sources.points import extent


def rows(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_generators_match_python_values(spark):
    w = query_windows(spark, 3, seed=4).collect()
    for r in w:
        assert (r.mnx, r.mxx, r.mny, r.mxy) == query_window_value(r.window_id, 4)
        assert r.mnx <= r.mxx and r.mny <= r.mxy
    q = query_points(spark, 3, seed=9).collect()
    for r in q:
        assert (r.qx, r.qy) == query_point_value(r.q, 9)


def test_derived_points_inside_extent(spark):
    e = extent(points_b(spark, SF001)).collect()[0]
    assert -120.284557 <= e.minx <= e.maxx < -117.618988
    assert 32.806193 <= e.miny <= e.maxy < 36.485821
    assert e.n == spark.read.parquet(f"{SF001}/lineitem.parquet").count()


def test_range_reversed_corners_same_rows(spark):
    pts = points_b(spark, SF001)
    a = range_query(pts, -119.5, -118.5, 33.5, 35.0)
    b = range_query(pts, -118.5, -119.5, 35.0, 33.5)
    assert rows(a) == rows(b)
    assert a.count() > 0


def test_range_zero_area_window_on_a_point(spark):
    pts = points_c(spark, SF001)
    p = pts.orderBy("id").first()
    got = range_query(pts, p.x, p.x, p.y, p.y).select("id").collect()
    assert [r.id for r in got] == [p.id]


def test_range_broadcast_equals_cells(spark):
    pts = points_d(spark, SF001)
    w = query_windows(spark, 6, seed=2)
    qt = quadtree(pts, max_depth=8, cap=50)
    a = range_join(pts, w, strategy="broadcast", known_windows=6)
    b = range_join(pts, w, strategy="cells", qt=qt)
    assert rows(a) == rows(b)


def test_range_counts_report_empty_windows(spark):
    pts = points_b(spark, SF001)
    far = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0), (1, -120.0, -118.0, 33.0, 35.0)],
                                "window_id BIGINT, mnx DOUBLE, mxx DOUBLE, mny DOUBLE, mxy DOUBLE")
    got = {r.window_id: r.n for r in range_counts(pts, far).collect()}
    assert got[0] == 0 and got[1] > 0


def test_range_half_open_tiles_sum_to_n(spark):
    pts = points_c(spark, SF001)
    n = pts.count()
    # 4 x 4 tiles; closed windows, so shrink each tile's upper edges by one ulp.
    e = extent(pts).collect()[0]
    xs = [e.minx + (e.maxx - e.minx) * i / 4 for i in range(5)]
    ys = [e.miny + (e.maxy - e.miny) * i / 4 for i in range(5)]
    xs[-1] = math.nextafter(e.maxx, math.inf)
    ys[-1] = math.nextafter(e.maxy, math.inf)
    tiles = [(i * 4 + j, xs[i], math.nextafter(xs[i + 1], -math.inf), ys[j], math.nextafter(ys[j + 1], -math.inf))
             for i in range(4) for j in range(4)]
    w = spark.createDataFrame(tiles, "window_id BIGINT, mnx DOUBLE, mxx DOUBLE, mny DOUBLE, mxy DOUBLE")
    total = range_counts(pts, w).agg(F.sum("n")).collect()[0][0]
    assert total == n


@pytest.mark.parametrize("k", [1, 5, 1000, 20000])
def test_knn_sort_equals_cells(spark, k):
    pts = points_a(spark, SF01)
    for qx, qy in [(-119.0, 34.5), (-125.0, 30.0), query_point_value(3, 1)]:
        a = knn(pts, qx, qy, k, strategy="sort")
        b = knn(pts, qx, qy, k, strategy="cells", cell=0.05)
        ra, rb = rows(a), rows(b)
        assert ra == rb
        assert len(ra) == min(k, pts.count())


def test_knn_distances_non_decreasing_and_ties_by_id(spark):
    pts = points_b(spark, SF001)
    got = knn(pts, -119.0, 34.5, 50).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 51))
    keys = [(r.d2, r.id) for r in got]
    assert keys == sorted(keys)


def test_knn_batch_brute_equals_cells(spark):
    pts = points_a(spark, SF001)
    q = query_points(spark, 7, seed=3)
    for k in (1, 10, 300):
        a = knn_batch(pts, q, k, strategy="brute", known_queries=7)
        b = knn_batch(pts, q, k, strategy="cells", cell=0.1, known_queries=7)
        assert rows(a) == rows(b)


def test_knn_edge_inputs(spark):
    empty = points_a(spark, SF001).where(F.lit(False))
    assert knn(empty, -119.0, 34.5, 10).count() == 0
    assert knn(points_a(spark, SF001), -119.0, 34.5, 0).count() == 0
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "id BIGINT, x DOUBLE, y DOUBLE")
    got = knn(same, 0.0, 0.0, 3).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2]


def test_points_drop_null_and_nan(spark):
    from quadrant.sources.points import points
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, None)],
                               "pid BIGINT, px DOUBLE, py DOUBLE")
    got = points(df, x="px", y="py", id="pid").collect()
    assert [(r.id, r.x, r.y) for r in got] == [(1, 1.0, 2.0)]


def test_pip_broadcast_equals_cells_and_ring_size(spark):
    a, b = points_a(spark, SF01), points_b(spark, SF01)
    seeds = query_points(spark, 4, seed=21)
    rings = knn_rings(a, seeds, 100, known_seeds=4)
    assert [r.n_vertices for r in rings.collect()] == [100] * 4
    qt = quadtree(b, max_depth=10, cap=300)
    for pred in ("intersects", "covers", "interior"):
        x = pip_join(b, rings, pred, strategy="broadcast", known_windows=4)
        y = pip_join(b, rings, pred, strategy="cells", qt=qt, known_windows=4)
        assert rows(x) == rows(y)
    inter = pip_join(b, rings, "intersects", known_windows=4).count()
    interior = pip_join(b, rings, "interior", known_windows=4).count()
    assert inter >= interior > 0


def test_knn_join_fixture_counts(spark):
    # Known from the fixture notes: 169 rows of B around (-119, 34.5) with k=100 at sf0.01.
    m = knn_join_point(points_a(spark, SF01), points_b(spark, SF01), -119.0, 34.5, 100)
    assert m.count() == 169
    assert m.select("id").distinct().count() == 123
    assert matched_window_count(m).collect()[0].n_windows == 1
    assert grouped(m).count() == 123
    s = grouped_summary(m).collect()[0]
    assert (s.n_matches, s.n_ids) == (169, 123)


def test_knn_join_cells_equals_broadcast(spark):
    a, b = points_a(spark, SF001), points_b(spark, SF001)
    seeds = query_points(spark, 3, seed=5)
    x = knn_join(a, b, seeds, 50, strategy="broadcast", known_seeds=3)
    y = knn_join(a, b, seeds, 50, strategy="cells", knn_strategy="cells", cell=0.1,
                 qt=quadtree(b, max_depth=8, cap=100), known_seeds=3)
    assert rows(x) == rows(y)


def test_quadtree_properties(spark):
    pts = points_d(spark, SF01)
    n = pts.count()
    qt = quadtree(pts, max_depth=12, cap=300)
    leaves = qt.leaves.collect()
    assert sum(r.n for r in leaves) == n
    assert all(r.n <= 300 or r.depth == 12 for r in leaves)
    assert len({r.depth for r in leaves}) > 1  # skewed data -> leaves at several depths
    tagged = assign_leaves(pts, qt)
    assert tagged.count() == n
    per_leaf = {(r.depth, r.prefix): r.n for r in leaves}
    got = {(r.depth, r.prefix): r["count"] for r in tagged.groupBy("depth", "prefix").count().collect()}
    assert got == per_leaf


def test_quadtree_target_leaves_and_degenerate_extent(spark):
    pts = points_b(spark, SF001)
    qt = quadtree(pts, max_depth=10, target_leaves=16)
    assert qt.n_leaves >= 4
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(20)], "id BIGINT, x DOUBLE, y DOUBLE")
    qt2 = quadtree(same, max_depth=6, cap=5)
    leaves = qt2.leaves.collect()
    assert len(leaves) == 1 and leaves[0].n == 20 and leaves[0].depth == 6
    assert assign_leaves(same, qt2).count() == 20


def test_over_bound_windows_fall_back_to_cells(spark):
    # max_broadcast_rows=1 forces the shuffle-based path for both joins.
    a, b = points_a(spark, SF001), points_b(spark, SF001)
    rings = knn_rings(a, query_points(spark, 3, seed=12), 30, known_seeds=3)
    want = rows(pip_join(b, rings, known_windows=3))
    got = pip_join(b, rings, strategy="auto", max_broadcast_rows=1,
                   qt=quadtree(b, max_depth=8, cap=100))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan  # equi-join on the leaf key
    assert rows(got) == want
    w = query_windows(spark, 5, seed=9)
    want = rows(range_join(b, w, known_windows=5))
    got = range_join(b, w, strategy="auto", max_broadcast_rows=1, qt=quadtree(b, max_depth=8, cap=100))
    assert rows(got) == want


def test_empty_window_table(spark):
    pts = points_b(spark, SF001)
    empty = query_windows(spark, 0)
    assert range_counts(pts, empty).count() == 0
    assert range_join(pts, empty).count() == 0


def test_batch_knn_over_the_broadcast_bound_gives_the_same_rows(spark):
    pts = points_a(spark, SF001)
    q = query_points(spark, 5, seed=1)
    assert rows(knn_batch(pts, q, 3, max_broadcast_rows=2)) == rows(knn_batch(pts, q, 3, strategy="brute"))


def test_many_windows_use_cells_not_a_loop(spark):
    # More windows than MAX_LOOP_ROWS: auto must not test every point against every window.
    pts = points_c(spark, SF001)
    w = query_windows(spark, 300, seed=31)
    got = range_join(pts, w, known_windows=300, qt=quadtree(pts, max_depth=8, cap=50))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    want = range_join(pts, w, strategy="broadcast", known_windows=300)
    assert rows(got) == rows(want)


def test_assign_single_probe_equals_depth_explode(spark):
    import dataclasses
    pts = points_b(spark, SF001)
    qt = quadtree(pts, max_depth=10, cap=40)
    assert qt.cells is not None
    slow = dataclasses.replace(qt, cells=None, cell_depth=None)
    cols = ["id", "x", "y", "depth", "prefix"]
    assert rows(assign_leaves(pts, qt), cols) == rows(assign_leaves(pts, slow), cols)


def test_batch_ranking_sorts_only_points_that_can_be_among_the_nearest(spark, monkeypatch):
    """Not points x queries rows: the sort of a task would spill on large tables."""
    knn_module = sys.modules[knn_batch.__module__]
    n, k = 5000, 20
    pts = spark.range(n).select(F.col("id"), ((F.col("id") * 37 + 11) % 997).cast("double").alias("x"), ((F.col("id") * 91 + 5) % 991).cast("double").alias("y"))
    queries = spark.createDataFrame([(0, 100.0, 100.0), (1, 500.5, 20.0), (None, 990.0, 990.0), (3, 11.0, 5.0)], "q BIGINT, qx DOUBLE, qy DOUBLE")
    met, ranked = [], knn_module._ranked
    monkeypatch.setattr(knn_module, "_ranked", lambda df, k: (met.append(df.count()), ranked(df, k))[1])
    got = {(r.q, r["rank"]): (r.id, r.d2) for r in knn_module.knn_batch(pts, queries, k, strategy="brute").collect()}
    assert 4 * k <= met[0] <= 12 * k
    rows = [(r.id, r.x, r.y) for r in pts.collect()]
    for q, qx, qy in queries.collect():
        best = sorted((((x - qx) * (x - qx) + (y - qy) * (y - qy)), i) for i, x, y in rows)[:k]
        assert [got[q, i + 1] for i in range(k)] == [(i, d) for d, i in best]
    one = knn_module.knn(pts, 100.0, 100.0, k, strategy="brute")
    assert [r.id for r in one.orderBy("rank").collect()] == [got[0, i + 1][0] for i in range(k)] and met[1] <= 3 * k


def test_ranking_of_equal_missing_and_endless_distances(spark):
    """Ties at the k-th go by id, NULL distances come first and NaN last, and few points all stay."""
    inf, nan = float("inf"), float("nan")
    pts = spark.createDataFrame([(i, 1.0, 1.0) for i in range(30, 0, -1)] + [(31, None, 0.0), (32, 1e200, 0.0), (33, nan, 0.0), (34, inf, 0.0), (35, 0.0, 0.0)], "id BIGINT, x DOUBLE, y DOUBLE")
    queries = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "q BIGINT, qx DOUBLE, qy DOUBLE")
    ids = lambda k: {q: [r.id for r in knn_batch(pts, queries, k, strategy="brute").where(f"q = {q}").orderBy("rank").collect()] for q in (0, 1)}
    assert ids(5) == {0: [31, 35, 1, 2, 3], 1: [31, 1, 2, 3, 4]}
    assert ids(99) == {0: [31, 35, *range(1, 31), 32, 34, 33], 1: [31, *range(1, 31), 35, 32, 34, 33]}
