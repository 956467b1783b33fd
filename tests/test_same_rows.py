"""Every strategy gives the same rows: repeated and NULL ids, foreign trees, wrong hints, large tables, clashing names, thin extents."""

import pytest
from data_dirs import SF001
from pyspark.sql import functions as F

from quadrant.functions.generators import query_points, query_windows
from quadrant.operators.index import build_index, index_knn_batch, index_pip_join, index_range_join, indexed
from quadrant.operators.join import pip_join
from quadrant.operators.knn import cell_size, knn, knn_batch
from quadrant.operators.partitioned import leaf_pip_join, leaf_range_join, partition_by_leaves
from quadrant.operators.quadtree import assign_leaves, pair_windows, quadtree
from quadrant.operators.range import range_join
from quadrant.plans.knn_join import knn_rings
from quadrant.session import ensure_checkpoint_dir
from quadrant.sources.derived import points_a, points_b, points_c, points_d

KEY = ["window_id", "id", "x", "y"]


def rows(df, cols=None):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def wide_points(spark, n=1500):
    """Points inside and far outside the unit square."""
    u = F.col("id")
    return spark.range(n).select("id", (((u * 7919 + 13) % 1009) / 336.0 - 1.0).alias("x"), (((u * 104729 + 71) % 1013) / 337.0 - 1.0).alias("y"))


def near_points(spark, n=1500):
    u = F.col("id")
    return spark.range(n).select("id", (((u * 31 + 5) % 503) / 1006.0).alias("x"), (((u * 57 + 1) % 509) / 1018.0).alias("y"))


def boxes(spark):
    return spark.createDataFrame(
        [(1, -0.4, -0.1, -0.4, 1.4), (1, -0.4, -0.1, -0.4, 1.4), (1, 0.1, 0.3, 0.2, 0.9), (None, 0.0, 2.0, 0.0, 2.0), (2, 0.25, 0.25, 0.25, 0.25),
         (3, -9.0, 9.0, -9.0, 9.0), (4, 5.0, 6.0, 5.0, 6.0), (5, None, 1.0, 0.0, 1.0)], "window_id long, mnx double, mxx double, mny double, mxy double")


def polygons(spark):
    corners = ["mnx mny", "mxx mny", "mxx mxy", "mnx mxy", "mnx mny"]
    square = "array(" + ", ".join("struct({} AS x1, {} AS y1, {} AS x2, {} AS y2)".format(*a.split(), *b.split()) for a, b in zip(corners, corners[1:])) + ")"
    return boxes(spark).where("mnx IS NOT NULL").withColumn("edges", F.expr(square))


@pytest.mark.parametrize("own, tree", [(wide_points, near_points), (near_points, wide_points), (near_points, near_points)])
def test_repeated_and_null_ids_and_foreign_trees(spark, own, tree):
    pts, qt = own(spark), quadtree(tree(spark), max_depth=8, cap=40)
    want = rows(range_join(pts, boxes(spark), strategy="broadcast"), KEY)
    assert want and rows(range_join(pts, boxes(spark), strategy="cells", qt=qt), KEY) == want
    lp = partition_by_leaves(pts, qt, partitions=3)
    assert rows(leaf_range_join(spark, lp, boxes(spark)), KEY) == want
    want = rows(pip_join(pts, polygons(spark), "covers", strategy="broadcast"), KEY)
    assert want and rows(pip_join(pts, polygons(spark), "covers", strategy="cells", qt=qt), KEY) == want
    assert rows(leaf_pip_join(spark, lp, polygons(spark), "covers"), KEY) == want


def test_indexed_joins_with_repeated_and_null_ids(spark):
    pts = wide_points(spark)
    idx = build_index(pts, partitions=3)
    assert rows(index_range_join(spark, idx, boxes(spark)), KEY) == rows(range_join(pts, boxes(spark)), KEY)
    assert rows(index_pip_join(spark, idx, polygons(spark)), KEY) == rows(pip_join(pts, polygons(spark)), KEY)


def test_slow_leaf_placement_takes_points_of_another_set(spark):
    import dataclasses
    qt = quadtree(near_points(spark), max_depth=6, cap=40)
    slow = dataclasses.replace(qt, cells=None, cell_depth=None)
    pts = wide_points(spark)
    assert rows(assign_leaves(pts, slow), ["id", "depth", "prefix"]) == rows(assign_leaves(pts, qt), ["id", "depth", "prefix"])
    assert assign_leaves(pts, qt).count() == pts.count()


def test_a_wrong_hint_changes_nothing(spark):
    pts, q = points_a(spark, SF001), query_points(spark, 11, seed=2)
    assert rows(knn_batch(pts, q, 10, known_queries=1)) == rows(knn_batch(pts, q, 10, strategy="cells")) and knn_batch(pts, q, 10, known_queries=1).count() == 110
    w = query_windows(spark, 6, seed=2)
    assert rows(range_join(pts, w, known_windows=1)) == rows(range_join(pts, w, strategy="cells"))


def test_large_query_and_window_tables(spark):
    pts = points_a(spark, SF001)
    q = query_points(spark, 20_000, seed=3)
    got = knn_batch(pts, q, 1)
    assert got.count() == 20_000
    few = query_points(spark, 20_000, seed=3).where("q % 2000 = 0")
    want = rows(knn_batch(pts, few, 1, strategy="brute"))
    assert rows(got.join(few.select("q"), "q", "left_semi").select(*got.columns)) == want
    idx = build_index(pts, partitions=3)
    assert rows(index_knn_batch(spark, idx, q, 1).join(few.select("q"), "q", "left_semi").select(*got.columns)) == want
    w = query_windows(spark, 300_000, seed=4).withColumn("mxx", F.col("mnx") + 0.001).withColumn("mxy", F.col("mny") + 0.001)
    one = range_join(pts, w, strategy="broadcast").groupBy("id").count()  # over the bound: goes through cells
    probe = pts.where("id % 500 = 1")
    want = rows(probe.crossJoin(w).where("x BETWEEN mnx AND mxx AND y BETWEEN mny AND mxy").groupBy("id").count())
    assert rows(one.join(probe.select("id"), "id", "left_semi")) == want


def test_cell_joins_never_plan_a_cartesian_product(spark):
    pts = points_c(spark, SF001)
    qt = quadtree(pts, max_depth=8, cap=30)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = pair_windows(query_windows(spark, 400, seed=5), qt)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set(key, before)


def test_a_third_of_the_rows_at_one_place(spark):
    d = points_d(spark, SF001)
    crowd = d.unionByName(spark.range(500).select((F.col("id") + 10**9).alias("id"), F.lit(-119.0).alias("x"), F.lit(34.5).alias("y")))
    w = query_windows(spark, 5, seed=6).unionByName(spark.createDataFrame([(99, -119.0, -119.0, 34.5, 34.5)], "window_id long, mnx double, mxx double, mny double, mxy double"))
    assert rows(range_join(crowd, w, strategy="cells")) == rows(range_join(crowd, w, strategy="broadcast"))
    q = spark.createDataFrame([(0, -119.0, 34.5), (1, -118.0, 33.0)], "q long, qx double, qy double")
    assert rows(knn_batch(crowd, q, 40, strategy="cells")) == rows(knn_batch(crowd, q, 40, strategy="brute"))


def test_knn_by_cells_far_away_few_points_and_thin_extents(spark):
    thin = spark.range(2000).select("id", (F.col("id") / 2000.0).alias("x"), ((F.col("id") % 7) * 1e-15).alias("y"))
    side = cell_size(thin, 10).first()["cell"]
    assert 1.0 / side <= 1001
    q = spark.createDataFrame([(0, 0.5, 0.0), (1, 1e5, -1e5), (2, -3.0, 2.0)], "q long, qx double, qy double")
    for pts, k in ((thin, 7), (thin, 5000), (thin.limit(3), 2), (thin.where("id < 0"), 3)):
        assert rows(knn_batch(pts, q, k, strategy="cells")) == rows(knn_batch(pts, q, k, strategy="brute"))


def test_carried_columns_keep_their_names(spark):
    names = ["depth", "prefix", "mnx", "mxy", "gx", "gy", "zkey", "zcell", "leaf", "edges", "cx", "_code"]
    pts = near_points(spark)
    for i, c in enumerate(names):
        pts = pts.withColumn(c, F.col("id") * 10 + i)
    cols = ["window_id", "id", *names]
    want = rows(range_join(pts, boxes(spark), strategy="broadcast"), cols)
    assert want and rows(range_join(pts, boxes(spark), strategy="cells"), cols) == want
    assert rows(pip_join(pts, polygons(spark), strategy="cells"), cols) == rows(pip_join(pts, polygons(spark)), cols)
    idx = build_index(pts, partitions=2)
    assert rows(index_range_join(spark, idx, boxes(spark)), cols) == want
    assert rows(leaf_range_join(spark, partition_by_leaves(pts, partitions=2), boxes(spark)), cols) == want
    assert rows(knn(pts, 0.1, 0.1, 5, strategy="cells"), ["rank", "id", *names]) == rows(knn(pts, 0.1, 0.1, 5), ["rank", "id", *names])
    with pytest.raises(ValueError):
        knn(pts.withColumn("rank", F.lit(1)), 0.1, 0.1, 5)


def test_operators_leave_the_session_as_it_is(spark):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key, None)
    assert knn(points_a(spark, SF001), -119.0, 34.5, 1200).count() == 1200
    assert spark.conf.get(key, None) == before


def test_a_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_an_index_is_built_once_per_table_and_settings(spark):
    pts = points_b(spark, SF001)
    one, two = indexed(pts, partitions=2), indexed(points_b(spark, SF001), partitions=2)
    assert one.path == two.path and indexed(pts, partitions=3).path != one.path
    rings = knn_rings(points_a(spark, SF001), query_points(spark, 2, seed=1), 20)
    assert rows(index_pip_join(spark, two, rings), KEY) == rows(pip_join(pts, rings), KEY)
