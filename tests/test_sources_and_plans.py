"""File sources and physical-plan checks."""

import os
import tempfile

from pyspark.sql import functions as F

from data_dirs import SF001
from quadrant.functions.generators import query_points
from quadrant.operators.knn import knn, knn_batch
from quadrant.operators.join import pip_join
from quadrant.operators.layout import read_clustered, write_clustered
from quadrant.operators.range import range_counts, range_query
from quadrant.plans.knn_join import knn_join_point, knn_rings
from quadrant.sources.derived import points_a, points_b
from quadrant.sources.points import points_sql, read_points


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _tmp():
    return tempfile.mkdtemp(prefix="quadrant-test-")


def test_csv_source_keeps_carried_columns_and_drops_bad_lines(spark):
    d = _tmp()
    with open(os.path.join(d, "p.csv"), "w") as f:
        f.write("-119.0,34.0,foo,7\n-118.5,33.0,bar,\nbad,34.1,baz,1\n-118.0,33.5\n-117.9,33.1,a,2,extra\n")
    df = read_points(spark, d, schema="x DOUBLE, y DOUBLE, name STRING, v INT")
    assert df.columns == ["id", "x", "y", "name", "v"]
    got = sorted((r.x, r.y, r.name, r.v) for r in df.collect())
    assert got == [(-119.0, 34.0, "foo", 7), (-118.5, 33.0, "bar", None),
                   (-118.0, 33.5, None, None), (-117.9, 33.1, "a", 2)]
    assert df.select("id").distinct().count() == 4


def test_csv_offset(spark):
    d = _tmp()
    with open(os.path.join(d, "p.csv"), "w") as f:
        f.write("a,-119.0,34.0\nb,-118.0,33.0\n")
    df = read_points(spark, d, offset=1, carry=False)
    assert sorted((r.x, r.y) for r in df.collect()) == [(-119.0, 34.0), (-118.0, 33.0)]


def test_json_document_source(spark):
    d = _tmp()
    with open(os.path.join(d, "p.json"), "w") as f:
        f.write('{"x": -119.0, "y": 34.0}\n{"x": -118.0}\n{"x": -117.5, "y": 33.5, "z": 1}\n')
    df = read_points(spark, d, format="json")
    assert sorted((r.x, r.y) for r in df.collect()) == [(-119.0, 34.0), (-117.5, 33.5)]


def test_sql_projection_view(spark):
    pts = points_b(spark, SF001)
    got = points_sql(spark, pts, view="origin", columns="x, y")
    assert got.columns == ["x", "y"] and got.count() == pts.count()


def test_clustered_layout_same_rows_and_pushed_filters(spark):
    pts = points_b(spark, SF001)
    path = write_clustered(pts, partitions=4, rows_per_group=256)
    table = read_clustered(spark, path)
    a = range_query(pts, -119.5, -119.0, 34.0, 34.5).select("id", "x", "y")
    b = range_query(table, -119.5, -119.0, 34.0, 34.5).select("id", "x", "y")
    assert sorted(a.collect()) == sorted(b.collect())
    plan = _plan(b)
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x," in plan


def test_knn_sort_plans_as_take_ordered(spark):
    plan = _plan(knn(points_a(spark, SF001), -119.0, 34.5, 10))
    assert "TakeOrderedAndProject" in plan


def test_batch_plans_never_cartesian(spark):
    a, b = points_a(spark, SF001), points_b(spark, SF001)
    q = query_points(spark, 3, seed=1)
    for df in (knn_batch(a, q, 5, strategy="brute", known_queries=3),
               range_counts(b, query_points(spark, 2).select(
                   F.col("q").alias("window_id"), F.col("qx").alias("mnx"), (F.col("qx") + 0.5).alias("mxx"),
                   F.col("qy").alias("mny"), (F.col("qy") + 0.5).alias("mxy")), known_windows=2),
               knn_join_point(a, b, -119.0, 34.5, 20)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan
        assert "Broadcast" in plan


def test_pip_join_guard_keeps_bbox_first(spark):
    a, b = points_a(spark, SF001), points_b(spark, SF001)
    rings = knn_rings(a, query_points(spark, 2, seed=3), 30, known_seeds=2)
    plan = _plan(pip_join(b, rings, known_windows=2))
    assert "BroadcastNestedLoopJoin" in plan
    assert "CASE WHEN" in plan


def test_persisted_reuse_and_release(spark):
    from quadrant.session import persisted
    pts = points_b(spark, SF001)
    with persisted(pts) as p:
        assert p.is_cached
        a = range_query(p, -119.5, -119.0, 34.0, 34.5).count()
        b = range_query(p, -119.5, -119.0, 34.0, 34.5).count()
        assert a == b
    assert not p.is_cached


def test_carried_columns_flow_through_operators(spark):
    from quadrant.operators.knn import knn
    from quadrant.operators.index import build_index, index_range
    d = _tmp()
    with open(os.path.join(d, "p.csv"), "w") as f:
        for i in range(60):
            f.write(f"{-119.0 + (i % 8) * 0.1},{34.0 + (i // 8) * 0.1},name{i},{i}\n")
    pts = read_points(spark, d, schema="x DOUBLE, y DOUBLE, name STRING, v INT")
    assert knn(pts, -118.7, 34.3, 5).columns == ["rank", "id", "x", "y", "d2", "name", "v"]
    got = range_query(pts, -118.85, -118.55, 34.15, 34.45)
    assert sorted(r.v for r in got.collect()) == sorted(
        i for i in range(60) if -118.85 <= -119.0 + (i % 8) * 0.1 <= -118.55
        and 34.15 <= 34.0 + (i // 8) * 0.1 <= 34.45)
    rings = knn_rings(pts, query_points(spark, 1, seed=2), 6, known_seeds=1)
    assert "name" in pip_join(pts, rings, known_windows=1).columns
    idx = build_index(pts, partitions=2)
    assert {"name", "v"} <= set(index_range(spark, idx, -119.0, -118.0, 34.0, 35.0).columns)


def test_parquet_source_pushes_filters(spark):
    d = _tmp() + "/pts"
    points_b(spark, SF001).write.parquet(d)
    pts = read_points(spark, d, format="parquet", id="id")
    plan = _plan(range_query(pts, -119.5, -119.0, 34.0, 34.5))
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x," in plan
    assert "ReadSchema: struct<id:bigint,x:double,y:double>" in plan
