"""Rings as tables of edges, running neighbours on a stream, stored row numbers, bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from data_dirs import SF001
from quadrant.functions.generators import query_points
from quadrant.operators.join import grouped_summary, grouped_summary_bitmap, pip_join
from quadrant.operators.knn import knn_batch
from quadrant.operators.slabs import LEVELS, slab_edges, slab_pip_join
from quadrant.plans.knn_join import knn_rings
from quadrant.sources.derived import points_a, points_b
from quadrant.sources.points import points
from quadrant.streaming.points import knn_so_far, stream_knn

POINTS = "id long, x double, y double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edge_rows(rings):
    return rings.select("window_id", F.explode("edges").alias("e")).select("window_id", "e.x1", "e.y1", "e.x2", "e.y2")


@pytest.mark.parametrize("predicate", ["covers", "interior"])
def test_slabs_equal_arrays(spark, predicate):
    pts = points_b(spark, SF001).withColumn("_level", F.col("id") % 3).withColumn("_row", F.lit("x"))
    rings = knn_rings(points_a(spark, SF001), query_points(spark, 6, seed=3), 60, known_seeds=6)
    want = rows(pip_join(pts, rings, predicate).select("window_id", *pts.columns))
    assert rows(slab_pip_join(pts, edge_rows(rings), predicate).select("window_id", *pts.columns)) == want and want


def test_hand_shapes_repeats_and_null_windows(spark):
    square = [(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)]
    bow = [(0.0, 0.0, 2.0, 2.0), (2.0, 2.0, 2.0, 0.0), (2.0, 0.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)]
    flat = [(0.0, 1.0, 1.0, 1.0), (1.0, 1.0, 2.0, 1.0), (2.0, 1.0, 0.0, 1.0)]
    edges = spark.createDataFrame([(w, *e) for w, ring in ((1, square), (2, bow), (None, square), (3, flat)) for e in ring], "window_id long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (None, 1.0, 0.5), (3, 0.0, 0.0), (4, 3.0, 1.0), (5, 1.0, 2.0)], POINTS)
    covers = [(w, i) for w, i, _, _ in rows(slab_pip_join(pts, edges, "covers"))]
    assert sorted(covers, key=repr) == sorted([(1, 1), (1, 1), (1, None), (1, 3), (1, 5), (None, 1), (None, 1), (None, None), (None, 3), (None, 5),
                                               (2, 1), (2, 1), (2, 3), (3, 1), (3, 1)], key=repr)
    inner = [(w, i) for w, i, _, _ in rows(slab_pip_join(pts, edges, "interior"))]
    assert sorted(inner, key=repr) == sorted([(1, 1), (1, 1), (1, None), (None, 1), (None, 1), (None, None)], key=repr)
    assert slab_pip_join(pts, edges.limit(0)).count() == 0 and slab_pip_join(pts.limit(0), edges).count() == 0


def test_a_ring_of_many_edges(spark):
    """A jagged ring of 100,000 edges; a point meets few of them, and no row holds the ring."""
    rng, n = random.Random(5), 100_000
    edges = spark.range(n - 1).select(F.lit(0).cast("long").alias("window_id"), (F.col("id") / n).alias("x1"), (1 + F.col("id") * 7919 % 1009 / 1009.0 * 0.01).alias("y1"),
                                      ((F.col("id") + 1) / n).alias("x2"), (1 + (F.col("id") + 1) * 7919 % 1009 / 1009.0 * 0.01).alias("y2"))
    height = lambda i: 1 + i * 7919 % 1009 / 1009.0 * 0.01
    close = [(0, (n - 1) / n, height(n - 1), (n - 1) / n, 0.0), (0, (n - 1) / n, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0, height(0))]
    edges = edges.unionByName(spark.createDataFrame(close, edges.schema))
    at = [(i, rng.random(), rng.random() * 1.02) for i in range(400)]
    boxes, filed = slab_edges(edges)
    assert filed.count() <= 3 * n and filed.agg(F.max("_level")).first()[0] <= LEVELS
    got = {r.id for r in slab_pip_join(spark.createDataFrame(at, POINTS), edges).collect()}

    def inside(x, y):
        i = min(int(x * n), n - 2)
        if x > (n - 1) / n or y < 0:
            return None
        a, b = i / n, (i + 1) / n
        top = height(i) + (height(i + 1) - height(i)) * (x - a) / (b - a)
        return None if abs(top - y) < 1e-6 else y < top
    assert all((i in got) == inside(x, y) for i, x, y in at if inside(x, y) is not None)


def test_running_neighbours_equal_batch_after_each_batch(spark, tmp_path):
    pts = points_a(spark, SF001).withColumn("name", F.concat(F.lit("n"), "id"))
    queries = query_points(spark, 4, seed=6)
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    arrived = None
    for number in range(4):
        part = pts.where(F.col("id") % 4 == number)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream_knn(stream, queries, 20, path, checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        arrived = part if arrived is None else arrived.unionByName(part)
        want = knn_batch(arrived, queries, 20).select("q", "rank", "id", "x", "y", "d2", "name")
        assert rows(knn_so_far(spark, path, number)) == rows(want)


def test_numbers_are_stored(spark, tmp_path):
    spark.range(100).select((F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("y")).repartition(5).write.parquet(str(tmp_path / "p"))
    numbered = points(spark.read.parquet(str(tmp_path / "p")))
    assert numbered.select("id").distinct().count() == 100
    assert "numbered-points" in numbered.inputFiles()[0]
    with pytest.raises(ValueError):
        points(spark.readStream.schema("x double, y double").parquet(str(tmp_path / "p")))


def test_bitmaps_count_distinct_ids(spark):
    m = spark.createDataFrame([(1, 5), (1, 5), (1, 40_000), (1, -3), (1, None), (None, 7), (2, None), (3, 2**40), (3, 2**40 + 1)], "window_id long, id long")
    assert rows(grouped_summary_bitmap(m)) == rows(grouped_summary(m))
    assert "Expand" not in grouped_summary_bitmap(m)._jdf.queryExecution().executedPlan().toString()
