"""Points arriving as files: streaming range and polygon join equal the batch operators."""

import os
import tempfile

from data_dirs import SF001
from quadrant.functions.generators import query_points
from quadrant.operators.join import pip_join
from quadrant.operators.range import range_query
from quadrant.plans.knn_join import knn_rings
from quadrant.sources.derived import b_from, points_a, points_b
from quadrant.streaming import read_points_stream, run_available, stream_pip_join, stream_range, table_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_stream_source_drops_unparsable_points(spark):
    d = tempfile.mkdtemp(prefix="quadrant-stream-")
    for i, body in enumerate(["-119.0,34.0,1\nbad,34.1,2\n", "-118.5,33.0,3\n-118.0,,4\n"]):
        with open(os.path.join(d, f"part-{i}.csv"), "w") as f:
            f.write(body)
    s = read_points_stream(spark, d, "x DOUBLE, y DOUBLE, id BIGINT", max_files_per_trigger=1)
    got = run_available(s.select("id", "x", "y"), "csv-test")
    assert rows(got) == [(1, -119.0, 34.0), (3, -118.5, 33.0)]


def test_stream_operators_equal_batch(spark):
    pts = b_from(table_stream(spark, SF001, "lineitem"))
    w = (-119.5, -118.5, 33.5, 35.0)
    got = run_available(stream_range(pts, *w).select("id", "x", "y"), "range-test")
    assert rows(got) == rows(range_query(points_b(spark, SF001), *w).select("id", "x", "y"))
    rings = knn_rings(points_a(spark, SF001), query_points(spark, 3, seed=6), 40, known_seeds=3)
    got = run_available(stream_pip_join(pts, rings, known_windows=3).select("window_id", "id", "x", "y"),
                        "pip-test")
    want = pip_join(points_b(spark, SF001), rings, known_windows=3).select("window_id", "id", "x", "y")
    assert rows(got) == rows(want)


def test_stream_pip_join_many_windows_uses_cells(spark):
    pts = b_from(table_stream(spark, SF001, "lineitem"))
    rings = knn_rings(points_a(spark, SF001), query_points(spark, 300, seed=8), 10, known_seeds=300)
    got = run_available(stream_pip_join(pts, rings, known_windows=300).select("window_id", "id", "x", "y"),
                        "pip-many")
    want = pip_join(points_b(spark, SF001), rings, strategy="broadcast", known_windows=300,
                    known_edges=10).select("window_id", "id", "x", "y")
    assert rows(got) == rows(want)
    assert got.count() > 0


def test_json_stream_source(spark):
    d = tempfile.mkdtemp(prefix="quadrant-stream-json-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"id": 1, "x": -119.0, "y": 34.0}\n{"id": 2, "x": null, "y": 34.0}\n{"id": 3, "x": -118.0, "y": 33.0}\n')
    s = read_points_stream(spark, d, "id BIGINT, x DOUBLE, y DOUBLE", format="json")
    got = run_available(stream_range(s, -119.5, -118.5, 33.5, 34.5).select("id", "x", "y"), "json-test")
    assert rows(got) == [(1, -119.0, 34.0)]
