"""Randomised checks against independent pure-Python definitions (small fixtures)."""

import random


from quadrant.functions.geometry import in_polygon
from quadrant.operators.knn import knn_batch
from quadrant.operators.ring import polygon_from_vertices


def _py_inside(poly, x, y):
    """Ray casting with division; ``None`` on the boundary (where parity is arbitrary)."""
    n = len(poly)
    inside = False
    for i in range(n):
        (x1, y1), (x2, y2) = poly[i], poly[(i + 1) % n]
        cross = (x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return None
        if (y1 > y) != (y2 > y):
            if x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


def test_random_polygons_match_ray_casting(spark):
    rnd = random.Random(7)
    verts, pts = [], []
    polys = {}
    for w in range(150):
        poly = [(float(rnd.randint(0, 6)), float(rnd.randint(0, 6))) for _ in range(rnd.randint(3, 8))]
        polys[w] = poly
        verts += [(w, i + 1, x, y) for i, (x, y) in enumerate(poly)]
    for i in range(40):
        pts.append((i, rnd.randint(-1, 7) / (2 if i % 3 else 1), rnd.randint(-1, 7) / (2 if i % 2 else 1)))
    windows = polygon_from_vertices(spark.createDataFrame(verts, "window_id BIGINT, seq INT, x DOUBLE, y DOUBLE"))
    p = spark.createDataFrame(pts, "id BIGINT, x DOUBLE, y DOUBLE")
    got = (p.crossJoin(windows).select(
        "id", "window_id", in_polygon("edges", "x", "y", "intersects").alias("closed"),
        in_polygon("edges", "x", "y", "interior").alias("interior")).collect())
    assert len(got) == len(pts) * len(polys)
    by_id = {i: (x, y) for i, x, y in pts}
    for r in got:
        x, y = by_id[r.id]
        want = _py_inside(polys[r.window_id], x, y)
        if want is None:       # on the boundary
            assert r.closed and not r.interior, (r, polys[r.window_id], x, y)
        else:
            assert r.closed == want and r.interior == want, (r, polys[r.window_id], x, y)


def test_random_knn_matches_sorted_python(spark):
    rnd = random.Random(3)
    pts = [(i, float(rnd.randint(0, 20)), float(rnd.randint(0, 20))) for i in range(400)]  # many ties
    qs = [(q, rnd.uniform(-2, 22), rnd.uniform(-2, 22)) for q in range(6)]
    df = spark.createDataFrame(pts, "id BIGINT, x DOUBLE, y DOUBLE")
    qdf = spark.createDataFrame(qs, "q BIGINT, qx DOUBLE, qy DOUBLE")
    for strategy in ("brute", "cells"):
        got = knn_batch(df, qdf, 25, strategy=strategy, cell=2.0, known_queries=6).orderBy("q", "rank").collect()
        for q, qx, qy in qs:
            want = sorted(pts, key=lambda p: ((p[1] - qx) * (p[1] - qx) + (p[2] - qy) * (p[2] - qy), p[0]))[:25]
            mine = [r for r in got if r.q == q]
            assert [r.id for r in mine] == [p[0] for p in want], (strategy, q)
            assert [r.rank for r in mine] == list(range(1, 26))
