"""Many windows, queries and edges: no table goes to the driver on the word of its compressed size, no pair is made that can be counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from data_dirs import SF01
from quadrant.functions.generators import query_points, query_windows
from quadrant.operators import dominance, index
from quadrant.operators.dominance import AFTER, BEFORE, COLUMNS, POINT, dominated, earlier_below
from quadrant.operators.index import build_index, index_knn_batch, index_range_counts, index_range_join, knn_cells
from quadrant.operators.knn import knn_batch
from quadrant.operators.range import range_counts, range_join
from quadrant.operators.sizing import small_or_shuffled
from quadrant.operators.slabs import slab_pip_join
from quadrant.sources.derived import points_a, points_d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    return build_index(points_d(spark, SF01), partitions=4, pyramid_depth=7)


@pytest.mark.parametrize("crowd", [100_000, 20])
def test_cells_that_are_not_small_are_never_broadcast(spark, skewed, monkeypatch, crowd):
    """beyond the bound cells are shuffled, and pairs take their window along instead of looking it up."""
    w = query_windows(spark, 40, 5)
    monkeypatch.setattr(index, "small_or_shuffled", lambda df, *a: small_or_shuffled(df, 5))
    monkeypatch.setattr(index, "CROWD", crowd)
    got = index_range_join(spark, skewed, w).select("window_id", "id", "x", "y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_cell" in plan and "_w#" not in plan
    assert plan.count("BroadcastHashJoin") == (0 if crowd == 100_000 else 2)  # the list of crowded cells alone
    assert rows(got) == rows(range_join(points_d(spark, SF01), w).select("window_id", "id", "x", "y"))


def test_counts_by_corners(spark, skewed, monkeypatch):
    """where borders cross more cells than there are rows, no window meets a point; same counts on borders, ties and odd windows."""
    pts = points_d(spark, SF01)
    w = query_windows(spark, 300, 5)
    at = [(1000 + i, r.x, r.x + 0.3, r.y, r.y + 0.2) for i, r in enumerate(pts.limit(40).collect())]
    odd = [(7, -200.0, -190.0, 0.0, 1.0), (8, float("nan"), 1.0, 0.0, 1.0), (9, -119.0, -120.0, 34.0, 33.0), (10, None, None, 0.0, 1.0), (None, -121.0, -117.0, 32.0, 37.0)]
    w = w.unionByName(spark.createDataFrame(at + odd, "window_id long, mnx double, mxx double, mny double, mxy double"))
    want = rows(index_range_counts(spark, skewed, w))
    monkeypatch.setattr(index, "BORDER_CELLS", -1)
    monkeypatch.setattr(dominance, "STRIP_ROWS", 700)
    monkeypatch.setattr(index, "descend", None)
    assert rows(index_range_counts(spark, skewed, w)) == want
    assert rows(index_range_counts(spark, skewed, query_windows(spark, 9, 2))) == rows(range_counts(pts, query_windows(spark, 9, 2)))
    assert rows(index_range_counts(spark, skewed, w.limit(0))) == []


def test_counts_of_earlier_and_lower():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 64, 131):
        order, weight, place = rng.permutation(n), rng.integers(-3, 5, n), np.empty(n, int)
        place[order] = np.arange(n)
        assert earlier_below(order, weight).tolist() == [sum(weight[j] for j in range(i) if place[j] < place[i]) for i in range(n)]


@pytest.mark.parametrize("strip_rows", [1000, 40])
def test_dominated_equals_pairs(spark, strip_rows):
    """Ties in both orders, groups, weights, signs and one place far more frequent than a strip holds."""
    rng = random.Random(4)
    value = lambda: rng.choice([0.0, -0.0, 1.0, 1.0, 1.0, 2.5, float("inf"), rng.random()])
    held = [(None, 0, rng.choice([1, -1, 3]), rng.randrange(2), value(), POINT, value(), POINT) for _ in range(300)]
    asked = [(i // 2, rng.choice([1, -1]), 0, rng.randrange(2), value(), rng.choice([BEFORE, AFTER]), value(), rng.choice([BEFORE, AFTER])) for i in range(120)]
    schema = "_q long, _sign int, _n int, _g int, _u double, _u_at int, _v double, _v_at int"
    assert [c.split()[0] for c in schema.split(", ")] == COLUMNS
    got = dominated(spark.createDataFrame(held + asked, schema), strip_rows).groupBy("_q").agg(F.sum("_found")).collect()
    want = {}
    for q, sign, _, *a, v, v_at in asked:
        want[q] = want.get(q, 0) + sign * sum(n for _, _, n, *p, y, y_at in held if p < a and (y, y_at) < (v, v_at))
    assert dict(map(tuple, got)) == want


def test_tall_edges_meet_few_points(spark):
    """every edge of a jagged line spans a third of the height; a point is tested against the edges above and below it only."""
    n, m = 3000, 2000
    y = lambda i: i * 104729 % 1000033 / 1000033.0
    line = [(0, i / n, 1 + y(i), (i + 1) / n, 1 + y(i + 1)) for i in range(n)] + [(0, 1.0, 1 + y(n), 1.0, 0.0), (0, 1.0, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0, 1 + y(0))]
    other = [(1, *e) for e in ((0.2, 0.2, 0.4, 0.2), (0.4, 0.2, 0.4, 1.5), (0.4, 1.5, 0.2, 0.2))]
    edges = spark.createDataFrame(line + other, "window_id long, x1 double, y1 double, x2 double, y2 double")
    rng = random.Random(6)
    pts = [(i, rng.random(), 2 * rng.random()) for i in range(m)] + [(m, 0.5, 0.0), (m + 1, 1.0, 0.5), (m + 2, 0.3, 0.2)]
    out = slab_pip_join(spark.createDataFrame(pts, "id long, x double, y double"), edges, "covers").select("window_id", "id")
    got = rows(out)

    def crossed(x, y, w):
        hits = 0
        for k, x1, y1, x2, y2 in line + other:
            if k == w:
                c = (x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)
                if c == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
                hits += ((y1 > y) != (y2 > y)) and ((c > 0) == (y2 > y1))
        return hits % 2 == 1
    some = [p for p in pts if p[0] % 10 == 0 or p[0] >= m]
    names = {p[0] for p in some}
    assert [g for g in got if g[1] in names] == sorted(((w, i) for w in (0, 1) for i, a, b in some if crossed(a, b, w)), key=repr)
    plan, most, todo = out._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
    assert 0 < most < 10 * (n + m)


def test_cells_beyond_the_seeds_are_few(spark, monkeypatch):
    """cells that surely hold k points are met first; of the others, only those that the k-th of them leaves meet points."""
    pts = points_a(spark, SF01)
    idx = build_index(pts, partitions=4)
    q = query_points(spark, 500, 9).unionByName(spark.createDataFrame([(None, -119.0, 34.5), (3, -119.5, 35.0)], "q long, qx double, qy double"))
    met = []
    meet = index._meet
    monkeypatch.setattr(index, "_meet", lambda spark, idx, inner, cells: met.append(cells) or meet(spark, idx, inner, cells))
    got = rows(index_knn_batch(spark, idx, q, 3).select("q", "rank", "id", "x", "y", "d2"))
    assert got == rows(knn_batch(pts, q, 3, strategy="brute").select("q", "rank", "id", "x", "y", "d2"))
    seeds, rest = (df.count() for df in met)
    every = knn_cells(spark, idx, q, 3).count()
    assert 500 <= seeds and seeds + rest < 0.6 * every
