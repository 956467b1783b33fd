"""Point-in-polygon and envelope predicates on hand shapes with known answers."""

import pytest

from quadrant.functions.geometry import in_envelope, in_polygon
from quadrant.operators.ring import polygon_from_vertices

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
BOWTIE = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]

# point -> (square in, square on, bow-tie in, bow-tie on); "in" only matters off the boundary.
CASES = {
    (1.0, 1.0): (True, False, True, True),
    (1.0, 0.5): (True, False, False, False),
    (0.5, 1.0): (True, False, True, False),
    (1.5, 1.0): (True, False, True, False),
    (0.0, 0.0): (False, True, True, True),
    (0.0, 1.0): (False, True, False, True),
    (2.0, 1.0): (False, True, True, True),
    (1.0, 2.0): (False, True, False, False),
    (3.0, 1.0): (False, False, False, False),
}


def _poly(spark, verts, wid=0):
    rows = [(wid, i + 1, x, y) for i, (x, y) in enumerate(verts)]
    v = spark.createDataFrame(rows, "window_id BIGINT, seq INT, x DOUBLE, y DOUBLE")
    return polygon_from_vertices(v)


def _eval(spark, verts, predicate):
    poly = _poly(spark, verts)
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(CASES)], "id BIGINT, x DOUBLE, y DOUBLE")
    got = (pts.crossJoin(poly).select("id", in_polygon("edges", "x", "y", predicate).alias("hit"))
           .collect())
    keys = list(CASES)
    return {keys[r.id]: r.hit for r in got}


@pytest.mark.parametrize("shape,offset", [(SQUARE, 0), (BOWTIE, 2)])
def test_closed_and_interior(spark, shape, offset):
    closed = _eval(spark, shape, "intersects")
    covers = _eval(spark, shape, "covers")
    interior = _eval(spark, shape, "interior")
    for p, flags in CASES.items():
        inside, on = flags[offset], flags[offset + 1]
        assert closed[p] == (inside or on), p
        assert covers[p] == closed[p], p
        assert interior[p] == (inside and not on), p


def test_ring_closes_back_to_first_vertex(spark):
    poly = _poly(spark, SQUARE).collect()[0]
    edges = [(e.x1, e.y1, e.x2, e.y2) for e in poly.edges]
    assert edges[-1] == (0.0, 2.0, 0.0, 0.0)
    assert (poly.mnx, poly.mxx, poly.mny, poly.mxy) == (0.0, 2.0, 0.0, 2.0)
    assert poly.n_vertices == 4


def test_fewer_than_three_vertices_yield_no_window(spark):
    assert _poly(spark, [(0.0, 0.0), (1.0, 1.0)]).count() == 0


def test_envelope_is_closed(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0000001, 0.5)], "x DOUBLE, y DOUBLE")
    got = df.where(in_envelope("x", "y", 0.0, 1.0, 0.0, 1.0)).count()
    assert got == 2


def test_degenerate_edges_do_not_divide(spark):
    # A ring with a repeated vertex (zero-length edge) and a horizontal edge.
    verts = [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]
    poly = _poly(spark, verts)
    pts = spark.createDataFrame([(1.0, 0.0), (1.5, 0.5), (0.5, 1.5)], "x DOUBLE, y DOUBLE")
    got = sorted(r.h for r in pts.crossJoin(poly).select(
        in_polygon("edges", "x", "y").alias("h")).collect())
    assert got == [False, True, True]
