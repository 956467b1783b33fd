"""Points in rings of very many edges (P2, P3): edges as rows, met by slabs of x.

A polygon's edges stay a table (``window_id, x1, y1, x2, y2``); no row ever holds a ring.  A ray from a point towards +x crosses
two kinds of edges.  Those that lie wholly right of the point and straddle its y need no test: with lower ends counted up and upper ends
counted down they are points above and below it, counted for all points at once (``dominance.py``).  So tall edges, which every ray
may cross, are never paired with points.  Edges whose x range may hold the point are tested one by one: each window's width is halved level by
level into slabs, an edge is filed at the level whose slabs are about its own width, so it lies in two of them at most, and a
point of the window's box meets, by an equi-join, the edges of its one slab a level, for the levels that have edges.  Candidates
are told apart by a stored row number, as ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.functions.geometry import _edge_hit, _edge_touch
from quadrant.operators.dominance import AFTER, BEFORE, POINT, dominated
from quadrant.operators.range import range_join
from quadrant.operators.sizing import maybe_broadcast, shielded, small_or_shuffled
from quadrant.session import materialize

#: Slab levels of a window: widths from the whole window to 2^-26 of it.
LEVELS = 26
#: Tasks over which the candidates of one slab are dealt where the edges are not broadcast, at levels of few and wide slabs.
SALTS, WIDE = 16, 8


def _slab(x: str, level: Column) -> Column:
    """The slab of ``x`` at ``level``; outside the window's width the first or last one."""
    share = F.coalesce((F.col(x) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0))
    side = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.floor(share * side), F.lit(0).cast("bigint")), side.cast("bigint") - 1)


def _clean() -> Column:
    """Whether an edge has all its coordinates; others are tested against every candidate of their window."""
    clean = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        clean = clean & F.col(c).isNotNull() & ~F.isnan(c)
    return clean


def slab_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: windows ``(_w, window_id, box)``, and edges by ``(_w, _level, _slab)``."""
    boxes = edges.groupBy("window_id").agg(
        F.min(F.least("x1", "x2")).alias("mnx"), F.max(F.greatest("x1", "x2")).alias("mxx"),
        F.min(F.least("y1", "y2")).alias("mny"), F.max(F.greatest("y1", "y2")).alias("mxy"))
    boxes = materialize(boxes.withColumn("_w", F.monotonically_increasing_id()), "slab-windows")
    small, _ = maybe_broadcast(boxes.select("_w", F.col("window_id").alias("_id"), F.col("mnx").alias("_low"), F.col("mxx").alias("_high")))
    e = edges.join(small, F.col("window_id").eqNullSafe(F.col("_id"))).drop("_id", "window_id")
    e = e.withColumns({"_left": F.least("x1", "x2"), "_right": F.greatest("x1", "x2"), "_clean": _clean()})
    width = (F.col("_right") - F.col("_left")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    # A slab at this level is at least as wide as the edge.
    level = F.when(width > 0, F.least(F.lit(LEVELS), F.floor(-F.log2(width)))).otherwise(F.lit(LEVELS))
    level = F.when(F.col("_clean"), F.greatest(F.lit(0), F.coalesce(level, F.lit(LEVELS)))).otherwise(F.lit(0))
    e = e.withColumn("_level", level.cast("int"))
    e = e.withColumn("_slab", F.explode(F.sequence(_slab("_left", F.col("_level")), _slab("_right", F.col("_level")))))
    # The first of an edge's rows is the one that counts it.
    e = e.withColumn("_first", F.col("_slab") == _slab("_left", F.col("_level")))
    return boxes, materialize(e.select("_w", "_level", "_slab", "_first", "_clean", "x1", "y1", "x2", "y2"), "slab-edges")


def _crossed_right(keyed: DataFrame, filed: DataFrame, several: bool) -> DataFrame:
    """``(_row, _hits)``: for candidates, the edges that lie wholly right of them and straddle their y; a row's numbers add up."""
    edges = filed.where(F.col("_first") & F.col("_clean") & (F.col("y1") != F.col("y2")))
    end = lambda n, y: F.struct(F.lit(n).alias("_n"), y.alias("_v"))
    ends = edges.select(F.lit(None).cast("long").alias("_q"), F.lit(0).alias("_sign"), F.col("_w").alias("_g"), (-F.least("x1", "x2")).alias("_u"), F.lit(POINT).alias("_u_at"),
                        F.lit(POINT).alias("_v_at"), F.explode(F.array(end(1, F.least("y1", "y2")), end(-1, F.greatest("y1", "y2")))).alias("e"))
    start = lambda sign, u: F.struct(F.lit(sign).alias("_sign"), u.alias("_u"))
    starts = [start(1, -F.col("x"))] + [start(-1, F.lit(float("-inf")))] * several  # takes away the edges of other windows
    asked = keyed.select(F.col("_row").alias("_q"), F.col("_w").alias("_g"), F.lit(BEFORE).alias("_u_at"), F.col("y").alias("_v"), F.lit(AFTER).alias("_v_at"),
                         F.lit(0).alias("_n"), F.explode(F.array(*starts)).alias("s")).select("*", "s.*").drop("s")
    return dominated(ends.select("*", "e.*").drop("e").unionByName(asked)).select(F.col("_q").alias("_row"), F.col("_found").alias("_hits"))


def _met(keyed: DataFrame, filed: DataFrame, levels: list[int]) -> DataFrame:
    """``(_row, _hits, _on)``: candidates and the edges of their slabs at ``levels``, tested one by one."""
    keyed = keyed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_slab", _slab("x", F.col("_level"))).drop("_low", "_high")
    filed, small = small_or_shuffled(filed.where(F.col("_level").isin(levels)).drop("_first"))
    on = ["_w", "_level", "_slab"]
    if not small and max(levels) < WIDE:
        keyed = keyed.withColumn("_salt", F.pmod("_row", F.lit(SALTS)))
        filed = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).hint("merge")
        on.append("_salt")
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    x, y = F.col("x"), F.col("y")
    hit = _edge_hit(edge, x, y) & ((F.least("x1", "x2") <= x) | ~F.col("_clean"))
    return keyed.join(filed, on).select("_row", F.when(hit, 1).otherwise(0).cast("long").alias("_hits"), _edge_touch(edge, x, y).alias("_on"))


def slab_pip_join(pts: DataFrame, edges: DataFrame, predicate: str = "intersects") -> DataFrame:
    """``(window_id, ...point columns)``: points in the even-odd polygons whose directed edges are rows of ``edges``.

    ``intersects`` and ``covers`` hold the boundary, ``interior`` does not.  Rings of a NULL window_id are one window.
    """
    if predicate not in ("intersects", "covers", "interior"):
        raise ValueError(f"unknown predicate {predicate!r}")
    boxes, filed = slab_edges(edges)
    inner, back = shielded(pts, ["window_id"])
    windows = boxes.withColumnRenamed("window_id", "_id").withColumnRenamed("_w", "window_id")
    cand = range_join(inner, windows.select("window_id", "mnx", "mxx", "mny", "mxy"))
    cand = materialize(cand.withColumnRenamed("window_id", "_w").withColumn("_row", F.monotonically_increasing_id()), "slab-candidates")
    named, _ = maybe_broadcast(boxes.select("_w", F.col("window_id").alias("_id"), F.col("mnx").alias("_low"), F.col("mxx").alias("_high")))
    keyed = cand.select("_w", "_row", "x", "y").join(named.drop("_id"), "_w")
    found = _crossed_right(keyed, filed, several=boxes.count() > 1).withColumn("_on", F.lit(False))
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())  # at most LEVELS + 1
    for some in ([i for i in levels if i < WIDE], [i for i in levels if i >= WIDE]):
        if some:
            found = found.unionByName(_met(keyed, filed, some))
    met = found.groupBy("_row").agg(F.sum("_hits").alias("_hits"), F.max("_on").alias("_on"))
    odd = F.col("_hits") % 2 == 1
    inside = odd & ~F.col("_on") if predicate == "interior" else odd | F.col("_on")
    return cand.join(met.where(inside).select("_row"), "_row").join(named.select("_w", "_id"), "_w").select(F.col("_id").alias("window_id"), *back)


__all__ = ["slab_edges", "slab_pip_join", "LEVELS"]
