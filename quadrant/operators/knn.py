"""k-nearest-neighbour queries (Q4-Q7).

Output rows: ``(q, rank, id, x, y, d2, ...carried)``, nearest first, ties at
equal distance broken by ``id``.  ``k > n`` returns all n points.

Strategies, all returning the same rows:

* ``sort`` (single query): ``orderBy(d2, id).limit(k)`` -> TakeOrderedAndProject,
  a per-partition top-k followed by one merge of k rows per partition.
* ``brute`` (batch): queries broadcast against every point.  A first pass counts the points of
  each query by steps of distance; only points up to the step that holds the k-th are ranked, with
  ``row_number() <= k`` per query -> partial WindowGroupLimit in every task.  So a task sorts
  about k rows per query, not its points x queries.
* ``cells`` (single or batch): the exact two-phase search.  Phase 1 counts
  points per occupied grid cell and, per query, finds the smallest ring of
  cells holding k points; phase 2 ranks only the points in the cells that can
  still hold a nearer point.  The phase-1 result is small (cells, not points)
  and is written to the shared checkpoint folder, which both cuts lineage and
  sizes the phase-2 join.  ``cell="auto"`` sizes the grid from the data (one
  aggregate: extent and count) so that a cell holds about k/4 points on
  average at any scale.  Points are read three times in all (statistics, cell
  counts, candidates), twice with a given cell size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.functions.geometry import dist2
from quadrant.functions.generators import point_literal
from quadrant.operators.sizing import MAX_BROADCAST_ROWS, MAX_LOOP_ROWS, maybe_broadcast, shielded
from quadrant.session import materialize

DEFAULT_CELL = "auto"
# At most this many cells over the extent in phase 1, however many points there are.
MAX_GRID_CELLS = 1_000_000


def cell_size(pts: DataFrame, k: int, max_cells: int = MAX_GRID_CELLS) -> DataFrame:
    """One row ``(cell)``: the side for which an average cell holds about k/4
    points, but never more than ``max_cells`` cells over the extent: the longer axis
    has at most sqrt(max_cells) of them, however thin the extent (one aggregate,
    evaluated inside the job that uses it)."""
    w = F.max("x") - F.min("x")
    h = F.max("y") - F.min("y")
    long = F.greatest(w, h)
    area = F.when((w > 0) & (h > 0), w * h).otherwise(long * long)
    n = F.count(F.lit(1))
    side = F.greatest(F.sqrt(area * F.lit(float(max(k, 4))) / (F.lit(4.0) * n)),
                      long / F.lit(math.sqrt(float(max_cells))))
    return pts.agg(F.when((n > 0) & (long > 0), side).otherwise(F.lit(1.0)).alias("cell"))


# Largest k for which one query uses TakeOrderedAndProject: its final task
# merges k rows from every scan task, fine for small k only.
SORT_MAX_K = 100

# First-level fan-in of the two-level top-k: scan tasks are grouped into this
# many buckets, each keeping k rows per query, before the per-query merge.
TOPK_BUCKETS = 1024
# Steps of squared distance per doubling, by which the points of a query are counted before they are ranked.
DISTANCE_STEPS = 8
# Tasks over which the points of one cell are dealt when the candidates are not broadcast.
SALTS = 8


def _ranked(df: DataFrame, k: int) -> DataFrame:
    """``rank`` = position by ``(d2, id)`` within each query, keeping ``rank <= k``.

    Two levels, so no task ever merges k rows from every scan task: first per
    (query, bucket of scan tasks), then per query.  With P scan tasks the
    groups hold at most k * P / TOPK_BUCKETS and k * TOPK_BUCKETS rows.  Up to
    Spark's ``windowGroupLimitThreshold`` (1000) each level also keeps k rows per group inside
    every task before its shuffle; the session's own setting is left as it is.
    """
    bucket = Window.partitionBy("q", "_bucket").orderBy("d2", "id")
    first = (df.withColumn("_bucket", F.spark_partition_id() % TOPK_BUCKETS)
             .withColumn("_r", F.row_number().over(bucket)).where(F.col("_r") <= k)
             .drop("_r", "_bucket"))
    w = Window.partitionBy("q").orderBy("d2", "id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearby(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (q, d2, ...) without those that surely have k nearer ones of their query.

    Ranking sorts what a task holds, which would spill for all points of a large table.  Counts per
    query and step of distance need no sort; equal distances share a step, so ties at the k-th stay.
    """
    # NULL and 0 come first, as they do in the ranking, and NaN last.
    step = F.coalesce(F.rint(F.log2("d2") * DISTANCE_STEPS), F.lit(-math.inf))
    counts = pairs.groupBy("q", step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    held = counts.withColumn("_held", F.sum("_n").over(Window.partitionBy("q").orderBy("_step")))
    # One step more, against a logarithm that another machine rounds differently; with fewer than k points all stay.
    bound = held.where(F.col("_held") >= k).groupBy(F.col("q").alias("_of")).agg((F.min("_step") + 1).alias("_bound"))
    met = pairs.join(F.broadcast(bound), F.col("q").eqNullSafe(F.col("_of")), "left")  # at most a row per query
    return met.where(step <= F.coalesce("_bound", F.lit(math.nan))).drop("_of", "_bound")


def _out(df: DataFrame, back: list, with_q: bool = True) -> DataFrame:
    lead = ["q"] if with_q else []
    return df.select(*lead, "rank", "id", "x", "y", "d2", *back)


def _shield(pts: DataFrame, with_q: bool = True) -> tuple[DataFrame, list]:
    inner, back = shielded(pts, ["rank", "d2", *["q"] * with_q])
    return inner, [b for b, c in zip(back, pts.columns) if c not in ("id", "x", "y")]


def knn(pts: DataFrame, qx: float, qy: float, k: int, strategy: str = "auto",
        cell: float | str = DEFAULT_CELL) -> DataFrame:
    """Q4/Q5/Q6: the k nearest points to one query point ``(qx, qy)``.

    ``rank, id, x, y, d2, ...``; strategies as in ``knn_batch`` (``auto``: the
    heap top-k for k <= SORT_MAX_K, else the two-level top-k).
    """
    inner, back = _shield(pts, with_q=False)
    if k <= 0:
        return _out(inner.withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(0)).limit(0), back, False)
    if strategy not in ("auto", "sort", "brute", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    near = inner.withColumn("d2", dist2("x", "y", float(qx), float(qy)))  # the query point is a pair of literals: no join at all
    if strategy == "sort" or (strategy == "auto" and k <= SORT_MAX_K):
        top = near.orderBy("d2", "id").limit(k)
        return _out(top.withColumn("rank", F.row_number().over(Window.orderBy("d2", "id"))), back, False)
    if strategy != "cells":
        return _out(_ranked(_nearby(near.withColumn("q", F.lit(0)), k), k), back, False)
    queries = point_literal(pts.sparkSession, qx, qy)
    return _out(knn_batch(inner, queries, k, strategy=strategy, cell=cell), back, False)


def knn_batch(pts: DataFrame, queries: DataFrame, k: int, strategy: str = "auto",
              cell: float | str = DEFAULT_CELL, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
              known_queries: int | None = None) -> DataFrame:
    """Q7: the k nearest points of every query point in ``queries (q, qx, qy)``.

    ``q`` must be unique.  The query table is broadcast only when it passes
    the size check.  ``auto`` reads the points twice, to count them by distance and
    to rank those near enough (``brute``), for up to
    ``MAX_LOOP_ROWS`` queries (it computes points x queries distances), and
    takes ``cells`` beyond that.  ``cells`` costs three scans
    but ships almost nothing, and takes query tables of any size.  ``known_queries`` is the caller's word on
    the number of queries and not relied on; ``sort`` is for literal points (``knn``) and works as ``brute`` here.
    """
    if strategy not in ("auto", "sort", "brute", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    inner, back = _shield(pts)
    queries = queries.select("q", "qx", "qy")
    if k <= 0:
        return _out(inner.crossJoin(queries).withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(0)).limit(0), back)
    if strategy != "cells":
        q, small = maybe_broadcast(queries, MAX_LOOP_ROWS if strategy == "auto" else max_broadcast_rows)
        if small:
            pairs = inner.crossJoin(q).withColumn("d2", dist2("x", "y", F.col("qx"), F.col("qy")))
            return _out(_ranked(_nearby(pairs, k), k), back)
    queries = materialize(queries, "knn-queries")
    if cell == "auto":
        cell = cell_size(pts, k).first()["cell"]
    cand = materialize(candidate_cells(pts, queries, k, float(cell)), "knn-cells")
    c = F.lit(float(cell))
    cand, small = maybe_broadcast(cand, max_broadcast_rows)
    cells = (inner.withColumn("_cx", F.floor(F.col("x") / c))
                  .withColumn("_cy", F.floor(F.col("y") / c)))
    keys = ["_cx", "_cy"]
    if not small:
        # A crowded cell meets its queries in SALTS tasks: points are dealt, candidates repeated.
        cells = cells.withColumn("_salt", F.pmod(F.xxhash64("id", "x", "y"), F.lit(SALTS)))
        cand = cand.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        keys.append("_salt")
    pairs = (cells.join(cand, keys)
             .withColumn("d2", dist2("x", "y", F.col("qx"), F.col("qy"))))
    return _out(_ranked(pairs, k), back)


def candidate_cells(pts: DataFrame, queries: DataFrame, k: int, cell: float) -> DataFrame:
    """Phase 1 of the exact cell kNN: ``(q, qx, qy, _cx, _cy)`` cells to search.

    Counts per cell are summed over ever coarser grids (sides cell, 2 cell, 4 cell, ...), and a query
    looks at the block of 3 x 3 cells around its own in each: equi-joins on cell keys.
    In the finest grid whose block holds >= k points, all of them are within the distance to the
    block's farthest corner, so only cells of that grid that reach into this distance can
    hold a neighbour: at most six cells away.  With fewer than k points in all, a query takes every cell.
    """
    c = F.lit(float(cell))
    occupied = materialize(
        pts.select(F.floor(F.col("x") / c).alias("cx"), F.floor(F.col("y") / c).alias("cy"))
        .groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")), "knn-occupied")
    box = occupied.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if box[0] is None:
        return queries.select("q", "qx", "qy", F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy")).limit(0)
    # Up to the grid in which the block around any query holds all points.
    ends = queries.agg(*(f(F.floor(F.col(v) / c)) for v in ("qx", "qy") for f in (F.min, F.max))).first()
    reach = [max(box[i + 1], ends[i + 1]) - min(box[i], ends[i]) for i in (0, 2) if ends[i] is not None]
    levels = max(reach, default=1).bit_length() + 1
    shift = lambda v, s: F.call_function("shiftright", F.col(v), s)
    grids = occupied.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    grids = materialize(grids.groupBy("level", shift("cx", F.col("level")).alias("gx"), shift("cy", F.col("level")).alias("gy")).agg(F.sum("n").alias("n")), "knn-grids")
    at = queries.select("q", "qx", "qy", F.floor(F.col("qx") / c).alias("qcx"), F.floor(F.col("qy") / c).alias("qcy"))
    near = at.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    off = F.array(*(F.lit(i).cast("bigint") for i in (-1, 0, 1)))
    block = near.withColumn("_o", F.explode(off)).withColumn("gx", shift("qcx", F.col("level")) + F.col("_o"))
    block = block.withColumn("_o", F.explode(off)).withColumn("gy", shift("qcy", F.col("level")) + F.col("_o")).select("q", "level", "gx", "gy")
    counts = block.join(grids, ["level", "gx", "gy"]).groupBy("q", "level").agg(F.sum("n").alias("n"))
    best = counts.where(F.col("n") >= k).groupBy("q").agg(F.min("level").alias("level"))
    side = F.pow(F.lit(2.0), F.col("level")) * c
    told = at.join(best, "q", "left").withColumn("_side", side)
    # The farthest corner of the block is at most 2 sides away on each axis, widened against rounding.
    told = told.withColumn("_reach", F.lit(2.0 * math.sqrt(2.0) * (1 + 1e-9)) * F.col("_side"))
    found = told.where(F.col("level").isNotNull())
    bounds = {"_x0": ("qx", -1), "_x1": ("qx", 1), "_y0": ("qy", -1), "_y1": ("qy", 1)}
    for name, (v, sign) in bounds.items():
        found = found.withColumn(name, F.floor((F.col(v) + sign * F.col("_reach")) / F.col("_side")) + sign)
    found = found.withColumn("gx", F.explode(F.sequence("_x0", "_x1"))).withColumn("gy", F.explode(F.sequence("_y0", "_y1")))
    own = occupied.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("gx", shift("cx", F.col("level"))).withColumn("gy", shift("cy", F.col("level")))
    few = found.select("q", "qx", "qy", "level", "gx", "gy").join(own.select("level", "gx", "gy", "cx", "cy"), ["level", "gx", "gy"])
    # No block holds k points: there are fewer than k in all, and a query's answer is all of them.
    far = told.where(F.col("level").isNull()).select("q", "qx", "qy", F.lit(1).alias("_all"))
    rest = far.join(occupied.withColumn("_all", F.lit(1)), "_all")
    return few.select("q", "qx", "qy", F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).unionByName(
        rest.select("q", "qx", "qy", F.col("cx").alias("_cx"), F.col("cy").alias("_cy")))


__all__ = ["SORT_MAX_K", "TOPK_BUCKETS", "knn", "knn_batch", "candidate_cells", "cell_size", "DEFAULT_CELL"]
