"""Points stored sorted by quad-tree leaf (L2/L3 persisted; J2, J6).

The reference partitions the point set by quad-tree cells once, then joins
windows partition by partition.  Here the partitioning is a table layout:
every point is tagged with its leaf and the table is range-partitioned and sorted by it.  A
join first finds the leaves each window's box meets, reads only row groups that hold them, and runs the
exact test on what it read.

The write range-partitions on (leaf, row number), so a leaf holding a third of all rows
is split evenly across tasks and files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.geometry import guarded_in_polygon, in_envelope
from quadrant.operators.quadtree import QuadTree, assign_leaves, pair_windows, quadtree
from quadrant.operators.sizing import MAX_BROADCAST_ROWS, maybe_broadcast, maybe_broadcast_polygons, shielded
from quadrant.session import materialize, scratch_path


#: Leaves that a join passes to the Parquet reader as a literal filter at most.
MAX_PUSHED_LEAVES = 1024


def leaf_id(depth: Column | str = "depth", prefix: Column | str = "prefix") -> Column:
    """One BIGINT per leaf: ``prefix * 32 + depth`` (depth < 32)."""
    d = F.col(depth) if isinstance(depth, str) else depth
    p = F.col(prefix) if isinstance(prefix, str) else prefix
    return p * 32 + d


@dataclass(frozen=True)
class LeafPartitioned:
    path: str
    qt: QuadTree

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def partition_by_leaves(pts: DataFrame, qt: QuadTree | None = None, path: str | None = None,
                        partitions: int | None = None) -> LeafPartitioned:
    """Write ``pts`` sorted by quad-tree leaf (column ``_leaf``); return the handle.

    Several leaves share a file, so the number of files follows ``partitions``, not the
    leaves; row-group statistics of ``_leaf`` let a join skip what it does not need.
    ``qt`` defaults to a materialised tree with ``target_leaves=1024``.
    """
    spark = pts.sparkSession
    if "_leaf" in pts.columns:
        raise ValueError("rename the column _leaf: the layout has a column of that name")
    qt = qt or quadtree(pts)
    if qt.n_leaves is None:
        raise ValueError("the quad-tree must be materialised (quadtree(..., materialize=True))")
    path = path or scratch_path(spark, "leaf-partitioned")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner, back = shielded(pts, [])
    tagged = (assign_leaves(inner, qt).select(leaf_id().alias("_leaf"), *back)
              .withColumn("_tie", F.monotonically_increasing_id()))
    (tagged.repartitionByRange(n, "_leaf", "_tie").sortWithinPartitions("_leaf", "_tie").drop("_tie")
     .write.mode("errorifexists").parquet(path))
    return LeafPartitioned(path, qt)


def _touched(lp: LeafPartitioned, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The window columns with ``_leaf`` for every leaf a window's box may meet, written once, and the points to read.

    Up to ``MAX_PUSHED_LEAVES`` touched leaves become a literal filter that reaches the
    Parquet reader; with more, the join on the leaf key alone decides.
    """
    table = materialize(pair_windows(windows, lp.qt).withColumn("_leaf", leaf_id()).drop("depth", "prefix"), "leaf-pairs")
    ids = [r[0] for r in table.select("_leaf").distinct().limit(MAX_PUSHED_LEAVES + 1).collect()]
    pts = lp.points(windows.sparkSession)
    return table, pts.where(F.col("_leaf").isin(ids)) if len(ids) <= MAX_PUSHED_LEAVES else pts


def leaf_pip_join(spark: SparkSession, lp: LeafPartitioned, windows: DataFrame,
                  predicate: str = "intersects", known_windows: int | None = None,
                  known_edges: int | None = None,
                  max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Polygon windows joined with leaf-sorted points.

    The (window, leaf) pairs carry the polygon and are broadcast when the
    size check passes; otherwise they meet the points in a shuffle join on
    the leaf key, which Spark splits where a leaf is crowded.
    """
    # Written once: the pairing looks at the windows twice, and they are often a kNN result.
    geo = materialize(windows.select(F.col("window_id").alias("_w_window_id"), "edges", "mnx", "mxx", "mny", "mxy"), "leaf-windows")
    pairs, pts = _touched(lp, geo)
    pairs, _ = maybe_broadcast_polygons(pairs, max_broadcast_rows)
    inner, back = shielded(pts, ["window_id"])
    return _meet(inner, pairs, pts, back, guarded_in_polygon("edges", "x", "y", "mnx", "mxx", "mny", "mxy", predicate))


def leaf_range_join(spark: SparkSession, lp: LeafPartitioned, windows: DataFrame,
                    max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Q3 over leaf-sorted points: ``(window_id, ...point columns)`` pairs."""
    w = windows.select(F.col("window_id").alias("_w_window_id"), F.least("mnx", "mxx").alias("mnx"), F.greatest("mnx", "mxx").alias("mxx"),
                       F.least("mny", "mxy").alias("mny"), F.greatest("mny", "mxy").alias("mxy"))
    pairs, pts = _touched(lp, w)
    pairs, _ = maybe_broadcast(pairs, max_broadcast_rows)
    inner, back = shielded(pts, ["window_id"])
    return _meet(inner, pairs, pts, back, in_envelope("x", "y", "mnx", "mxx", "mny", "mxy"))


def _meet(inner: DataFrame, pairs: DataFrame, pts: DataFrame, back: list, hit: Column) -> DataFrame:
    leaf = inner.columns[pts.columns.index("_leaf")]
    met = inner.join(pairs, inner[leaf] == pairs["_leaf"]).where(hit)
    return met.select(F.col("_w_window_id").alias("window_id"), *(b for b, c in zip(back, pts.columns) if c != "_leaf"))


__all__ = ["LeafPartitioned", "partition_by_leaves", "leaf_pip_join", "leaf_range_join", "leaf_id"]
