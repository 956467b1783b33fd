"""Points and windows stored in the same buckets, joined without an exchange.

The reference partitions points and windows by the cells of one quad-tree and joins them partition by partition.  Here
both are bucketed tables on the same key, so Spark plans the join with no shuffle above either scan, as often as
the tables are joined.  The key is a quad-tree leaf and a part of it: a leaf that holds more than a bucket's share of the
points is dealt over parts, and a window meets all parts of its leaves, so no bucket grows with a crowded place.

Windows that are not stored may be joined too; then only they are shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.geometry import guarded_in_polygon, in_envelope
from quadrant.operators.partitioned import leaf_id
from quadrant.operators.quadtree import QuadTree, assign_leaves, pair_windows, quadtree
from quadrant.operators.sizing import shielded
from quadrant.session import materialize, scratch_path

KEY = ["_leaf", "_part"]


@dataclass(frozen=True)
class LeafBuckets:
    """``table`` holds the points with their key, ``parts`` (a written table) the leaves dealt over more than one part."""

    table: str
    path: str
    parts: str
    buckets: int
    qt: QuadTree

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def drop(self, spark: SparkSession) -> None:
        """Forget the table; its files stay in the shared folder."""
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _write(df: DataFrame, name: str, buckets: int) -> tuple[str, str]:
    """A bucketed table on ``KEY``: one sorted file a bucket, as rows come dealt by the buckets' own hash."""
    table, path = f"{name}_{uuid.uuid4().hex}", scratch_path(df.sparkSession, name)
    (df.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(table))
    return table, path


def copartition(pts: DataFrame, qt: QuadTree | None = None, buckets: int | None = None) -> LeafBuckets:
    """Store ``pts`` by leaf and part in ``buckets`` buckets (default: the session's shuffle partitions; more at scale).

    With fewer buckets than ``spark.sql.shuffle.partitions`` Spark may shuffle both sides of a later join for more parallelism.
    """
    spark = pts.sparkSession
    if clash := [c for c in KEY if c in pts.columns]:
        raise ValueError(f"rename the columns {clash}: the table has columns of that name")
    qt = qt or quadtree(pts)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner, back = shielded(pts, [])
    tagged = assign_leaves(inner, qt).select(leaf_id().alias("_leaf"), *back)
    sizes = materialize(tagged.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // buckets))
    path = scratch_path(spark, "leaf-parts")
    sizes.where(F.col("n") > share).select("_leaf", F.ceil(F.col("n") / share).cast("int").alias("_parts")).write.parquet(path)
    # Fewer than ``buckets`` leaves can hold more than a bucket's share.
    crowded = F.broadcast(spark.read.parquet(path))
    dealt = (tagged.withColumn("_row", F.monotonically_increasing_id()).join(crowded, "_leaf", "left")
             .withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_row", "_parts")).cast("int")).drop("_row", "_parts"))
    table, where = _write(dealt, "leaf_buckets", buckets)
    return LeafBuckets(table, where, path, buckets, qt)


def window_pairs(spark: SparkSession, lb: LeafBuckets, windows: DataFrame) -> DataFrame:
    """Windows (mnx, mxx, mny, mxy and other columns) once per leaf and part that they may meet."""
    named = windows.withColumnRenamed("window_id", "_w_window_id")
    pairs = pair_windows(named, lb.qt).withColumn("_leaf", leaf_id()).drop("depth", "prefix")
    crowded = F.broadcast(spark.read.parquet(lb.parts))
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    return pairs.join(crowded, "_leaf", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")


def store_windows(spark: SparkSession, lb: LeafBuckets, windows: DataFrame) -> str:
    """Store the windows in the buckets of the points, for several joins; returns the table's name.

    Polygons keep ``edges``; write the windows first (``materialize``) if they are dear to compute.
    """
    table, _ = _write(window_pairs(spark, lb, windows), "window_buckets", lb.buckets)
    return table


def _join(spark: SparkSession, lb: LeafBuckets, windows: DataFrame | str, hit: Column) -> DataFrame:
    pairs = spark.table(windows) if isinstance(windows, str) else window_pairs(spark, lb, materialize(windows, "join-windows"))
    pts = lb.points(spark)
    inner, back = shielded(pts.select(*KEY, *(c for c in pts.columns if c not in KEY)), ["window_id"])
    inner = inner.withColumnsRenamed({inner.columns[i]: k for i, k in enumerate(KEY)})
    names = [c for c in pts.columns if c not in KEY]
    back = [b for b, c in zip(back[len(KEY):], names)]
    # Both sides keep the key's partitioning: a sort-merge join with no exchange above the points.
    return inner.hint("merge").join(pairs, KEY).where(hit).select(F.col("_w_window_id").alias("window_id"), *back)


def copartitioned_pip_join(spark: SparkSession, lb: LeafBuckets, windows: DataFrame | str, predicate: str = "intersects") -> DataFrame:
    """Polygons (a DataFrame, or the name that :func:`store_windows` gave) joined with bucketed points."""
    if not isinstance(windows, str):
        windows = windows.select("window_id", "edges", "mnx", "mxx", "mny", "mxy")
    return _join(spark, lb, windows, guarded_in_polygon("edges", "x", "y", "mnx", "mxx", "mny", "mxy", predicate))


def copartitioned_range_join(spark: SparkSession, lb: LeafBuckets, windows: DataFrame | str) -> DataFrame:
    """Q3: rectangles joined with bucketed points."""
    if not isinstance(windows, str):
        windows = windows.select("window_id", F.least("mnx", "mxx").alias("mnx"), F.greatest("mnx", "mxx").alias("mxx"),
                                 F.least("mny", "mxy").alias("mny"), F.greatest("mny", "mxy").alias("mxy"))
    return _join(spark, lb, windows, in_envelope("x", "y", "mnx", "mxx", "mny", "mxy"))


__all__ = ["LeafBuckets", "copartition", "window_pairs", "store_windows", "copartitioned_pip_join", "copartitioned_range_join"]
