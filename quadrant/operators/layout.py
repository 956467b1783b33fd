"""A space-clustered Parquet table, the stand-in for a spatial index.

Points are range-partitioned and sorted by their Morton code over a fixed
grid, then written as Parquet.  Nearby points land in the same files and row
groups, so the min/max statistics Parquet keeps for x and y let a later range
filter skip everything outside the window (Q2).  The write goes to the shared
folder the cluster names in ``spark.checkpoint.dir`` unless a path is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.functions.geometry import grid_coord, with_morton
from quadrant.functions.generators import MAX_X, MAX_Y, MIN_X, MIN_Y
from quadrant.session import scratch_path

WORKLOAD_EXTENT = (MIN_X, MAX_X, MIN_Y, MAX_Y)


def zorder(pts: DataFrame, extent: tuple[float, float, float, float] = WORKLOAD_EXTENT,
           depth: int = 16) -> DataFrame:
    """Attach ``zkey``: the Morton code of each point on a fixed 2^depth grid."""
    mnx, mxx, mny, mxy = (float(v) for v in extent)
    gx = grid_coord("x", F.lit(mnx), F.lit(mxx), depth)
    gy = grid_coord("y", F.lit(mny), F.lit(mxy), depth)
    return with_morton(pts, gx, gy, "zkey")


def write_clustered(pts: DataFrame, path: str | None = None, partitions: int | None = None,
                    extent: tuple[float, float, float, float] | None = None,
                    depth: int = 16, rows_per_group: int | None = None) -> str:
    """Write ``pts`` clustered by Z-order and return the path.

    The grid covers the data's own extent (one aggregate) unless ``extent`` fixes it.
    ``partitions`` defaults to ``spark.sql.shuffle.partitions``; choose it so
    each output file is a few hundred MB at the target scale.  The range
    partitioner samples the keys to find its bounds, and ``sortWithinPartitions``
    spills to disk when needed, so neither step holds a partition in memory.
    """
    spark = pts.sparkSession
    path = path or scratch_path(spark, "clustered")
    if extent is None:
        extent = tuple(pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
        extent = extent if extent[0] is not None else WORKLOAD_EXTENT
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The row number breaks ties so that a key holding a third of all rows is
    # still split evenly across range partitions (and files).
    keyed = zorder(pts, extent, depth).withColumn("_tie", F.monotonically_increasing_id())
    writer = (keyed.repartitionByRange(n, "zkey", "_tie").sortWithinPartitions("zkey", "_tie")
              .drop("_tie").write.mode("errorifexists"))
    if rows_per_group:
        writer = writer.option("parquet.block.size", str(rows_per_group * 24))
    writer.parquet(path)
    return path


def read_clustered(spark, path: str) -> DataFrame:
    """Read a clustered table back as a point set (``zkey`` kept for reuse)."""
    return spark.read.parquet(path)


__all__ = ["zorder", "write_clustered", "read_clustered", "WORKLOAD_EXTENT"]
