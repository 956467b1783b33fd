"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: White space that separates words: space and U+0009 to U+000D, nothing else.
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; it does so once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system; workers live on between tasks and would hold it.

    Where the C library has no ``malloc_trim``, only Arrow's part is handed back.
    """
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def apart(df: DataFrame, taken: tuple[str, ...]) -> DataFrame:
    """``df`` with columns of the names ``taken`` under free ones; ``toDF`` gives the own names back, as places don't change."""
    out, used = df, {c.lower() for c in (*df.columns, *taken)}
    for c in df.columns:
        if c.lower() in taken:
            free = c
            while free.lower() in used:
                free += "_"
            used.add(free.lower())
            out = out.withColumnRenamed(c, free)
    return out


def squeeze(a: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane (the high ones of small numbers are all zero), compressed."""
    import zstandard
    a = np.ascontiguousarray(a)
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").reshape(-1)


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], n: int | None = None) -> DataFrame:
    """Exclusive running sums per group in a total order, with no group in one task.

    ``df`` is range-partitioned on (group, order) and written with the number of
    its partition (so a group of any size spans many of them); sums per (partition, group)
    give each partition its offset, and a window inside each (partition, group) does the rest.

    ``sums`` maps new columns to the summed ones (long).  Rows equal in group and
    order get their places in an arbitrary but fixed order.
    """
    spark = df.sparkSession
    n = n or partitions(spark)
    keys = [F.col(c).asc_nulls_last() for c in group]
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    totals = ranged.groupBy("_pid", *group).agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_o_pid"), *(F.col(c).alias(f"_o_{c}") for c in group),
        *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}_sum") for k in sums),
    )
    met = (F.col("_pid") == F.col("_o_pid"))
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l_{k}") for k, v in sums.items()))
    # At most one row per (partition, group): the join is small against the rows and never meets a hot key.
    out = local.join(offsets, met, "inner")
    return out.select(*df.columns, *((F.col(f"_l_{k}") + F.col(f"_o_{k}_sum")).cast("long").alias(k) for k in sums))
