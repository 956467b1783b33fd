"""Counts of points below and left of many places, at a cost in proportion to both.

A place asks for the weight of all points that come before it in one order (``_g, _u``) and are not above it in another
(``_v``).  No pair of place and point is made.  All rows are cut into strips of about equal size, once by each order.
What a place asks for is the sum of three parts: the points of its own strip, counted in the task that holds the strip;
those of the strips before it that share its band (its strip of the second order), counted in that band's task; and those of
earlier strips and lower bands, a running sum over one number per (strip, band).

Four places give the count of a rectangle, whatever its area, and edges right of a point are counted as points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.operators.sizing import small_or_shuffled
from quadrant.session import materialize

#: Rows of a strip: what one task holds at once.  More than a billion rows make the strips larger, not more.
STRIP_ROWS = 250_000
MAX_STRIPS = 4096
#: Where a place or point stands among equal values of an order: places that want less first, then points, then the others.
BEFORE, POINT, AFTER = 0, 1, 2
COLUMNS = ["_q", "_sign", "_n", "_g", "_u", "_u_at", "_v", "_v_at"]


def earlier_below(order: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place i: the weight of all j < i that come before i in ``order``, a permutation of the places.

    Blocks of places are halved; what a left half holds counts for the right half's places behind it in the order.
    """
    n = len(order)
    out, at = np.zeros(n, np.int64), np.arange(n)
    for bit in reversed(range(max(0, n - 1).bit_length())):
        start = order >> (bit + 1) << (bit + 1)
        right = (order >> bit) & 1 == 1
        held = np.where(right, 0, weight[order])
        before = np.cumsum(held) - held
        out[order[right]] += (before - before[start])[right]
        left = np.cumsum(~right) - ~right
        left -= left[start]
        to = start + np.where(right, (1 << bit) + at - start - left, left)
        halved = np.empty_like(order)
        halved[to] = order
        order = halved
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The rows of a task's partition as numpy columns; ``asks`` tells places from points."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if table is None or not table.num_rows:
        return None
    asks = table.column("_q").is_valid().to_numpy()
    return {"asks": asks, **{c: table.column(c).fill_null(0).to_numpy() for c in table.column_names}}


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One strip, sorted by the first order: each place's sum in it."""
    t = _whole(batches)
    if t is None:
        return
    found = earlier_below(np.lexsort((t["_v_at"], t["_v"])), t["_n"])
    strip = np.full(len(found), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(t["_q"], mask=~t["asks"]), *(pa.array(t[c]) for c in ("_sign", "_n", "_v", "_v_at")), pa.array(strip), pa.array(found)],
                                     names=["_q", "_sign", "_n", "_v", "_v_at", "_strip", "_found"])


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One band, sorted by the second order: each place's sum with that of its strip, and the band's weight strip by strip."""
    t = _whole(batches)
    if t is None:
        return
    found = t["_found"] + earlier_below(np.lexsort((~t["asks"], t["_strip"])), t["_n"])
    asks = t["asks"]
    strips, of = np.unique(t["_strip"][~asks], return_inverse=True)
    held = np.zeros(len(strips), np.int64)
    np.add.at(held, of, t["_n"][~asks])
    q = pa.concat_arrays([pa.array(t["_q"][asks]), pa.nulls(len(strips), pa.int64())])
    join = lambda a, b, kind: pa.array(np.concatenate([a, b]).astype(kind))
    yield pa.RecordBatch.from_arrays([q, join(t["_sign"][asks], np.zeros(len(strips)), np.int32), join(t["_strip"][asks], strips, np.int32),
                                      pa.array(np.full(len(q), TaskContext.get().partitionId(), np.int32)), join(found[asks], held, np.int64)],
                                     names=["_q", "_sign", "_strip", "_band", "_found"])


def dominated(rows: DataFrame, strip_rows: int | None = None) -> DataFrame:
    """``(_q, _found)``: for every place, the weight of the points before it in (_g, _u) and not above it in _v, times its sign.

    ``rows`` holds the ``COLUMNS``: points with ``_q`` NULL, weight ``_n`` and POINT as ``_u_at`` and ``_v_at``; places with a
    number ``_q``, a ``_sign`` and, per order, BEFORE (equal values don't count) or AFTER (they do).  Places may share a number:
    their sum is meant.  Points of smaller groups ``_g`` count too: a place at the group's start takes them away.
    Values must not be NULL or NaN.
    """
    spark = rows.sparkSession
    typed = rows.select(F.col("_q").cast("long"), F.col("_sign").cast("int"), F.col("_n").cast("long"), F.col("_g").cast("long"), (F.col("_u") + F.lit(0.0)).alias("_u"),
                        F.col("_u_at").cast("int"), (F.col("_v") + F.lit(0.0)).alias("_v"), F.col("_v_at").cast("int"))  # -0.0 becomes 0.0
    rows = materialize(typed, "dominance-rows")
    strips = min(MAX_STRIPS, max(1, -(-rows.count() // (strip_rows or STRIP_ROWS))))

    def cut(df: DataFrame, *order: str) -> DataFrame:
        # The row number parts equal rows over strips.
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        return df.repartitionByRange(strips, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")

    first = cut(rows, "_g", "_u", "_u_at").select("_q", "_sign", "_n", "_v", "_v_at").mapInArrow(_strip, "_q long, _sign int, _n long, _v double, _v_at int, _strip int, _found long")
    second = cut(materialize(first, "dominance-strips"), "_v", "_v_at").mapInArrow(_band, "_q long, _sign int, _strip int, _band int, _found long")
    told = materialize(second, "dominance-bands")
    every = spark.range(strips).select(F.col("id").cast("int").alias("_strip"))
    held = told.where(F.col("_q").isNull()).select(F.col("_strip").alias("_s"), F.col("_band").alias("_b"), "_found")
    grid = every.crossJoin(F.broadcast(every.withColumnRenamed("_strip", "_band"))).join(held, (F.col("_strip") == F.col("_s")) & (F.col("_band") == F.col("_b")), "left")
    lower = F.sum("_found").over(Window.partitionBy("_strip").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.sum("_lower").over(Window.partitionBy("_band").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("_lower", lower).select("_strip", "_band", F.coalesce(earlier, F.lit(0)).alias("_rest"))
    grid, _ = small_or_shuffled(grid, known_rows=strips * strips)
    return told.where(F.col("_q").isNotNull()).join(grid, ["_strip", "_band"]).select("_q", (F.col("_sign") * (F.col("_found") + F.col("_rest"))).alias("_found"))


__all__ = ["dominated", "earlier_below", "COLUMNS", "BEFORE", "POINT", "AFTER"]
