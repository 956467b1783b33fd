"""Points arriving as files: the same operators over Structured Streaming.

The reference loads its point files once per run.  When new point files keep
landing in a folder, the range filter (Q1) and the polygon join against a
fixed window table (J1) apply unchanged to a streaming DataFrame: a filter,
and a stream-static inner join with the (broadcast, size-checked) window
table.  kNN needs a global order over all points and is not a streaming
operator.

Results go to a Parquet sink whose commit log makes each micro-batch land
exactly once; the checkpoint lives under the shared folder the cluster names
in ``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from quadrant.functions.geometry import grid_coord, guarded_in_polygon
from quadrant.operators.join import pip_join
from quadrant.operators.knn import _out, _ranked, knn_batch
from quadrant.operators.sizing import MAX_BROADCAST_EDGES, MAX_LOOP_ROWS, MAX_BROADCAST_ROWS, maybe_broadcast_polygons
from quadrant.operators.range import range_query
from quadrant.session import materialize, scratch_path
from quadrant.sources.points import BAD_RECORD, points


def read_points_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                       format: str = "csv", x: str = "x", y: str = "y", id: str = "id",
                       glob: str | None = None, max_files_per_trigger: int | None = None,
                       options: dict | None = None) -> DataFrame:
    """A streaming point set from a folder of CSV / JSON / Parquet files.

    The schema is required (streams never infer) and must hold an id column:
    row numbers are not stable across micro-batches.  ``glob`` keeps only the
    matching file names; ``max_files_per_trigger`` bounds each micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if format == "csv":
        reader = reader.option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = reader.options(**(options or {})).format(format).load(path)
    if BAD_RECORD in df.columns:
        df = df.drop(BAD_RECORD)
    return points(df, x=x, y=y, id=id)


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """One of the driver's Parquet tables read as a stream of files."""
    d = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(d)


def stream_range(stream: DataFrame, x1: float, x2: float, y1: float, y2: float) -> DataFrame:
    """Q1 on a stream: each micro-batch keeps the points inside the window."""
    return range_query(stream, x1, x2, y1, y2)


def stream_pip_join(stream: DataFrame, windows: DataFrame, predicate: str = "intersects",
                    known_windows: int | None = None, known_edges: int | None = None) -> DataFrame:
    """J1 on a stream: every arriving point tested against a fixed window table.

    The window table is written once to the shared folder first, so it is not
    recomputed for every micro-batch.  Up to ``MAX_LOOP_ROWS`` windows it is
    broadcast and every point meets every window's box; beyond that, each
    window is replicated to the grid cells its box overlaps and each point
    meets only its own cell's windows (a stream-static equi-join).  Windows and edges are
    counted; ``known_windows`` and ``known_edges`` are the caller's word and not relied on.
    """
    fixed = materialize(windows.select("window_id", "edges", "mnx", "mxx", "mny", "mxy"), "stream-windows")
    r = fixed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("edges")).alias("edges")).first()
    if r["n"] <= MAX_LOOP_ROWS and (r["edges"] or 0) <= MAX_BROADCAST_EDGES:
        return pip_join(stream, fixed, predicate=predicate, strategy="broadcast")
    cells, grid = _window_cells(fixed)
    cells, _ = maybe_broadcast_polygons(cells)
    mnx, mxx, mny, mxy, depth = grid["minx"], grid["maxx"], grid["miny"], grid["maxy"], grid["depth"]
    keyed = (stream.withColumn("_gx", grid_coord("x", F.lit(mnx), F.lit(mxx), depth))
             .withColumn("_gy", grid_coord("y", F.lit(mny), F.lit(mxy), depth)))
    hit = guarded_in_polygon("edges", "x", "y", "mnx", "mxx", "mny", "mxy", predicate)
    return keyed.join(cells, ["_gx", "_gy"]).where(hit).select("window_id", *stream.columns)


def _window_cells(fixed: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, dict]:
    """Windows replicated to the cells of a grid over their extent.

    The grid is sized so an average window box spans about one cell, then
    coarsened until the replicas fit ``max_rows`` (or the grid is one cell).
    Only aggregates over the small window table run on the driver.
    """
    e = fixed.agg(F.min("mnx"), F.max("mxx"), F.min("mny"), F.max("mxy"),
                  F.avg(F.col("mxx") - F.col("mnx")), F.avg(F.col("mxy") - F.col("mny"))).first()
    mnx, mxx, mny, mxy, aw, ah = (float(v) for v in e)
    span = max(mxx - mnx, mxy - mny, 1e-300)
    size = max(aw, ah, span * 1e-6)
    depth = max(0, min(16, int(math.floor(math.log2(span / size)))))
    while True:
        gx1 = grid_coord("mnx", F.lit(mnx), F.lit(mxx), depth)
        gx2 = grid_coord("mxx", F.lit(mnx), F.lit(mxx), depth)
        gy1 = grid_coord("mny", F.lit(mny), F.lit(mxy), depth)
        gy2 = grid_coord("mxy", F.lit(mny), F.lit(mxy), depth)
        spans = fixed.select(((gx2 - gx1 + 1) * (gy2 - gy1 + 1)).alias("c"))
        rows = spans.agg(F.sum("c")).first()[0] or 0
        if rows <= max_rows or depth == 0:
            break
        depth -= 1
    cells = (fixed.withColumn("_gx", F.explode(F.sequence(gx1, gx2)))
             .withColumn("_gy", F.explode(F.sequence(gy1, gy2))))
    cells = materialize(cells, "stream-window-cells")
    return cells, dict(minx=mnx, maxx=mxx, miny=mny, maxy=mxy, depth=depth, rows=rows)


def stream_knn(stream: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str | None = None) -> DataStreamWriter:
    """T1/Q7 on a stream: the k nearest points so far of every query, kept as a table that each micro-batch renews.

    Batch n ranks its own points, merges them with version n - 1 (k rows a query) and writes version n under ``path``.  A batch
    that is run again after a failure overwrites its own version from the same predecessor, so every version
    equals ``knn_batch`` over all that has arrived by then.  Returns the writer to ``start()``; :func:`knn_so_far` reads a version.
    """
    spark = stream.sparkSession
    fixed = materialize(queries.select("q", "qx", "qy"), "stream-queries")
    carried = [F.col(c) for c in stream.columns if c not in ("id", "x", "y")]

    def step(batch: DataFrame, number: int) -> None:
        best = knn_batch(batch, fixed, k).drop("rank")
        if number:
            best = best.unionByName(knn_so_far(spark, path, number - 1).drop("rank"))
        _out(_ranked(best, k), carried).write.mode("overwrite").parquet(_version(path, number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or scratch_path(spark, "stream-knn-checkpoint"))


def _version(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/version-{number:09d}"


def knn_so_far(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The neighbours after micro-batch ``number``."""
    return spark.read.parquet(_version(path, number))


def knn_of_available(stream: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The neighbours after all files available now, in as many micro-batches as the stream takes."""
    path = scratch_path(stream.sparkSession, "stream-knn")
    q = stream_knn(stream, queries, k, path).trigger(availableNow=True).start()
    q.awaitTermination()
    return knn_so_far(stream.sparkSession, path, q.lastProgress["batchId"])


def run_available(result: DataFrame, name: str = "stream") -> DataFrame:
    """Process every file available now into a Parquet table; return it as a batch frame."""
    spark = result.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-checkpoint")
    q = (result.writeStream.format("parquet").option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


__all__ = ["read_points_stream", "table_stream", "stream_range", "stream_pip_join", "stream_knn", "knn_so_far", "knn_of_available", "run_available"]
