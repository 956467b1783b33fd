"""Named queries over the driver's tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
derived point sets (see ``quadrant.sources.derived``).  Query points, windows
and seeds are parameters of the workload (as in the reference, which draws
them at random); every result grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.generators import (MIN_X, MIN_Y, SPAN_X, SPAN_Y, point_literal, points_for, query_point_value,
                                           query_points, query_window_value, query_windows, windows_for)
from quadrant.functions.geometry import in_envelope
from quadrant.operators.copartition import copartition, copartitioned_pip_join, copartitioned_range_join, store_windows
from quadrant.operators.index import (indexed, index_knn, index_knn_batch, index_knn_join,
                                      index_pip_join, index_range, index_range_counts, index_range_join)
from quadrant.operators.join import grouped, grouped_summary, grouped_summary_bitmap, matched_window_count, pip_join
from quadrant.operators.knn import knn, knn_batch
from quadrant.operators.layout import read_clustered, write_clustered
from quadrant.operators.partitioned import leaf_pip_join, leaf_range_join, partition_by_leaves
from quadrant.operators.quadtree import assign_leaves, quadtree, windows_to_leaves
from quadrant.operators.range import range_counts, range_join, range_query
from quadrant.operators.ring import ring_edges
from quadrant.operators.slabs import slab_pip_join
from quadrant.plans.knn_join import knn_join, knn_rings
from quadrant.session import materialize, persisted, scratch_path
from quadrant.sources.derived import a_from, b_from, points_a, points_b, points_c, points_d
from quadrant.sources.documents import read_documents, write_documents
from quadrant.streaming.points import knn_of_available, run_available, stream_pip_join, stream_range, table_stream
from quadrant.sources.points import extent, points_sql, read_points

# The sizes of the workload (shared with the oracle SQL).
K_KNN = 1000             # kNN size of the plain kNN workloads
K_RING = 100             # kNN size feeding the ring polygon
SEED_POINT = (-119.0, 34.5)
N_WINDOWS = 10           # windows per batch range workload
WINDOW_SEED = 7
RANGE_WINDOW = (0, 3)    # (row, seed) of the single range window
KNN_POINT = (4, 5)       # (row, seed) of the single kNN query point
N_QUERIES = 10           # query points per batch kNN workload
QUERY_SEED = 11
N_SEEDS = 11             # seeds of the batch kNN-join (declared in the reference)
SEEDS_SEED = 13
CELL = "auto"            # cell side of the two-phase kNN: sized from the data
CUSTOMER_SEED = 17       # points and windows drawn for customers
K_MANY = 5               # neighbours per customer
COUNT_SHARE = 0.3        # how far the customers' windows are drawn in, for counts and for pairs
PAIR_SHARE = 0.02
MIDDLE_Y = 34.5          # the jagged ring lies above this
QT_DEPTH = 12            # quad-tree depth cap
QT_CAP = 500             # quad-tree leaf capacity


def _range_window() -> tuple[float, float, float, float]:
    return query_window_value(*RANGE_WINDOW)


def _knn_point() -> tuple[float, float]:
    return query_point_value(*KNN_POINT)


def extent_count(spark, d):
    return extent(points_b(spark, d))


def points_sql_projection(spark, d):
    return points_sql(spark, points_b(spark, d), view="origin", columns="id, x, y")


def points_from_csv(spark, d):
    path = scratch_path(spark, "points-csv")
    points_b(spark, d).select("x", "y", "id").write.csv(path)
    return read_points(spark, path, format="csv", schema="x DOUBLE, y DOUBLE, id BIGINT",
                       id="id").select("id", "x", "y")


def points_from_json(spark, d):
    path = scratch_path(spark, "points-json")
    points_b(spark, d).select("id", "x", "y").write.json(path)
    return read_points(spark, path, format="json", schema="id BIGINT, x DOUBLE, y DOUBLE",
                       id="id").select("id", "x", "y")


def range_window(spark, d):
    return range_query(points_b(spark, d), *_range_window()).select("id", "x", "y")


def range_window_clustered(spark, d):
    path = write_clustered(points_b(spark, d))
    return range_query(read_clustered(spark, path), *_range_window()).select("id", "x", "y")


def _windows(spark):
    return query_windows(spark, N_WINDOWS, WINDOW_SEED)


def range_batch_count(spark, d):
    return range_counts(points_b(spark, d), _windows(spark), known_windows=N_WINDOWS)


def range_batch_count_cells(spark, d):
    pts = points_b(spark, d)
    qt = quadtree(pts, max_depth=QT_DEPTH)
    return range_counts(pts, _windows(spark), strategy="cells", qt=qt, known_windows=N_WINDOWS)


def knn_point(spark, d):
    return knn(points_a(spark, d), *_knn_point(), K_KNN)


def knn_point_cells(spark, d):
    return knn(points_a(spark, d), *_knn_point(), K_KNN, strategy="cells", cell=CELL)


def _queries(spark):
    return query_points(spark, N_QUERIES, QUERY_SEED)


def knn_batch_brute(spark, d):
    return knn_batch(points_a(spark, d), _queries(spark), K_KNN, strategy="brute",
                     known_queries=N_QUERIES)


def knn_batch_cells(spark, d):
    return knn_batch(points_a(spark, d), _queries(spark), K_KNN, strategy="cells", cell=CELL,
                     known_queries=N_QUERIES)


def knn_ring(spark, d):
    seed = point_literal(spark, *SEED_POINT)
    nn = knn_batch(points_a(spark, d), seed, K_RING, strategy="brute", known_queries=1)
    return ring_edges(nn.select("q", "rank", "x", "y"))


def _seed_rings(spark, d):
    seeds = query_points(spark, N_SEEDS, SEEDS_SEED)
    return knn_rings(points_a(spark, d), seeds, K_RING, known_seeds=N_SEEDS)


def _pip(spark, d, predicate, strategy):
    pts = points_b(spark, d)
    qt = None
    if strategy == "cells":
        qt = quadtree(pts, max_depth=QT_DEPTH)
    return pip_join(pts, _seed_rings(spark, d), predicate=predicate, strategy=strategy, qt=qt,
                    known_windows=N_SEEDS, known_edges=K_RING).select("window_id", "id", "x", "y")


def pip_join_intersects(spark, d):
    return _pip(spark, d, "intersects", "broadcast")


def pip_join_covers_cells(spark, d):
    return _pip(spark, d, "covers", "cells")


def pip_join_interior(spark, d):
    return _pip(spark, d, "interior", "broadcast")


def pip_join_grouped(spark, d):
    return grouped_summary(_pip(spark, d, "intersects", "broadcast"))


def pip_join_grouped_pairs(spark, d):
    """J3 as the distributed set of (window, point id) pairs."""
    return grouped(_pip(spark, d, "intersects", "broadcast"))


def range_window_count(spark, d):
    """A1: count action on a range result, as a one-row frame."""
    return range_query(points_b(spark, d), *_range_window()).agg(F.count(F.lit(1)).alias("n"))


def knn_point_count(spark, d):
    """A2: size of a kNN result (k, or n when k > n)."""
    return knn(points_a(spark, d), *_knn_point(), K_KNN).agg(F.count(F.lit(1)).alias("n"))


def matched_window_count_q(spark, d):
    return matched_window_count(_pip(spark, d, "intersects", "broadcast"))


def knn_join_q(spark, d):
    seed = point_literal(spark, *SEED_POINT)
    return knn_join(points_a(spark, d), points_b(spark, d), seed, K_RING,
                    strategy="broadcast", known_seeds=1).select("window_id", "id", "x", "y")


def knn_join_cells(spark, d):
    seed = point_literal(spark, *SEED_POINT)
    pts_b = points_b(spark, d)
    qt = quadtree(pts_b, max_depth=QT_DEPTH)
    return knn_join(points_a(spark, d), pts_b, seed, K_RING, strategy="cells", qt=qt,
                    knn_strategy="cells", cell=CELL, known_seeds=1).select("window_id", "id", "x", "y")


def knn_join_batch(spark, d):
    seeds = query_points(spark, N_SEEDS, SEEDS_SEED)
    m = knn_join(points_a(spark, d), points_c(spark, d), seeds, K_RING, strategy="broadcast",
                 known_seeds=N_SEEDS)
    return grouped_summary(m)


def quadtree_leaves(spark, d):
    return quadtree(points_d(spark, d), max_depth=QT_DEPTH, cap=QT_CAP).leaves


def quadtree_assign(spark, d):
    pts = points_d(spark, d)
    qt = quadtree(pts, max_depth=QT_DEPTH, cap=QT_CAP)
    return assign_leaves(pts, qt).select("id", "x", "y", "depth", "prefix")


def windows_to_leaves_q(spark, d):
    qt = quadtree(points_d(spark, d), max_depth=QT_DEPTH, cap=QT_CAP)
    return windows_to_leaves(_windows(spark), qt)


def range_pairs_cells(spark, d):
    """Q3 as pairs through quad-tree cells, over the skewed set."""
    pts = points_d(spark, d)
    qt = quadtree(pts, max_depth=QT_DEPTH)
    return range_join(pts, _windows(spark), strategy="cells", qt=qt,
                      known_windows=N_WINDOWS).select("window_id", "id", "x", "y")


def range_pairs_dup_windows(spark, d):
    """Q3 by cells with every window twice under one id, once more under a NULL id."""
    w = _windows(spark)
    both = w.unionByName(w).unionByName(w.withColumn("window_id", F.lit(None).cast("bigint")))
    return range_join(points_d(spark, d), both, strategy="cells").select("window_id", "id", "x", "y")


def pip_join_foreign_tree(spark, d):
    """J2 with a tree of the skewed set D over the points of B."""
    qt = quadtree(points_d(spark, d), max_depth=QT_DEPTH)
    return pip_join(points_b(spark, d), _seed_rings(spark, d), "covers", strategy="cells", qt=qt).select("window_id", "id", "x", "y")


def _carried(df):
    """Columns under names that operators use themselves."""
    return df.withColumn("depth", F.col("id") % 7).withColumn("rank", F.col("id") % 5).withColumn("mnx", F.col("x") * 2)


def points_from_csv_carried(spark, d):
    """The other columns of a CSV source ride along."""
    path = scratch_path(spark, "points-csv-carried")
    _carried(points_b(spark, d)).select("x", "y", "id", "depth", "rank", "mnx").write.csv(path)
    return read_points(spark, path, format="csv", schema="x DOUBLE, y DOUBLE, id BIGINT, depth BIGINT, rank BIGINT, mnx DOUBLE",
                       id="id").select("id", "x", "y", "depth", "rank", "mnx")


def pip_join_carried(spark, d):
    """S2 through a cell join: carried columns named depth, rank and mnx."""
    pts = _carried(points_b(spark, d))
    return pip_join(pts, _seed_rings(spark, d), "covers", strategy="cells").select("window_id", "id", "x", "y", "depth", "rank", "mnx")


def knn_join_batch_indexed(spark, d):
    """J6 + J7: the batch kNN-join through indexes."""
    seeds = query_points(spark, N_SEEDS, SEEDS_SEED)
    idx_a, idx_b = indexed(points_a(spark, d)), indexed(points_c(spark, d))
    return grouped_summary(index_knn_join(spark, idx_a, idx_b, seeds, K_RING))


# --- through the persisted spatial index (Q2, Q5, J2, J6 "using index") ----------

def range_window_indexed(spark, d):
    idx = indexed(points_b(spark, d))
    return index_range(spark, idx, *_range_window()).select("id", "x", "y")


def range_batch_count_indexed(spark, d):
    idx = indexed(points_b(spark, d))
    pairs = index_range_join(spark, idx, _windows(spark))
    counts = pairs.groupBy("window_id").count().withColumnRenamed("count", "n")
    return (_windows(spark).select("window_id").join(counts, "window_id", "left")
            .select("window_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def knn_point_indexed(spark, d):
    idx = indexed(points_a(spark, d))
    return index_knn(spark, idx, *_knn_point(), K_KNN).select("rank", "id", "x", "y", "d2")


def knn_batch_indexed(spark, d):
    idx = indexed(points_a(spark, d))
    return index_knn_batch(spark, idx, _queries(spark), K_KNN).select("q", "rank", "id", "x", "y", "d2")


def pip_join_indexed(spark, d):
    idx = indexed(points_b(spark, d))
    return index_pip_join(spark, idx, _seed_rings(spark, d), "covers").select("window_id", "id", "x", "y")


def knn_join_indexed(spark, d):
    idx_a, idx_b = indexed(points_a(spark, d)), indexed(points_b(spark, d))
    seed = point_literal(spark, *SEED_POINT)
    return index_knn_join(spark, idx_a, idx_b, seed, K_RING).select("window_id", "id", "x", "y")


# --- points stored partitioned by quad-tree leaf (J2/J6 "partitioned + indexed") -----

def pip_join_covers_partitioned(spark, d):
    lp = partition_by_leaves(points_b(spark, d))
    return leaf_pip_join(spark, lp, _seed_rings(spark, d), "covers", known_windows=N_SEEDS,
                         known_edges=K_RING).select("window_id", "id", "x", "y")


def knn_join_partitioned(spark, d):
    pts_b = points_b(spark, d)
    lp = partition_by_leaves(pts_b)
    seed = point_literal(spark, *SEED_POINT)
    rings = knn_rings(points_a(spark, d), seed, K_RING, known_seeds=1)
    return leaf_pip_join(spark, lp, rings, "intersects", known_windows=1,
                         known_edges=K_RING).select("window_id", "id", "x", "y")


def range_pairs_partitioned(spark, d):
    pts = points_d(spark, d)
    lp = partition_by_leaves(pts)
    return leaf_range_join(spark, lp, _windows(spark)).select("window_id", "id", "x", "y")


# --- streaming: lineitem files as a stream of points -------------------------------

def stream_range_window(spark, d):
    pts = b_from(table_stream(spark, d, "lineitem"))
    return run_available(stream_range(pts, *_range_window()).select("id", "x", "y"), "range")


def stream_pip_join_q(spark, d):
    pts = b_from(table_stream(spark, d, "lineitem"))
    joined = stream_pip_join(pts, _seed_rings(spark, d), "intersects", known_windows=N_SEEDS)
    return run_available(joined.select("window_id", "id", "x", "y"), "pip")


# --- query tables and windows drawn for the rows of a table -------------------------

def _customers(spark, d):
    return spark.read.parquet(f"{d.rstrip('/')}/customer.parquet")


def random_points(spark, d):
    """A query point per customer."""
    return points_for(_customers(spark, d), "c_custkey", CUSTOMER_SEED)


def random_windows(spark, d):
    """A window per customer."""
    return windows_for(_customers(spark, d), "c_custkey", CUSTOMER_SEED)


def knn_batch_indexed_many(spark, d):
    """Q7: neighbours of every customer's point through the index."""
    return index_knn_batch(spark, indexed(points_a(spark, d)), random_points(spark, d), K_MANY).select("q", "rank", "id", "x", "y", "d2")


def range_counts_pyramid(spark, d):
    """Q3 + A1: counts of every customer's window over the skewed set; only border cells read points."""
    return index_range_counts(spark, indexed(points_d(spark, d)), windows_for(_customers(spark, d), "c_custkey", CUSTOMER_SEED, COUNT_SHARE))


def range_pairs_indexed_many(spark, d):
    """Q3: pairs of every customer's small window and the points in it, through the index."""
    w = windows_for(_customers(spark, d), "c_custkey", CUSTOMER_SEED, PAIR_SHARE)
    return index_range_join(spark, indexed(points_b(spark, d)), w).select("window_id", "id", "x", "y")


# --- points and windows in the same buckets (J2, L3) ---------------------------------

def pip_join_copartitioned(spark, d):
    lb = copartition(points_b(spark, d))
    windows = store_windows(spark, lb, materialize(_seed_rings(spark, d), "rings"))
    return copartitioned_pip_join(spark, lb, windows, "covers").select("window_id", "id", "x", "y")


def range_pairs_copartitioned(spark, d):
    lb = copartition(points_d(spark, d), quadtree(points_d(spark, d), max_depth=QT_DEPTH))
    return copartitioned_range_join(spark, lb, _windows(spark)).select("window_id", "id", "x", "y")


# --- document collections (S3) ---------------------------------------------------------

def points_documents(spark, d):
    """S3: points written as documents and read back."""
    path = scratch_path(spark, "documents")
    write_documents(points_b(spark, d).select("id", "x", "y"), path)
    return read_documents(spark, path, "id BIGINT, x DOUBLE, y DOUBLE", id="id").select("id", "x", "y")


def range_window_documents(spark, d):
    """Q1 on a collection: the window's bounds skip files."""
    path = scratch_path(spark, "documents")
    write_documents(points_b(spark, d).select("id", "x", "y"), path)
    bounds = in_envelope("x", "y", *_range_window())
    return read_documents(spark, path, "id BIGINT, x DOUBLE, y DOUBLE", id="id", where=bounds).select("id", "x", "y")


# --- one ring of very many edges (P2, P3) ----------------------------------------------

def horizon_edges(spark, d):
    """A ring with an edge per event: a jagged line from west to east over the events, closed below it."""
    t = spark.read.parquet(f"{d.rstrip('/')}/events.parquet").select(F.col("event_id").alias("e"))
    n = t.agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("e").alias("last"))
    x = lambda e: F.lit(MIN_X) + e / F.col("n") * F.lit(SPAN_X)
    y = lambda e: F.lit(MIDDLE_Y) + (e * 104729 + 71) % 1000033 / F.lit(1000033.0) * F.lit(SPAN_Y / 2)
    line = t.crossJoin(F.broadcast(n)).where(F.col("e") < F.col("last"))
    line = line.select(x(F.col("e")).alias("x1"), y(F.col("e")).alias("y1"), x(F.col("e") + 1).alias("x2"), y(F.col("e") + 1).alias("y2"))
    zero, last = F.lit(0).cast("bigint"), F.col("last")
    ends = n.where(last > 0).select(F.explode(F.array(*(F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2")) for a, b, c, e in (
        (x(last), y(last), x(last), F.lit(MIN_Y)), (x(last), F.lit(MIN_Y), x(zero), F.lit(MIN_Y)), (x(zero), F.lit(MIN_Y), x(zero), y(zero)))))).alias("s")).select("s.*")
    return line.unionByName(ends).withColumn("window_id", F.lit(0).cast("bigint"))


def pip_join_many_edges(spark, d):
    return slab_pip_join(points_a(spark, d), horizon_edges(spark, d), "covers").select("window_id", "id", "x", "y")


# --- distinct ids by bitmaps, reuse, neighbours on a stream -----------------------------

def pip_join_grouped_bitmap(spark, d):
    return grouped_summary_bitmap(_pip(spark, d, "intersects", "broadcast"))


def persisted_reuse(spark, d):
    """L4: one persisted point set under three queries."""
    with persisted(points_b(spark, d)) as pts:
        parts = [range_counts(pts, _windows(spark)).select(F.lit("range").alias("query"), F.col("window_id").alias("k"), "n"),
                 range_query(pts, *_range_window()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("window").alias("query"), F.lit(0).cast("bigint").alias("k"), "n"),
                 extent(pts).select(F.lit("all").alias("query"), F.lit(0).cast("bigint").alias("k"), "n")]
        return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "reused")


def stream_knn_q(spark, d):
    """T1/Q7 on a stream: neighbours of the query points among the orders that have arrived."""
    pts = a_from(table_stream(spark, d, "orders"))
    return knn_of_available(pts, _queries(spark), K_RING).select("q", "rank", "id", "x", "y", "d2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extent_count": extent_count,
    "points_sql_projection": points_sql_projection,
    "points_from_csv": points_from_csv,
    "points_from_json": points_from_json,
    "points_from_csv_carried": points_from_csv_carried,
    "range_window": range_window,
    "range_window_clustered": range_window_clustered,
    "range_batch_count": range_batch_count,
    "range_batch_count_cells": range_batch_count_cells,
    "range_pairs_cells": range_pairs_cells,
    "range_pairs_dup_windows": range_pairs_dup_windows,
    "knn_point": knn_point,
    "knn_point_cells": knn_point_cells,
    "knn_batch": knn_batch_brute,
    "knn_batch_cells": knn_batch_cells,
    "knn_ring": knn_ring,
    "pip_join_intersects": pip_join_intersects,
    "pip_join_covers_cells": pip_join_covers_cells,
    "pip_join_foreign_tree": pip_join_foreign_tree,
    "pip_join_carried": pip_join_carried,
    "pip_join_interior": pip_join_interior,
    "pip_join_grouped": pip_join_grouped,
    "pip_join_grouped_pairs": pip_join_grouped_pairs,
    "range_window_count": range_window_count,
    "knn_point_count": knn_point_count,
    "matched_window_count": matched_window_count_q,
    "knn_join": knn_join_q,
    "knn_join_cells": knn_join_cells,
    "knn_join_batch": knn_join_batch,
    "quadtree_leaves": quadtree_leaves,
    "quadtree_assign": quadtree_assign,
    "windows_to_leaves": windows_to_leaves_q,
    "range_window_indexed": range_window_indexed,
    "range_batch_count_indexed": range_batch_count_indexed,
    "knn_point_indexed": knn_point_indexed,
    "knn_batch_indexed": knn_batch_indexed,
    "pip_join_indexed": pip_join_indexed,
    "knn_join_indexed": knn_join_indexed,
    "knn_join_batch_indexed": knn_join_batch_indexed,
    "pip_join_covers_partitioned": pip_join_covers_partitioned,
    "knn_join_partitioned": knn_join_partitioned,
    "range_pairs_partitioned": range_pairs_partitioned,
    "stream_range_window": stream_range_window,
    "stream_pip_join": stream_pip_join_q,
    "random_points": random_points,
    "random_windows": random_windows,
    "knn_batch_indexed_many": knn_batch_indexed_many,
    "range_counts_pyramid": range_counts_pyramid,
    "range_pairs_indexed_many": range_pairs_indexed_many,
    "pip_join_copartitioned": pip_join_copartitioned,
    "range_pairs_copartitioned": range_pairs_copartitioned,
    "points_documents": points_documents,
    "range_window_documents": range_window_documents,
    "pip_join_many_edges": pip_join_many_edges,
    "pip_join_grouped_bitmap": pip_join_grouped_bitmap,
    "persisted_reuse": persisted_reuse,
    "stream_knn": stream_knn_q,
}

__all__ = ["QUERIES"]
