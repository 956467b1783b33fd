"""Benchmark the headline spatial workloads; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_REPEATS`` (default 3).

As in the reference programs, loading the point sets and building the
"index" (the quad-tree cells, the clustered table) happen before the timer
and are reported separately; each query is run once to warm up, then timed
``BENCH_REPEATS`` times, and the median is reported.  Results are fully
materialised with the ``noop`` sink (every row and column computed, nothing
collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quadrant.functions.generators import point_literal, query_point_value, query_points, query_window_value, query_windows  # noqa: E402
from quadrant.operators.index import (build_index, index_knn, index_knn_batch, index_knn_join,  # noqa: E402
                                      index_pip_join, index_range)
from quadrant.operators.join import grouped_summary, pip_join  # noqa: E402
from quadrant.operators.knn import knn, knn_batch  # noqa: E402
from quadrant.operators.layout import read_clustered, write_clustered  # noqa: E402
from quadrant.operators.partitioned import leaf_pip_join, partition_by_leaves  # noqa: E402
from quadrant.operators.quadtree import quadtree  # noqa: E402
from quadrant.operators.range import range_counts, range_query  # noqa: E402
from quadrant.plans import catalog as C  # noqa: E402
from quadrant.plans.knn_join import knn_join, knn_rings  # noqa: E402
from quadrant.session import local_session, materialize, scratch_path  # noqa: E402
from quadrant.sources.derived import points_a, points_b, points_c  # noqa: E402
from quadrant.sources.points import read_points  # noqa: E402


def _sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app_name="quadrant-bench")

    setup: dict[str, float] = {}

    # Load: the point sets as stored tables with plain x, y columns, in as many
    # files as there are task slots (a one-file table would run in one task).
    stored = {}

    def load():
        for name, fn in (("a", points_a), ("b", points_b), ("c", points_c)):
            path = scratch_path(spark, f"points-{name}")
            fn(spark, sf_dir).repartition(int(cpus)).write.parquet(path)
            stored[name] = path
    setup["load"] = _timed(load)
    csv_b = scratch_path(spark, "points-b-csv")
    spark.read.parquet(stored["b"]).select("x", "y", "id").write.csv(csv_b)
    A = spark.read.parquet(stored["a"])
    B = spark.read.parquet(stored["b"])
    Cp = spark.read.parquet(stored["c"])

    holder = {}

    def build_clustered():
        holder["clustered"] = write_clustered(B, partitions=int(cpus), rows_per_group=8192)
    setup["clustered_build"] = _timed(build_clustered)
    BZ = read_clustered(spark, holder["clustered"])

    def build_indexes():
        holder["ia"] = build_index(A, partitions=int(cpus))
        holder["ib"] = build_index(B, partitions=int(cpus), rows_per_group=8192)
    setup["index_build"] = _timed(build_indexes)
    ia, ib = holder["ia"], holder["ib"]

    def build_tree():
        holder["qt"] = quadtree(B, max_depth=C.QT_DEPTH, target_leaves=1024)
    setup["quadtree_build"] = _timed(build_tree)
    qt = holder["qt"]

    def build_partitioned():
        holder["lp"] = partition_by_leaves(B, qt, partitions=int(cpus))
    setup["leaf_partition_build"] = _timed(build_partitioned)
    lp = holder["lp"]

    rw = query_window_value(*C.RANGE_WINDOW)
    kp = query_point_value(*C.KNN_POINT)
    windows = query_windows(spark, C.N_WINDOWS, C.WINDOW_SEED)
    qpts = query_points(spark, C.N_QUERIES, C.QUERY_SEED)
    seeds = query_points(spark, C.N_SEEDS, C.SEEDS_SEED)
    seed = point_literal(spark, *C.SEED_POINT)

    workloads = {
        "load_csv": lambda: read_points(spark, csv_b, schema="x DOUBLE, y DOUBLE, id BIGINT", id="id"),
        "range_window": lambda: range_query(B, *rw),
        "range_window_clustered": lambda: range_query(BZ, *rw),
        "range_batch_count": lambda: range_counts(B, windows, known_windows=C.N_WINDOWS),
        "knn_point": lambda: knn(A, *kp, C.K_KNN),
        "knn_point_cells": lambda: knn(A, *kp, C.K_KNN, strategy="cells", cell=C.CELL),
        "knn_batch": lambda: knn_batch(A, qpts, C.K_KNN, strategy="brute", known_queries=C.N_QUERIES),
        "knn_batch_cells": lambda: knn_batch(A, qpts, C.K_KNN, strategy="cells", cell=C.CELL,
                                             known_queries=C.N_QUERIES),
        "knn_join": lambda: knn_join(A, B, seed, C.K_RING, strategy="broadcast", known_seeds=1),
        "knn_join_cells": lambda: knn_join(A, B, seed, C.K_RING, strategy="cells", qt=qt,
                                           knn_strategy="cells", cell=C.CELL, known_seeds=1),
        "pip_join_intersects": lambda: pip_join(
            B, knn_rings(A, seeds, C.K_RING, known_seeds=C.N_SEEDS), known_windows=C.N_SEEDS),
        "knn_join_batch": lambda: grouped_summary(
            knn_join(A, Cp, seeds, C.K_RING, strategy="broadcast", known_seeds=C.N_SEEDS)),
    }

    workloads.update({
        "range_window_indexed": lambda: index_range(spark, ib, *rw),
        "knn_point_indexed": lambda: index_knn(spark, ia, *kp, C.K_KNN),
        "knn_batch_indexed": lambda: index_knn_batch(spark, ia, qpts, C.K_KNN),
        "pip_join_indexed": lambda: index_pip_join(spark, ib, rings_b),
        "knn_join_indexed": lambda: index_knn_join(spark, ia, ib, seed, C.K_RING),
        "pip_join_partitioned": lambda: leaf_pip_join(spark, lp, rings_b, known_windows=C.N_SEEDS,
                                                      known_edges=C.K_RING),
        "knn_join_partitioned": lambda: leaf_pip_join(
            spark, lp, knn_rings(A, seed, C.K_RING, known_seeds=1), known_windows=1, known_edges=C.K_RING),
    })
    rings_b = materialize(knn_rings(A, seeds, C.K_RING, known_seeds=C.N_SEEDS), "bench-rings")

    results: dict[str, float] = {}
    for name, build in workloads.items():
        _sink(build())  # warm-up
        times = [_timed(lambda: _sink(build())) for _ in range(repeats)]
        results[name] = round(statistics.median(times), 4)

    total = round(sum(results.values()), 4)
    print(json.dumps({
        "metric": "total_median_query_sec", "value": total, "unit": "sec",
        "queries": results, "setup": {k: round(v, 4) for k, v in setup.items()},
        "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": int(cpus), "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
