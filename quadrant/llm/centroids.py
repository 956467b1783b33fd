"""Centroid clustering with heap-ordered bounds (operator 12).

Lloyd's rounds on integer vectors.  After an exact look at all centroids a vector has a gap: the distance to the second nearest
centroid less that to its own.  When centroids move, the gap shrinks by at most its own centroid's drift plus the
largest drift of another one.  Instead of touching every gap, each cluster keeps an accumulated drift, and a vector is
filed under ``expires`` = gap + the drift accumulated when it was looked at.  As long as the cluster's accumulated drift
has not passed ``expires``, no other centroid can be nearer.  So a cluster's heap is its vectors in the order of ``expires``,
and a round pops those below the present drift: they alone are read and compared with all centroids again.

The heaps are tables.  A round writes what it has rescanned as a run, each task's rows sorted by (cluster, expires).  The drift only
grows, so of any run the rows below the last drift have been popped (they stand in a later run), the
rest are live, and what expires now is one range per cluster: a pushed-down filter that skips whole row groups and pages
of a sorted run.  Nothing is ever deleted or rewritten, no vector is shuffled, and a round costs what it pops.

Centroid sums follow by the popped vectors that changed cluster, as exact integers of any size: tasks give sums in limbs of 32 bits,
which Spark adds up; at most clusters x components x limbs of them come to the driver.

Rounding: distances are exact integers, their roots are not; ``expires`` is lowered and the drift raised by more than any
rounding error, which can only pop a vector early, never late.  Vectors too large for exact doubles (components of 2^22 and more at 64 components) are
compared in Python integers and expire every round.  Distances and inertias beyond a long are returned as the largest long.

Defined results: vectors that are NULL, of another length, or with a NULL or non-finite component (also after the
multiplication) are left out.  With fewer vectors than clusters there are as many clusters as vectors; without any the result is empty.  Repeated rows are
vectors of their own; a NULL vec_id is hashed as the text ``null``.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LONGEST = (1 << 63) - 1
#: More than the relative rounding error of any distance, gap or drift.
SLACK = 1e-9
#: Vectors compared at once.
ROWS = 8192


def scaled_vectors(vectors: DataFrame, components: int, scale: float) -> DataFrame:
    """``vec_id`` and ``v``, the components as whole numbers floor(scale * x), of every well-formed row."""
    x = F.col("embedding")
    scaled = vectors.select("vec_id", F.when(F.size(x) == components, F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))).alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    # Doubles of 2^53 and more are whole, and beyond what floor returns as a long.
    whole = F.transform("v", lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return scaled.where(F.col("v").isNotNull() & fine).select("vec_id", whole.alias("v"))


def _matrix(lists: pa.Array, components: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest digests of seed and id, in that order; equal digests by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()
    return [[int(c) for c in r["v"]] for r in found]


def exact(v: np.ndarray) -> bool:
    """Whether doubles hold every sum that squared differences of such vectors are made of."""
    return not v.size or np.abs(v).max() <= math.isqrt((1 << 51) // v.shape[1])


def squared_distances(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, vectors x centroids: as int64 where doubles are exact, else as Python integers."""
    c = np.array(centroids, np.float64)
    if exact(v) and exact(c):
        return (((v * v).sum(1)[:, None] - 2.0 * (v @ c.T)) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(centroids)), object)
    whole = [[int(x) for x in row] for row in v.tolist()]
    for i, row in enumerate(whole):
        out[i] = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
    return out


def assign(v: np.ndarray, centroids: list[list[int]], drift: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), squared distance to it, and the drift at which that may change."""
    d = squared_distances(v, centroids)
    cluster = d.argmin(1)
    own = d[np.arange(len(d)), cluster]
    if d.dtype == object:
        return cluster, own, np.full(len(d), -math.inf)
    if len(centroids) == 1:
        return cluster, own, np.full(len(d), math.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    nearest = np.sqrt(own.astype(np.float64))
    at = np.array(drift)[cluster]
    return cluster, own, at + (second - nearest) - SLACK * (second + nearest + at)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value as numbers of 32 bits and a sign by powers of 2^32: longs hold the sums of a billion tasks."""
    place = 0
    while not -(1 << 32) <= value < 1 << 32:
        yield place, value & 0xFFFFFFFF
        value >>= 32
        place += 1
    yield place, value


def _column_sums(v: np.ndarray) -> list[int]:
    if exact(v):
        return v.astype(np.int64).sum(0).tolist()
    return [sum(int(x) for x in column) for column in v.T.tolist()]


class Clustering:
    """Centroids, their exact sums and counts, and each cluster's accumulated drift: all that the driver keeps."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.sums = [[0] * len(c) for c in centroids]
        self.counts = [0] * len(centroids)
        self.drift = [0.0] * len(centroids)

    def move(self, changes: DataFrame) -> None:
        """Add the summed changes, replace every non-empty centroid by its mean, and accumulate the drift."""
        for r in changes.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():
            value = r["value"] << (32 * r["limb"])
            if r["component"] < 0:
                self.counts[r["cluster"]] += value
            else:
                self.sums[r["cluster"]][r["component"]] += value
        new = [[s // n for s in sums] if n else c for c, sums, n in zip(self.centroids, self.sums, self.counts)]
        far = []
        for a, b in zip(self.centroids, new):
            squared = sum((x - y) ** 2 for x, y in zip(a, b))
            far.append(math.sqrt(squared) * (1 + SLACK) if squared < 1 << 1000 else math.inf)
        self.centroids = new
        self.drift = [d + far[i] + max((f for j, f in enumerate(far) if j != i), default=0.0) for i, d in enumerate(self.drift)]


def _expired(drift: list[float]) -> Column:
    """Rows whose cluster's drift has passed them, in a form that reaches the Parquet reader."""
    test = F.lit(False)
    for c, d in enumerate(drift):
        test = test | ((F.col("cluster") == c) & (F.col("expires") < F.lit(d)))
    return test


def _alive(drift: list[float]) -> Column:
    test = F.lit(False)
    for c, d in enumerate(drift):
        test = test | ((F.col("cluster") == c) & (F.col("expires") >= F.lit(d)))
    return test


def _rescan(rows: DataFrame, state: Clustering, components: int) -> DataFrame:
    """``vec_id, v, was, cluster, expires`` after a look at all centroids; ``was`` is the cluster before, or NULL."""
    centroids, drift = state.centroids, state.drift
    kind = rows.schema["vec_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                cluster, _, expires = assign(_matrix(b.column("v"), components), centroids, drift)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("was"), pa.array(cluster, pa.int32()), pa.array(expires)],
                                                 ["vec_id", "v", "was", "cluster", "expires"])

    return rows.mapInArrow(scan, f"vec_id {kind}, v array<double>, was int, cluster int, expires double")


def _changes(run: DataFrame, components: int) -> DataFrame:
    """What the run's vectors that changed cluster add to and take from sums (component 0 on) and counts (component -1)."""
    moved = run.where(F.col("was").isNull() | (F.col("was") != F.col("cluster"))).select("v", "was", "cluster")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            v = _matrix(b.column("v"), components)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = b.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]).tolist():
                    own = of == c
                    for i, s in enumerate([int(own.sum()), *_column_sums(v[own])], -1):
                        total[c, i] = total.get((c, i), 0) + sign * s
        rows = [(c, i, limb, value) for (c, i), s in total.items() if s for limb, value in _limbs(s)]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         ["cluster", "component", "limb", "value"])

    return moved.mapInArrow(add, "cluster int, component int, limb int, value long")


def fit(rows: DataFrame, clusters: int, rounds: int, seed: int, components: int) -> tuple[Clustering, list[DataFrame], list[float]]:
    """The clustering after ``rounds`` rounds, its runs, and the drift at the last look."""
    state = Clustering(first_centroids(rows, clusters, seed))
    runs: list[DataFrame] = []
    before = state.drift
    if not state.centroids:
        return state, runs, before
    for _ in range(rounds):
        popped = rows.withColumn("was", F.lit(None).cast("int")) if not runs else _live(runs, before).where(_expired(state.drift)).select(
            "vec_id", "v", F.col("cluster").alias("was"))
        run = materialize(_rescan(popped, state, components).sortWithinPartitions("cluster", "expires"), "centroid-run")
        runs.append(run)
        before = state.drift
        state.move(_changes(run, components))
    return state, runs, before


def _live(runs: list[DataFrame], drift: list[float]) -> DataFrame:
    """Each vector once: all of the last run, and of the earlier ones what had not expired at ``drift``, when the last was made."""
    out = runs[-1]
    for run in runs[:-1]:
        out = out.unionByName(run.where(_alive(drift)))
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1, components: int = 64, scale: float = 64.0) -> DataFrame:
    """One row per well-formed vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = scaled_vectors(vectors, components, scale)
    state, runs, before = fit(rows, clusters, rounds, seed, components)
    if not state.centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, drift = state.centroids, state.drift
    live = _live(runs, before) if runs else rows.withColumns({"cluster": F.lit(0), "expires": F.lit(-1.0)})

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = _matrix(b.column("v"), components)
                cluster = b.column("cluster").to_numpy(zero_copy_only=False).copy()
                expired = b.column("expires").to_numpy(zero_copy_only=False) < np.array(drift)[cluster]
                distance = np.zeros(len(v), object)
                if expired.any():
                    cluster[expired], distance[expired], _ = assign(v[expired], centroids, drift)
                for c in np.unique(cluster[~expired]).tolist():
                    own = ~expired & (cluster == c)
                    distance[own] = squared_distances(v[own], [centroids[c]])[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([min(int(d), LONGEST) for d in distance], pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    out = materialize(live.select("vec_id", "v", "cluster", "expires").mapInArrow(last_look, f"vec_id {kind}, cluster int, distance long"), "centroid-rows")
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    known = [(min(sums.get(c, 0), LONGEST), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    by_cluster = lambda i, kind: F.element_at(F.array(*(F.lit(k[i]).cast(kind) for k in known)), F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", by_cluster(0, "long").alias("cluster_inertia"),
                      F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"), by_cluster(1, "string").alias("centroid_sha256"))
