"""Clustering by heaps of expiring bounds against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quadrant.llm.centroids import _expired, _live, cluster_vectors, fit, scaled_vectors

TABLE = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], TABLE)


def lloyd(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:clusters]]
    look = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [look(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            if members := [v for (_, v), n in zip(kept, own) if n == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *look(v)) for i, v in kept]
    inertia = [sum(d for _, d, n in found if n == c) for c in range(len(centroids))]
    return [(i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found]


def vectors(seed, n, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [m + rng.gauss(0, spread) for m in middles[i % 9]]) for i in range(n)]


@pytest.mark.parametrize("seed, n, spread", [(1, 400, 0.2), (2, 300, 1.0), (3, 200, 5.0), (4, 20, 1.0), (5, 5, 1.0)])
def test_equals_plain_rounds(spark, seed, n, spread):
    rows = vectors(seed, n, spread)
    assert sorted(map(tuple, cluster_vectors(table(spark, rows)).collect())) == sorted(lloyd(rows))


def test_more_rounds_pop_few_vectors(spark):
    rows = vectors(7, 600, 0.05)
    state, runs, before = fit(scaled_vectors(table(spark, rows), 64, 64.0), 16, 6, 1, 64)
    sizes = [r.count() for r in runs]
    assert sizes[0] == 600 and sum(sizes[1:]) < 5 * 600 and sizes[-1] < 300
    live = _live(runs, before)
    assert live.count() == 600 == live.select("vec_id").distinct().count()  # each vector in exactly one heap
    assert sorted(map(tuple, cluster_vectors(table(spark, rows), rounds=6).collect())) == sorted(lloyd(rows, rounds=6))
    plan = live.where(_expired(state.drift))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "LessThan(expires" in plan


def test_ties_repeats_and_rows_left_out(spark):
    rng = random.Random(3)
    same = [0.5] * 64
    rows = [(i, same) for i in range(150)] + [(200 + i, [rng.choice([0.0, 1 / 64]) for _ in range(64)]) for i in range(80)]
    rows += [(None, same), (None, [0.25] * 64), (2**53 + 1, [-0.001] * 64), (5, same), (5, same)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] + [1.0] * 63)]
    key = lambda r: repr(r)
    assert sorted(map(tuple, cluster_vectors(table(spark, rows)).collect()), key=key) == sorted(lloyd(rows), key=key)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = vectors(8, 120) + [(1000 + i, [rng.uniform(-1, 1) * 10.0**6 for _ in range(64)]) for i in range(20)]
    assert sorted(map(tuple, cluster_vectors(table(spark, rows)).collect())) == sorted(lloyd(rows))
    huge = rows + [(2000 + i, [rng.uniform(-1, 1) * 10.0**30 for _ in range(64)]) for i in range(5)]
    longest = 2**63 - 1
    want = [(i, n, min(d, longest), min(own, longest), min(every, longest), digest) for i, n, d, own, every, digest in lloyd(huge)]
    assert sorted(map(tuple, cluster_vectors(table(spark, huge)).collect())) == sorted(want)


def test_empty_and_other_columns(spark):
    assert cluster_vectors(table(spark, [])).count() == 0 and cluster_vectors(table(spark, [(1, [1.0])])).count() == 0
    rows = vectors(9, 30)
    odd = table(spark, rows).withColumns({c: F.lit("x") for c in ("cluster", "expires", "v", "was", "distance")})
    got = cluster_vectors(odd)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(lloyd(rows))
