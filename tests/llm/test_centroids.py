"""Centroid clustering against plain k-means on Python integers."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import centroids as C


def plain(vectors, size, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in ordered[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        own = [min((square(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for n in range(len(cents)):
                if members := [v for (_, v), (_, m) in zip(kept, own) if m == n]:
                    cents[n] = [sum(x) // len(members) for x in zip(*members)]
    inside = [0] * len(cents)
    for d, n in own:
        inside[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, inside[n], sum(inside), digest[n]) for (i, _), (d, n) in zip(kept, own)), key=str)


def frame(spark, vectors, kind="float"):
    rows = [(i, v, "x", "y", "z") for i, v in vectors]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, parts string, id string").repartition(3)


def test_against_plain_clustering(spark):
    rng = random.Random(1)
    odd = [None, [], [1.0] * 5, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [None] + [0.0] * 5]
    vectors = [(i, [np.float32(rng.gauss(i % 9, 0.5)).item() for _ in range(6)]) for i in range(150)]
    vectors += [(None, [0.5] * 6), (3, [0.25] * 6), (4, vectors[4][1]), (5, [-0.0] * 6)] + [(200 + i, v) for i, v in enumerate(odd)]
    for k, rounds in ((8, 10), (3, 1), (400, 2)):
        got = C.with_inertia(*C.cluster_vectors(frame(spark, vectors), size=6, k=k, rounds=rounds))
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(vectors, 6, k, rounds)


def test_large_components_stay_exact(spark):
    vectors = [(i, [1e5 * i, -1e6 * (i % 3), 2.0**20]) for i in range(12)]
    got = C.with_inertia(*C.cluster_vectors(frame(spark, vectors, "double"), size=3, k=4))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(vectors, 3, 4)
    huge = [(i, [1e30 * i, 0.0]) for i in range(6)]
    rows = C.with_inertia(*C.cluster_vectors(frame(spark, huge, "double"), size=2, k=2)).collect()
    assert len(rows) == 6 and max(r["distance"] for r in rows) <= C.LARGEST


def test_pivots_change_nothing_and_save_distances():
    rng = np.random.default_rng(3)
    middles = rng.integers(-3000, 3000, (8, 64))
    parts = (middles[rng.integers(0, 8, 2000)] + rng.integers(-200, 200, (2000, 64))).astype(np.int64)
    cents, pivots = middles.astype(np.int64), np.array(C._spread(parts[:200].tolist(), 12))
    to = np.stack([C.distances(parts, p[None, :]) for p in pivots], axis=1)
    number, best, needed = C.nearest(parts, to, cents, pivots)
    d = ((parts[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and needed < 2000 * 4
    number, best, needed = C.nearest(parts, to[:, :0], cents, pivots[:0])
    assert (number == d.argmin(axis=1)).all() and needed == 2000 * 8


def test_no_vectors(spark):
    for vectors in ([], [(1, None)], [(None, [1.0] * 6)]):
        assert C.with_inertia(*C.cluster_vectors(frame(spark, vectors), size=6)).count() == 0


def test_extra_columns_with_names_of_ours(spark, small):
    docs = spark.read.parquet(f"{small}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("id", "h", "distance", "to_pivots")})
    rows, cents = C.cluster_vectors(docs, rounds=2)
    assert rows.count() == docs.count() and len(cents) == 8
