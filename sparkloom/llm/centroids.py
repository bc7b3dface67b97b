"""Centroid clustering of integer vectors with a LAESA pivot table.

1. Every vector's squared distances to PIVOTS fixed vectors are worked out once
   and written beside its components.
2. In each round the centroids' distances to the same pivots are known too. By the
   triangle inequality the difference of both distances to a pivot never exceeds
   the distance of vector and centroid, so the largest difference over the pivots
   is a lower bound. Centroids are visited by rising bound; those whose bound is
   above the least exact distance so far are passed over, the others get their
   exact integer distance. Bounds are lowered by more than what double arithmetic
   can be off, so none that could win, or tie, is passed over.
3. A task sends one sum for each centroid and component. Spark adds them up, and
   the driver divides k * size numbers; no vector reaches it but the first k and
   the pivots, which come from the POOL vectors of smallest hash.

The result does not depend on the pivots, only its cost does. Pivots are taken
from the pool one by one, each the farthest in sum from those before.

Defined results: a vector that is null, has another number of components, or a
null or non-finite one, is left out. A component is floor(scale * x); beyond
+-2**62 it counts as +-2**62. Distances and their sums are exact while they fit
into a long, and 2**63 - 1 where they do not. Repeated rows are vectors of their
own. A vector without id is clustered, but is no start. With fewer than k vectors
there are as many centroids as starts; without any start there are no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Pivots of the table, and the vectors of smallest hash among which they are sought.
PIVOTS, POOL = 12, 256
#: Components up to this size have squared distances that fit into 64 bits.
SMALL = 1 << 27
LARGEST, CLAMP = (1 << 63) - 1, 1 << 62


class Table(NamedTuple):
    """The written vectors (id, parts, and to_pivots or null), first centroids, pivots."""

    rows: DataFrame
    starts: list[list[int]]
    pivots: list[list[int]]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and the rows of c, exactly, pair by pair."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) >= SMALL
    d = x.astype(object) - c.astype(object) if big else x - c
    out = (d * d).sum(axis=1)
    return np.minimum(out, LARGEST).astype(np.int64) if big else out


def _parts(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def pivot_table(df: DataFrame, vec_id: str, vector: str, size: int, scale: float, salt: str, k: int, pivots: int) -> Table:
    """Integer vectors written with their distances to the pivots."""
    x = F.col(vector)
    kept = df.where(
        x.isNotNull() & (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    )
    limit = float(CLAMP)
    part = lambda v: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), v.cast("double") * F.lit(float(scale))))).cast("long")
    ints = kept.select(F.col(vec_id).alias("id"), F.transform(x, part).alias("parts"))
    hashed = ints.where("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "parts")
    pool = [list(r["parts"]) for r in hashed.orderBy("h", "parts").limit(max(POOL, k)).collect()]
    chosen = _spread(pool, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(chosen, dtype=np.int64).reshape(-1, size)
        for batch in batches:
            parts = _parts(batch, size)
            to = [distances(parts, p[None, :]) for p in at]
            flat = pa.array(np.stack(to, axis=1).ravel() if to else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * len(at)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "parts", "to_pivots"])

    kind = df.schema[vec_id].dataType.simpleString()
    return Table(stored(ints.mapInArrow(measure, f"id {kind}, parts array<long>, to_pivots array<long>")), pool[:k], chosen)


def _spread(pool: list[list[int]], most: int) -> list[list[int]]:
    """Up to ``most`` different vectors, each the farthest in sum from those before."""
    distinct = [list(p) for p in dict.fromkeys(map(tuple, pool))]
    if not distinct:
        return []
    points = np.array(distinct, dtype=np.float64)
    chosen, total = [0], np.zeros(len(points))
    while len(chosen) < min(most, len(points)):
        total += np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return [distinct[i] for i in chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (ties: the
    smaller number), and how many exact distances were needed."""
    n, k = len(parts), len(centroids)
    own = np.sqrt(to_pivots.astype(np.float64))
    bound = np.zeros((n, k))
    for c in range(k):
        # a distance that does not fit into a long bounds nothing
        far = np.array([distances(centroids[c][None, :], p[None, :])[0] for p in pivots])
        usable = (to_pivots < LARGEST) & (far < LARGEST)[None, :]
        other = np.sqrt(far.astype(np.float64))[None, :]
        least = np.abs(own - other) - 1e-9 * (own + other + 1)
        bound[:, c] = np.where(usable, least, 0).max(axis=1, initial=0)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, LARGEST, dtype=np.int64)
    number = np.full(n, k, dtype=np.int64)
    needed = 0
    for place in range(k):
        c = order[:, place]
        left = np.flatnonzero(bound[np.arange(n), c] <= np.sqrt(best.astype(np.float64)) * (1 + 1e-12))
        if not len(left):
            break  # bounds rise: no row has a centroid left
        needed += len(left)
        d = distances(parts[left], centroids[c[left]])
        better = (d < best[left]) | ((d == best[left]) & (c[left] < number[left]))
        best[left[better]], number[left[better]] = d[better], c[left[better]]
    return number, best, needed


def _assigned(batch: pa.RecordBatch, size: int, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = _parts(batch, size)
    to = batch.column("to_pivots").flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1)
    number, best, _ = nearest(parts, to, centroids, pivots)
    return parts, number, best


def _sums(table: Table, size: int, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty centroid: its vectors' number and componentwise sums."""
    fixed = table.pivots

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = (np.array(v, dtype=np.int64).reshape(-1, size) for v in (centroids, fixed))
        n, sums = np.zeros(len(at), dtype=np.int64), np.zeros((len(at), size), dtype=object)
        for batch in batches:
            parts, number, _ = _assigned(batch, size, at, pivots)
            wide = parts.astype(object) if np.abs(parts).max(initial=0) >= SMALL else parts
            for c in np.unique(number):
                inside = number == c
                n[c] += int(inside.sum())
                sums[c] += wide[inside].sum(axis=0).astype(object)
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, c)), pa.array(np.arange(size)), pa.array(np.full(size, n[c])),
                    pa.array([Decimal(int(v)) for v in sums[c]], pa.decimal128(38, 0)),
                ], ["cluster", "part", "n", "total"],
            )

    rows = table.rows.mapInArrow(partial, "cluster long, part long, n long, total decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "part").collect():
        found.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return found


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: float = SCALE,
    k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, salt: str = "3:",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector, and the final centroids."""
    held = pivot_table(df, vec_id, vector, size, scale, salt, k, pivots)
    centroids, fixed = held.starts, held.pivots
    kind = df.schema[vec_id].dataType.simpleString()
    schema = f"`{vec_id}` {kind}, cluster int, distance long"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        new = list(centroids)
        for c, (n, totals) in _sums(held, size, centroids).items():
            new[c] = [t // n for t in totals]
        if new == centroids:
            break  # assignment depends on the centroids alone: nothing will change
        centroids = new

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots_at = (np.array(v, dtype=np.int64).reshape(-1, size) for v in (centroids, fixed))
        for batch in batches:
            _, number, best = _assigned(batch, size, at, pivots_at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], [vec_id, "cluster", "distance"])

    return held.rows.mapInArrow(last, schema), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distance) and centroid_sha256."""
    assigned = stored(assigned)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total).collect()}
    # one row for each of the k centroids, which the driver holds anyhow
    own = [(c, min(n, LARGEST), min(sum(sums.values()), LARGEST), centroid_digest(centroids[c])) for c, n in sorted(sums.items())]
    described = assigned.sparkSession.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(described), "cluster").select(assigned.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))


def oracle(size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same result in SQL, without pivots: every vector against every centroid."""
    ctes = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
        FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p AS q FROM
        (SELECT sha256('3:' || vec_id) AS h, p FROM v WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT {k}))""",
    ]
    square = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (p[i] - q[i]) * (p[i] - q[i])))::BIGINT"
    for n in range(rounds + 1):
        ctes.append(
            f"""a{n} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, p, c, {square} AS d FROM v, c{n})
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if n < rounds:
            # exact floor of a quotient of integers, also of negative ones
            floored = "(s - ((s % m) + m) % m) // m"
            ctes.append(
                f"""s{n} AS (SELECT c, i, sum(p[i])::BIGINT AS s, count(*) AS m FROM a{n}, range(1, {size + 1}) AS g(i) GROUP BY c, i),
                c{n + 1} AS MATERIALIZED (SELECT c0.c, coalesce(f.q, c0.q) AS q FROM c{n} AS c0 LEFT JOIN
                (SELECT c, list({floored} ORDER BY i) AS q FROM s{n} GROUP BY c) AS f ON f.c = c0.c)"""
            )
    return f"""WITH {", ".join(ctes)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN c{rounds} AS z ON a.c = z.c"""
