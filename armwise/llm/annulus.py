"""Centroid clustering by annulus search over integer vectors.

Centroids are sorted by norm. A vector's distance to one centroid, the one nearest to it in norm, bounds the distance to its
nearest; by the triangle inequality only centroids whose norm differs from the vector's by no more than that bound can be as
near. Two binary searches find them, and they alone are compared, in exact integers, ties at the boundary included. A round
is one pass over the vectors, which adds up its rows where they lie; nothing but sums of clusters leaves the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import lloyd
from armwise.llm.common import dropped, written

#: Vectors that are compared at once, and by how much an annulus is widened for what rounding may lose.
SLICE, SLACK = 4096, 1e-9


@dataclass(frozen=True)
class Rings:
    """Centroids in order of norm; number: their own numbers."""

    centroids: np.ndarray
    norms: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Rings:
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        order = np.argsort(norms, kind="stable")
        return cls(centroids[order], norms[order], order)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (end exclusive) of each vector's annulus."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        k = np.searchsorted(self.norms, norm)
        below, above = np.maximum(k - 1, 0), np.minimum(k, len(self.norms) - 1)
        guess = np.where(np.abs(self.norms[below] - norm) <= np.abs(self.norms[above] - norm), below, above)
        bound = lloyd.up(lloyd.squared_pairs(x, self.centroids, np.arange(len(x)), guess))
        wide = bound + SLACK * (1 + norm + bound)
        return np.searchsorted(self.norms, norm - wide, "left"), np.searchsorted(self.norms, norm + wide, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, the smallest number of equals, and its squared distance."""
        label, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), SLICE):
            some = x[lo : lo + SLICE]
            first, last = self.candidates(some)
            sizes = last - first
            row = np.repeat(np.arange(len(some)), sizes)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(row)) - begin[row] + first[row]
            distance = lloyd.squared_pairs(some, self.centroids, row, place)
            least = np.minimum.reduceat(distance, begin)
            best[lo : lo + SLICE] = least
            label[lo : lo + SLICE] = np.minimum.reduceat(np.where(distance == least[row], self.number[place], len(self.number)), begin)
        return label, best


def starting(rows: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of seed:key, ascending; equal hashes by the vector's bytes, null keys last."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([np.frombuffer(r.x, np.int32) for r in first], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for every kept vector.

    The driver holds the k centroids and, a round, k sums.
    Defined cases: vectors that are null, of another length than dims or with null or non-finite components are left out, and
    components whose integer is not below 2^23 in size raise; null keys come last among the starting vectors and stay null;
    repeated rows count as often as they occur; with fewer than k kept vectors there are as many centroids; equal centroids
    keep their numbers, and the smaller one takes the vectors; an empty table gives an empty one; other columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = written(lloyd.integer_rows(vectors, embedding, scale, dims, {"key": key}), "integers")
    centroids = starting(rows, k, seed, dims)
    if not len(centroids):
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        rings = Rings.of(centroids)

        def assign(b: pa.RecordBatch, rings: Rings = rings) -> list[tuple[np.ndarray, np.ndarray]]:
            x = lloyd.unpacked(b.column(0), dims)
            return [(rings.nearest(x)[0], x)]

        after = lloyd.moved(centroids, lloyd.centre_sums(rows.select("x"), [len(centroids)], dims, assign), 0)
        if (after == centroids).all():  # the rounds that are left would change nothing
            break
        centroids = after
    rings = Rings.of(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, distance = rings.nearest(lloyd.unpacked(b.column(0), dims))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(label.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    done = written(rows.select("x", "key").mapInArrow(placed, f"`{key}` {kind}, cluster int, distance long"), "clusters")
    dropped(rows)
    per = {r.cluster: r.d for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    named = [(c, per.get(c, 0), sum(per.values()), hashlib.sha256(lloyd.joined_digits(x).encode()).hexdigest()) for c, x in enumerate(centroids)]
    totals = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(totals), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """DuckDB SQL for cluster() over the table embeddings."""
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS p, unnest(v) AS x FROM kept)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, vec_id FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, p, x AS y FROM s JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (p) GROUP BY ALL) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, p, sum(x)::BIGINT AS t, count(*) AS n FROM x JOIN d{r} USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.p, CASE WHEN n IS NULL THEN y ELSE (t - ((t % n) + n) % n) // n END AS y FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c AND o.p = m.p)")
    steps.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    last = f"SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM d{rounds} JOIN h USING (c)"
    return "WITH " + ", ".join(steps) + " " + last
