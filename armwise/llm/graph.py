"""Connected components of an edge table: edges are contracted where their larger node is dealt to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm.common import written

#: Edges that a task contracts at once; parents of parents that are broadcast at most (16 bytes each).
CHUNK, BROADCAST_ROWS = 1_000_000, 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: each node that is not the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def chunks(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[list[np.ndarray]]:
    """The columns of a sorted partition in arrays of about CHUNK rows; whole: rows of one first value stay together."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
        if size < CHUNK:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if whole else size
        if cut:
            yield [c[:cut] for c in columns]
        held, size = ([[c[cut:] for c in columns]], size - cut) if cut < size else ([], 0)
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges whose larger node u was dealt here; own: this is the only row of its u, which has no other parent."""
    for mine, v in chunks(batches, whole=True):
        a, b = stars(mine, v)
        at = np.minimum(np.searchsorted(mine, a), len(mine) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(mine[at] == a)], ["u", "v", "own"])


def forest(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node and component, the smallest node reachable, for every node of edges (u, v) that is not itself the smallest.

    edges are longs, in either direction; a task that makes them should contract them to stars first. A step deals each edge
    to its larger node, which then has a row a task at most, and contracts what meets there: every node gets one parent of its
    own, and parents that met get edges. Then an edge to a parent that has a parent moves up to it. Rows are never dealt by a parent, of which there can be a third
    of all, but for a join against unique parents, broadcast while they are few, that adaptive execution can split. Steps end
    when no parents met and none has a parent. Every step is written.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        dealt = now.repartition(parts, "u").sortWithinPartitions("u")
        step = written(dealt.mapInArrow(_owned, "u long, v long, own boolean"), name)
        parent = step.where("own").select(F.col("u").alias("x"), F.col("v").alias("up"))
        higher = written(step.select(F.col("v").alias("x")).distinct().join(parent, "x"), name)
        n = higher.count()
        if not n and not step.where("not own").limit(1).count():
            return step.select(F.col("u").alias("node"), F.col("v").alias("component"))
        side = F.broadcast(higher) if n <= BROADCAST_ROWS else higher
        now = step.join(side, F.col("v") == F.col("x"), "left").select("u", F.coalesce("up", "v").alias("v"))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node and component, the smallest node reachable, for every node of edges (u, v): see forest."""
    below = forest(edges, name)
    return below.unionByName(below.select(F.col("component").alias("node"), "component").distinct())
