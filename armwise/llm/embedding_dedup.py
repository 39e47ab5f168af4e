"""Near-duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists by pairs of pivots, of the five nearest, bring
together vectors that share two of them; of those, the ones that share enough of their ten nearest are verified by cosine in
double precision. A pair counts in the first list that both are on, so that no pair is counted twice and none is written out:
a list gives each vector's number of links and the edges that connect its components. Long lists are cut into parts whose
pairs are met in blocks. Vectors travel in the precision they are stored in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwise.llm.common import looked_up, written
from armwise.llm.graph import components
from armwise.llm.ngram_join import _grouped

#: Vectors that pivots are chosen among, fewest and most pivots, nearest pivots that lists and counts go by, pivots to share, vectors of a part.
SAMPLE, FEWEST, MOST, LISTED, COUNTED, SHARED, PART = 4096, 64, 4096, 5, 10, 4, 1500


def _units(column: pa.Array, kind: str) -> tuple[np.ndarray, list[bytes | None]]:
    """Each vector's length in numbers and its bytes, f4 or f8 as kind says; none where null, zero or with a null or non-finite number."""
    dims = np.zeros(len(column), np.int32)
    out: list[bytes | None] = []
    for i, x in enumerate(column):
        v = None
        if x.is_valid and x.values.null_count == 0 and len(x.values):
            a = x.values.to_numpy(zero_copy_only=False).astype(kind)
            if np.isfinite(a).all() and a.any():
                dims[i], v = len(a), a.tobytes()
        out.append(v)
    return dims, out


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: list[bytes], n: int, kind: str = "f8") -> np.ndarray:
    """n of the sample, each the farthest from those chosen before; the first is the first."""
    x = _unit(sample, kind)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


def describe(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The COUNTED nearest pivots of each unit vector in order (fewer where there are fewer pivots)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :COUNTED].astype(np.int16)


def list_keys(nearest: np.ndarray, dim: int) -> np.ndarray:
    """The inverted lists of each vector: unordered pairs of its LISTED nearest pivots, with its length."""
    top = np.sort(nearest[:, :LISTED].astype(np.int64), axis=1)
    if top.shape[1] < 2:
        return np.full((len(top), 1), dim << 32, np.int64)
    return np.stack([(dim << 32) + (top[:, a] << 16) + top[:, b] for a, b in combinations(range(top.shape[1]), 2)], 1)


def _block(members: list[tuple], least: float, cross: bool, kind: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each member (key, node, copies, vector, nearest, part), in order of node, and connecting edges to the smallest node, for one list or one pair of parts."""
    key = members[0][0]
    x = _unit([m[3] for m in members], kind)
    near = np.stack([np.frombuffer(m[4], np.int16) for m in members])
    copies = np.array([m[2] for m in members], np.int64)
    part = np.array([m[5] for m in members])
    has = np.zeros((len(members), int(near.max()) + 1), np.float32)
    np.put_along_axis(has, near.astype(np.int64), 1, 1)
    lists = list_keys(near, key >> 32)
    label = np.arange(len(members))
    links = np.zeros(len(members), np.int64)
    adjacent = []
    for lo in range(0, len(members), 512):
        hi = min(lo + 512, len(members))
        some = has[lo:hi] @ has.T >= min(SHARED, near.shape[1])
        if cross:
            some &= part[lo:hi, None] != part[None, :]
        some[np.arange(hi - lo), np.arange(lo, hi)] = False
        a, b = np.nonzero(some)
        a += lo
        close = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 20000]], x[b[i : i + 20000]]) >= least for i in range(0, len(a), 20000)]) if len(a) else np.zeros(0, bool)
        a, b = a[close], b[close]
        first = np.concatenate([_first_shared(lists[a[i : i + 20000]], lists[b[i : i + 20000]]) == key for i in range(0, len(a), 20000)]) if len(a) else np.zeros(0, bool)
        np.add.at(links, a[first], copies[b[first]])
        adjacent.append((a, b))
    a, b = (np.concatenate(z) for z in zip(*adjacent, strict=True))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    nodes = [m[1] for m in members]
    return links, [(nodes[i], nodes[j]) for i, j in enumerate(label.tolist()) if i != j]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(same, a, np.iinfo(np.int64).max).min(1)


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable) and kept for every row.

    Pivots: chosen among the SAMPLE vectors of the lowest hash of each length, about as many as the square root of the number of
    distinct vectors, between FEWEST (all, where there are fewer) and MOST. Every vector is indexed; equal vectors are indexed once and counted as often as they
    occur. Links found are exact; those near the bound can be missed, and recall is measured in the tests.
    Defined cases: null, empty and zero vectors and those with null or non-finite numbers link with nothing; vectors of
    different lengths do not link; a null key stays null; repeated rows and equal keys are rows like others; an empty table
    gives an empty one; other columns, labels among them, are not read.
    """
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "f8"  # what the numbers are stored in loses nothing

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, data = _units(b.column(2), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims), pa.array(data, pa.binary())], ["node", "key", "dim", "vector"])

    rows = vectors.select(F.monotonically_increasing_id().alias("node"), F.col(key).cast("long").alias("key"), F.col(embedding))
    rows = written(rows.mapInArrow(read, "node long, key long, dim int, vector binary"), "vectors")
    classes = rows.where("dim > 0").groupBy("dim", "vector").agg(F.min("node").alias("class"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("set", F.sha2("vector", 256)), "classes")
    links, edges = _search(spark, classes, least, kind)
    label = components(edges, "components").withColumnRenamed("node", "class")
    named = classes.select("set", "class", "least", "copies").join(label, "class", "left").join(links, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = written(looked_up(named, best, "component", "classes").select("set", "copies", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links")), "names")
    done = looked_up(rows.where("dim > 0").select("key", F.sha2("vector", 256).alias("set")), named, "set", "copies").select("key", "n_links", "component_id")
    alone = rows.where("dim = 0").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = done.unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def _search(spark: SparkSession, classes: DataFrame, least: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """(class, links) and edges (u, v) among distinct vectors."""
    pivots = {}
    for dim, n in classes.groupBy("dim").count().where(F.col("count") > 1).collect():  # a row a length; a single vector links with nothing
        sample = [bytes(r.vector) for r in classes.where(F.col("dim") == dim).orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()]
        pivots[dim] = choose_pivots(sample, int(min(MOST, max(FEWEST, n**0.5))), kind)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    data = own.column(3).to_pylist()
                    near = describe(_unit(data, kind), pivots[dim]) if dim in pivots else np.zeros((len(data), 1), np.int16)
                    keys = list_keys(near, dim)
                    place = np.repeat(np.arange(len(data)), keys.shape[1])
                    wide = own.take(pa.array(place))
                    text = pa.array([x.tobytes() for x in near], pa.binary()).take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), wide.column(0), wide.column(2), wide.column(3), text], ["list", "node", "copies", "vector", "nearest"])

    lists = classes.select(F.col("class").alias("node"), "dim", "copies", "vector").mapInArrow(listed, "list long, node long, copies long, vector binary, nearest binary")
    lists = written(lists, "lists")
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = looked_up(lists, sizes, "list", "n").withColumn("parts", F.ceil(F.col("n") / PART).cast("long"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).withColumn("block", F.xxhash64("list", "a", "b"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _grouped(batches, 0):
            members = sorted((m[1:] for m in members), key=lambda m: m[1])
            links, edges = _block(members, least, members[0][6] != members[0][7], kind)
            u = [m[1] for m, n in zip(members, links, strict=True) if n] + [e[0] for e in edges]
            v = [None for n in links if n] + [e[1] for e in edges]
            n = [int(n) for n in links if n] + [0] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("block", "list", "node", "copies", "vector", "nearest", "part", "a", "b").repartition(parts, "block").sortWithinPartitions("block")
    found = written(dealt.mapInArrow(verified, "u long, v long, n long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("links"))
    return links, found.where("v is not null").select("u", "v")
