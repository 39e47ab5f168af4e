"""What the two integer Lloyd operators share: vectors as integers, exact distances, and centres from exact sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers stay below this, so that distances and products of 64 components are exact in doubles and in longs.
LIMIT = 1 << 23
#: Differences that are held at once when pairs of vectors and centres are compared.
PAIRS = 1 << 21


def integers(column: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have dims components, none null or non-finite, and floor(scale * x) of those."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = np.zeros(len(column), bool)
    rows = np.zeros((0, dims))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dims)
    if len(right):
        flat = column.take(pa.array(right)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null components come as NaN
        fine = np.isfinite(x).all(1)
        whole[right[fine]] = True
        rows = np.floor(scale * x[fine])
        if len(rows) and np.abs(rows).max() >= LIMIT:
            raise ArithmeticError(f"a component beyond {LIMIT // scale} leaves the range of exact distances")
    return whole, rows.astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of integers below LIMIT as bytes."""
    return pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def integer_rows(vectors: DataFrame, embedding: str, scale: int, dims: int, others: dict[str, str]) -> DataFrame:
    """The kept vectors as bytes x, with the columns that others names (new name: old name)."""
    kinds = [f"{new} {vectors.schema[old].dataType.simpleString()}" for new, old in others.items()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, x = integers(b.column(0), scale, dims)
            kept = b.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([packed(x), *kept.columns[1:]], ["x", *others])

    return vectors.select(F.col(embedding), *[F.col(old).alias(new) for new, old in others.items()]).mapInArrow(read, ", ".join(["x binary", *kinds]))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every x to every c, exact: all terms are integers below 2^53."""
    a, b = x.astype(np.float64), c.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def squared_pairs(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of x[i] to c[j], exact."""
    step = max(1, PAIRS // max(1, x.shape[1]))
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), step):
        d = x[i[lo : lo + step]] - c[j[lo : lo + step]]
        out[lo : lo + step] = np.einsum("ij,ij->i", d, d)
    return out


def up(x: np.ndarray) -> np.ndarray:
    """Square roots, no smaller than the true ones."""
    return np.nextafter(np.sqrt(x.astype(np.float64)), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    """Square roots, no larger than the true ones, and at least 0."""
    return np.maximum(np.nextafter(np.sqrt(x.astype(np.float64)), -np.inf), 0)


def centre_sums(rows: DataFrame, groups: Sequence[int], dims: int, assign: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(group, centre): (members, componentwise sums), over all rows.

    assign gives, for each group of a batch, every row's centre and its integers. A task adds up its own rows first and writes
    a row a centre, Spark adds those; the driver gets one row a centre.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for g, (label, x) in enumerate(assign(b) if b.num_rows else []):
                if g not in sums:
                    sums[g], counts[g] = np.zeros((groups[g], x.shape[1]), np.int64), np.zeros(groups[g], np.int64)
                order = np.argsort(label, kind="stable")
                begin = np.flatnonzero(np.diff(label[order], prepend=-1))
                sums[g][label[order[begin]]] += np.add.reduceat(x[order], begin, axis=0)
                counts[g] += np.bincount(label, minlength=groups[g])
        for g, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), g)), pa.array(used), pa.array(n[used]), pa.array(sums[g][used].tolist(), pa.list_(pa.int64()))], ["g", "c", "n", "s"])

    part = rows.mapInArrow(added, "g long, c long, n long, s array<long>")
    total = part.groupBy("g", "c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    return {(r.g, r.c): (r.n, list(r[3:])) for r in total.collect()}


def moved(centres: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]], group: int) -> np.ndarray:
    """Each centre at the componentwise floor(sum / count) of its members; one without members stays."""
    out = centres.copy()
    for c in range(len(out)):
        if (group, c) in sums:
            n, s = sums[group, c]
            out[c] = [v // n for v in s]
    return out


def joined_digits(values: np.ndarray) -> str:
    return ",".join(map(str, np.asarray(values).ravel().tolist()))
