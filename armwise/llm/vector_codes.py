"""Vector code compression: codebooks a part by Lloyd rounds that Elkan's bounds prune, and a byte a part for every vector.

Beside each vector lies what the last round learned: a part's entry, an upper bound of its distance and a lower bound for
every entry of the codebook. Entries move, and bounds move with them; an entry is compared only where the bounds and half its
distance to the own entry are not strictly beyond the upper bound, and then in exact integers, so that ties are seen. Upper
bounds are rounded up and lower bounds down, to a byte each in steps of their part's largest.
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
from armwise.llm.common import dropped, looked_up, written

#: Vectors whose bounds are unpacked at once.
SLICE = 2048
STATE = "x binary, entry binary, upper binary, step binary, lower binary, error long"


@dataclass
class Bounds:
    """Of some vectors' one part: entry, upper bound, lower bounds of all entries, exact squared distance to the entry."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    error: np.ndarray


@dataclass(frozen=True)
class Codebook:
    """Entries with what pruning needs: half the distances between them, rounded down, and by how much each moved, rounded up."""

    entries: np.ndarray
    half: np.ndarray
    movement: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Codebook:
        half = lloyd.down(lloyd.squared(entries, entries)) / 2
        np.fill_diagonal(half, np.inf)
        shift = np.zeros(len(entries)) if before is None else lloyd.up(((entries - before) ** 2).sum(1)) * ((entries != before).any(1))
        return cls(entries, half, shift)

    def first(self, x: np.ndarray) -> Bounds:
        """Every distance is computed once, and becomes a bound."""
        d = lloyd.squared(x, self.entries)
        entry = d.argmin(1)
        error = d[np.arange(len(x)), entry]
        return Bounds(entry, lloyd.up(error), lloyd.down(d), error)

    def again(self, x: np.ndarray, b: Bounds) -> tuple[Bounds, int]:
        """Bounds after this codebook's movement, and how many distances that took."""
        n = np.arange(len(x))
        upper = b.upper + self.movement[b.entry]
        upper = np.where(self.movement[b.entry] > 0, np.nextafter(upper, np.inf), upper)
        lower = np.maximum(np.nextafter(b.lower - self.movement, -np.inf), 0)
        entry = b.entry.copy()
        error = lloyd.squared_pairs(x, self.entries, n, entry)  # needed for the error in any case; it tightens every upper bound
        upper = np.minimum(upper, lloyd.up(error))
        lower[n, entry] = lloyd.down(error)
        open_rows = np.flatnonzero(self.half.min(1)[entry] <= upper) if len(self.entries) > 1 else n[:0]
        bound = upper[open_rows, None]
        row, j = np.nonzero((lower[open_rows] <= bound) & (self.half[entry[open_rows]] <= bound))
        row = open_rows[row]
        d = lloyd.squared_pairs(x, self.entries, row, j)
        lower[row, j] = lloyd.down(d)
        if len(row):
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            own = row[begin]
            least = np.minimum.reduceat(d, begin)
            seat = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(row))))
            rival = np.minimum.reduceat(np.where(d == least[seat], j, len(self.entries)), begin)
            wins = (least < error[own]) | ((least == error[own]) & (rival < entry[own]))
            entry[own[wins]], error[own[wins]] = rival[wins], least[wins]
            upper[own[wins]] = lloyd.up(least[wins])
        return Bounds(entry, upper, lower, error), len(x) + len(row)


def _small(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes and the step of each vector, so that step * byte is no larger than the bound."""
    step = np.nextafter((lower.max(1) / 255).astype(np.float32), np.float32(np.inf))
    return np.floor(lower / step[:, None]).clip(0, 255).astype(np.uint8), step


def _state(x: np.ndarray, parts: list[Bounds], others: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    lower, step = zip(*[_small(b.lower) for b in parts], strict=True)

    def rows(arrays: list[np.ndarray], kind: type) -> pa.Array:
        return pa.array([r.tobytes() for r in np.concatenate([np.ascontiguousarray(a, kind).reshape(len(x), -1) for a in arrays], 1)], pa.binary())

    columns = [lloyd.packed(x), rows([b.entry for b in parts], np.uint8), rows([b.upper for b in parts], np.float64), rows(list(step), np.float32), rows(list(lower), np.uint8), pa.array(sum(b.error for b in parts))]
    return pa.RecordBatch.from_arrays([*columns, *others], names)


def _bounds(b: pa.RecordBatch, sizes: list[int]) -> list[Bounds]:
    """The parts' bounds that a state holds."""
    m = len(sizes)
    entry = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, m).astype(np.int64)
    upper = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, m)
    step = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float32).reshape(-1, m).astype(np.float64)
    lower = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, sum(sizes))
    at = np.cumsum([0, *sizes])
    return [Bounds(entry[:, p], upper[:, p], lower[:, at[p] : at[p + 1]] * step[:, p : p + 1], np.zeros(len(entry), np.int64)) for p in range(m)]


def starting(rows: DataFrame, entries: int, dims: int) -> np.ndarray:
    """The vectors of the smallest keys, ascending; equal keys by the vector's bytes, null keys last."""
    first = rows.select("key", "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([np.frombuffer(r.x, np.int32) for r in first], np.int64).reshape(-1, dims)


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 for every kept vector.

    The driver holds the codebooks and, a round, a sum an entry. A round reads the state that the one before wrote, writes its
    own and removes that one; the lower bounds, parts * entries bytes a vector, are most of it.
    Defined cases: vectors that are null, of another length than dims or with null or non-finite components are left out, and
    components whose integer is not below 2^23 in size raise; null keys come last among the starting entries and stay null;
    repeated rows count as often as they occur; with fewer kept vectors than entries a codebook has as many entries; of equal
    entries the first takes the parts and the others stay unused; null labels are one label; an empty table gives an empty
    one; other columns are not read.
    """
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("parts must be equal and entries fit in a byte")
    kinds = {new: vectors.schema[old].dataType.simpleString() for new, old in (("key", key), ("label", label))}
    rows = written(lloyd.integer_rows(vectors, embedding, scale, dims, {"key": key, "label": label}), "integers")
    width = dims // parts
    start = starting(rows, entries, dims)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    if not len(start):
        return rows.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    sizes = [len(b) for b in books]
    names = [c.split()[0] for c in STATE.split(", ")] + ["key", "label"]
    schema = f"{STATE}, key {kinds['key']}, label {kinds['label']}"

    def stepped(state: DataFrame, codebooks: list[Codebook], begin: bool) -> DataFrame:
        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, SLICE):
                    b = whole.slice(lo, SLICE)
                    x = lloyd.unpacked(b.column(0), dims)
                    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
                    if begin:
                        found = [c.first(y) for c, y in zip(codebooks, cut, strict=True)]
                    else:
                        found = [c.again(y, old)[0] for c, y, old in zip(codebooks, cut, _bounds(b, sizes), strict=True)]
                    yield _state(x, found, b.columns[-2:], names)

        return state.mapInArrow(assigned, schema)

    def assign(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        x = lloyd.unpacked(b.column(0), dims)
        entry = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
        return [(entry[:, p], x[:, p * width : (p + 1) * width]) for p in range(parts)]

    state = written(stepped(rows, [Codebook.of(b) for b in books], True), "bounds")
    dropped(rows)
    for _ in range(rounds):
        sums = lloyd.centre_sums(state.select("x", "entry"), sizes, width, assign)
        after = [lloyd.moved(b, sums, p) for p, b in enumerate(books)]
        if all((a == b).all() for a, b in zip(after, books, strict=True)):  # the rounds that are left would change nothing
            break
        old, state = state, written(stepped(state, [Codebook.of(a, b) for a, b in zip(after, books, strict=True)], False), "bounds")
        dropped(old)
        books = after
    digest = hashlib.sha256(lloyd.joined_digits(np.concatenate([b.ravel() for b in books])).encode()).hexdigest()
    coded = state.select("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("of"), F.lower(F.hex("entry")).alias("code"), "error")
    coded = written(coded, "codes")
    dropped(state)
    per = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    done = looked_up(coded, per, "of", "n")
    return done.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: list[np.ndarray], key: str = "vec_id") -> DataFrame:
    """key and vector, the entries that each code names, put together; a null code gives null."""
    entries = [F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books]
    picked = [F.get(e, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p, e in enumerate(entries)]
    return codes.select(key, F.concat(*picked).alias("vector"))


def encode_sql(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024) -> str:
    """DuckDB SQL for encode() over the table embeddings."""
    w = dims // parts
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"l AS (SELECT vec_id, unnest(range({dims})) AS q, unnest(v) AS x FROM kept)",
        f"x AS MATERIALIZED (SELECT vec_id, q // {w} AS m, q % {w} AS p, x FROM l)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, vec_id FROM kept ORDER BY vec_id LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT m, c, p, x AS y FROM s JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, m, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, m, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (m, p) GROUP BY ALL) GROUP BY vec_id, m)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT m, c, p, sum(x)::BIGINT AS t, count(*) AS n FROM x JOIN d{r} USING (vec_id, m) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.m, o.c, o.p, CASE WHEN n IS NULL THEN y ELSE (t - ((t % n) + n) % n) // n END AS y FROM c{r} o LEFT JOIN m{r} u ON o.m = u.m AND o.c = u.c AND o.p = u.p)")
    steps.append(f"e AS (SELECT vec_id, string_agg(printf('%02x', c), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY vec_id)")
    last = f"SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY m, c, p)) FROM c{rounds}) AS codebooks_sha256 FROM e JOIN kept USING (vec_id)"
    return "WITH " + ", ".join(steps) + " " + last
