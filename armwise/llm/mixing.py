"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of it a multiplicity: a whole part, and a fraction that is an inclusion
probability. The flight moves three fractional documents at a time along the null space of the two balancing constraints,
words and documents, until one is in or out; the totals never change. It runs within parts of a source, and again over what
the parts left, two documents each at most, until a source has no more than PART of them. The landing takes those with a
reserve of some 64 documents a source, longest first, and keeps the words alone: two documents move at a time, short ones pay
for long ones, the last one is rounded, and what that costs is made good by turning documents of the landing, from long to
short, wherever it brings the words nearer to their total. That turning is greedy and outside the martingale: inclusion
probabilities of the landing's documents, PART + 64 or so a source at most, are met in their words, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm.common import looked_up, n_words, ranked, text_of, written

#: Documents of a source that one part holds on average, that its landing has in reserve; sources that are broadcast at most.
PART, RESERVE, BROADCAST_ROWS = 4_000, 64, 100_000


def targets(sizes: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, n, target for a table of source and size.

    Sources in code-point order, null last, have the weights in turn and share `share` times all sizes; a target stops at
    `most` times its source's size, and the excess is shared again by weight until none is above. The level that one unit of
    weight gets is found by repeated sums over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    named = ranked(per.where(F.col("source").isNotNull()), ["source"], "sources", out="_place")
    at_end = named.count()
    per = named.unionByName(per.where(F.col("source").isNull()).withColumn("_place", F.lit(at_end).cast("long")))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = written(per.withColumn("_weight", F.get(turn, (F.col("_place") % len(weights)).cast("int"))), "weights")
    cap = most * F.col("source_size")
    every, all_weights = per.agg(F.sum("source_size"), F.sum("_weight")).first()
    total = share * (every or 0)
    level = total / all_weights if all_weights else 0.0
    while True:
        above = F.col("_weight") * level >= cap
        capped, free = per.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("_weight")))).first()
        if not free:
            break
        new = (total - (capped or 0.0)) / free
        if new <= level * (1 + 1e-15):
            break
        level = new
    return per.withColumn("target", F.least(F.col("_weight") * level, cap.cast("double"))).drop("_place", "_weight")


def _chance(seed: int, step: int) -> float:
    """A number in [0, 1) from two integers: splitmix."""
    z = (seed * 0x9E3779B97F4A7C15 + (step + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


class Flight:
    """Holds fractional documents, as [probability, size, seed, row], of one source: two at most, or with words alone kept, one."""

    def __init__(self, both: bool) -> None:
        self.both = both
        self.open: list[list] = []
        self.steps = 0

    def add(self, unit: list) -> list[list]:
        """Takes a document; gives those that are now in (1.0) or out (0.0)."""
        if not 0.0 < unit[0] < 1.0:
            return [unit]
        self.open.append(unit)
        done = []
        while len(self.open) > 1 + self.both:
            self._move()
            done += [u for u in self.open if not 0.0 < u[0] < 1.0]
            self.open = [u for u in self.open if 0.0 < u[0] < 1.0]
        return done

    def _way(self) -> list[int]:
        """A vector of the constraints' null space."""
        if self.both:
            a, b, c = (u[1] for u in self.open)
            way = [b - c, c - a, a - b]
            return way if any(way) else [1, -1, 0]
        a, b = (u[1] for u in self.open)
        return [b, -a] if a or b else [1, -1]

    def _move(self) -> None:
        way = self._way()
        up, down = [], []
        seed = 0
        for u, w in zip(self.open, way, strict=True):
            p = u[0]
            seed = seed * 3 ^ u[2]
            if w:
                up.append((1 - p) / w if w > 0 else -p / w)
                down.append(p / w if w > 0 else (p - 1) / w)
        most, least = min(up), min(down)
        self.steps += 1
        step = most if _chance(seed, self.steps) * (most + least) < least else -least
        for u, w in zip(self.open, way, strict=True):
            p = u[0] + step * w
            u[0] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p



def landed(units: list[list]) -> list[list]:
    """One source's landing: each probability becomes 0 or 1, and the words come near to their expectation."""
    total = sum(u[0] * u[1] for u in units)
    flight = Flight(both=False)
    done = [x for u in units for x in flight.add(u)]
    for u in flight.open:
        u[0] = float(u[0] >= 0.5)
    done += flight.open
    over = sum(u[0] * u[1] for u in done) - total
    for u in sorted(done, key=lambda u: (-u[1], u[2])):
        change = -u[1] if u[0] else u[1]
        if abs(over + change) < abs(over):
            u[0] = 1.0 - u[0]
            over += change
    return done


def _flown(rows: DataFrame, parts: Sequence[Column], landing: bool) -> DataFrame:
    """rows with p moved: each (source, part) of a sorted partition is one flight, long documents first, so that short ones land."""
    schema = rows.schema
    names = schema.names
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *parts).sortWithinPartitions("source", *([] if landing else ["part"]), F.desc("size"), "seed")
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        i_p, i_size, i_seed, i_source, i_part = (names.index(c) for c in ("p", "size", "seed", "source", "part"))
        flight, here, out, units = Flight(both=True), None, [], []

        def closed() -> list[list]:
            return landed(units) if landing else flight.open

        def batch(units: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[(*u[3][:i_p], u[0], *u[3][i_p + 1 :]) for u in units], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            kinds = b.schema.types
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                group = (row[i_source], None if landing else row[i_part])
                if group != here:
                    out += closed()
                    flight, here, units = Flight(both=True), group, []
                unit = [row[i_p], row[i_size], row[i_seed], row]
                if landing:
                    units.append(unit)
                else:
                    out += flight.add(unit)
            if len(out) >= 4096:
                yield batch(out)
                out = []
        out += closed()
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """key, source, size, source_size, target, copies (how often the mix takes the document) and taken (words, repeats counted).

    Only narrow rows are shuffled. keep names further columns to carry along. Reruns over the same rows agree: order and chance
    come from hashes of keys and sizes.
    Defined cases: a null text has size 0; a null source is a source of its own, the last; a source without words takes
    nothing; null keys and repeated rows are documents like others; an empty table gives an empty one.
    """
    rows = written(docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), n_words(text_of(text)).alias("size"), *keep), "sizes")
    per = targets(rows.select("source", "size"), share, weights, most)
    per = per.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # a null joins too
    named = rows.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    small = per.count() <= BROADCAST_ROWS
    met = named.join(F.broadcast(per), "source") if small else looked_up(named, per, "source", "n")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    met = met.withColumn("_ratio", F.least(ratio, F.lit(float(most)))).withColumn("whole", F.floor(F.col("_ratio") + 1e-9).cast("int"))
    met = met.withColumn("p", F.greatest(F.col("_ratio") - F.col("whole"), F.lit(0.0))).withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    met = met.withColumn("seed", F.xxhash64("_key", "size")).withColumn("part", F.pmod("seed", F.ceil(F.col("n") / PART).cast("long")))
    met = met.withColumn("held", F.pmod(F.xxhash64("seed"), F.ceil(F.col("n") / RESERVE).cast("long")) == 0).drop("_ratio", "n")
    met = written(met, "chances")
    left = (F.col("p") > 0) & (F.col("p") < 1)
    done, flying, level = met.where(~left), met.where(left & ~F.col("held")), 0
    while True:
        flown = written(_flown(flying, [F.col("source"), F.col("part")], landing=False), "flight")
        done, flying = done.unionByName(flown.where(~left)), flown.where(left)
        rest = written(flying.groupBy("source").agg(F.count(F.lit(1)).alias("_left")), "left")
        if (rest.agg(F.max("_left")).first()[0] or 0) <= PART:
            break
        level += 1
        parts = F.ceil(F.col("_left") / PART).cast("long")
        flying = flying.join(rest, "source").withColumn("part", F.pmod(F.xxhash64("seed", F.lit(level)), parts)).select(met.columns)
    last = _flown(flying.unionByName(met.where(left & F.col("held"))), [F.col("source")], landing=True)
    done = done.unionByName(last)
    copies = (F.col("whole") + F.col("p")).cast("int")
    return done.select(F.col("_key").alias(key), F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def mixed(docs: DataFrame, key: str = "doc_id", broadcast_rows: int = 500_000, **how) -> DataFrame:
    """docs with every row as often as the mix takes it.

    The numbers of copies are broadcast while they are few (16 bytes each), and else joined by shuffle. Rows that share a key
    are taken as often as the one of them that is taken most.
    """
    copies = written(mix(docs, key=key, **how).groupBy(F.col(key).alias("_k")).agg(F.max("copies").alias("_copies")).where("_copies > 0"), "copies")
    side = F.broadcast(copies) if copies.count() <= broadcast_rows else copies
    met = docs.join(side, docs[key].eqNullSafe(copies["_k"]))
    rows = met.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.explode(F.array_repeat(F.lit(1), copies["_copies"])).alias("copy"))
    return rows.select("row.*")
