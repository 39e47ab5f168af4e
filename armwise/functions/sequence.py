"""Edits of sequences and arrays: the arms of an experiment, as column expressions with hashes for chance."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(*parts: Column | str) -> Column:
    """A whole number below 2**48 from the MD5 of the parts: the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def hash_order(items: Column, seed: Column) -> Column:
    """The items of an array in the order of MD5(seed | place): a permutation that keeps the multiset."""
    keyed = F.transform(items, lambda c, i: F.struct(F.md5(F.concat_ws("|", seed, i.cast("string")).cast("binary")).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def shuffled(x: Column, seed: Column) -> Column:
    return F.array_join(hash_order(letters(x), seed), "")


def shuffled_words(x: Column, seed: Column) -> Column:
    return F.array_join(hash_order(F.split(x, r"\s+"), seed), " ")


def kmers(rows: DataFrame, key: str, sequence: Column, k: int) -> DataFrame:
    """key, kmer and n of every run of k letters. Sequences are dealt by key before runs are made, so each is counted where it lies."""
    n = F.length(sequence)
    runs = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(sequence, i, F.lit(k))))
    dealt = rows.select(key, runs.alias("_r")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.select(key, F.explode("_r").alias("kmer")).groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def share_of(x: Column, chars: str) -> Column:
    """The share of a sequence's letters that are among chars; null for an empty one."""
    return (F.length(x) - F.length(F.translate(x, chars, ""))) / F.nullif(F.length(x), F.lit(0))


def neutral(n: int, alphabet: str = "ACGT", seed: str = "neutral") -> Column:
    """A fixed sequence of n letters by hash."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.lit(alphabet), (pick(F.lit(seed), i.cast("string")) % len(alphabet) + 1).cast("int"), F.lit(1))), "")


def differences(a: Column, b: Column) -> Column:
    """The places, from 1, within the shorter length where two sequences differ."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def first_difference(a: Column, b: Column) -> Column:
    """The first place where two sequences differ, one past the shorter where only lengths do, null where they are equal."""
    return F.coalesce(F.get(differences(a, b), 0), F.when(F.length(a) != F.length(b), F.least(F.length(a), F.length(b)) + 1))


def edit_span(a: Column, b: Column) -> Column:
    """Common prefix and suffix lengths that do not overlap, and what stands between them in either sequence."""
    short = F.least(F.length(a), F.length(b))
    head = F.coalesce(first_difference(a, b) - 1, short)
    tail = F.least(F.coalesce(first_difference(F.reverse(a), F.reverse(b)) - 1, short), short - head)
    return F.struct(head.alias("prefix"), tail.alias("suffix"), F.substring(a, head + 1, F.length(a) - head - tail).alias("ref"), F.substring(b, head + 1, F.length(b) - head - tail).alias("var"))


def edit_class(ref: Column, var: Column) -> Column:
    r, v = F.length(ref), F.length(var)
    return F.when((r == 0) & (v == 0), "none").when((r == 1) & (v == 1), "substitution").when(r == v, "multi_base").when(r > v, "deletion").otherwise("insertion")


def window(x: Column, centre: Column, width: int) -> Column:
    """width letters around a place, moved inwards at the ends."""
    start = F.greatest(F.lit(1), F.least(centre - width // 2, F.length(x) - width + 1))
    return F.substring(x, start.cast("int"), F.lit(width))


def substituted(x: Column, places: Column, by: str = "A", instead: str = "G") -> Column:
    """A sequence with the letters at the places replaced; those that are `by` already become `instead`."""
    return F.array_join(F.transform(letters(x), lambda c, i: F.when(F.array_contains(places, i + 1), F.when(c == by, instead).otherwise(by)).otherwise(c)), "")


def deleted(x: Column, places: Column) -> Column:
    return F.array_join(F.filter(letters(x), lambda c, i: ~F.array_contains(places, i + 1)), "")


def span(x: Column, start: Column, end: Column) -> Column:
    return F.substring(x, start, end - start + 1)


def without_span(x: Column, start: Column, end: Column) -> Column:
    return F.concat(F.substring(x, F.lit(1), start - 1), F.substring(x, end + 1, F.length(x)))


def masked_block(x: Column, where: str, share: float, by: str = "X") -> Column:
    """A share of the sequence at the start, end or middle replaced by one letter."""
    n = F.floor(F.length(x) * share).cast("int")
    lead = {"start": F.lit(0), "end": F.length(x) - n, "middle": F.floor((F.length(x) - n) / 2).cast("int")}[where]
    return F.concat(F.substring(x, F.lit(1), lead), F.repeat(F.lit(by), n), F.substring(x, lead + n + 1, F.length(x)))


def widened(places: Column, k: int, length: Column) -> Column:
    """The places and their neighbours up to k away, within the sequence, in order."""
    near = F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(1), p - k), F.least(length, p + k))))
    return F.array_sort(F.array_distinct(near))


def percent_changed(a: Column, b: Column) -> Column:
    """Percent of letters changed between sequences of one length, else null."""
    return F.when(F.length(a) == F.length(b), 100.0 * F.size(differences(a, b)) / F.nullif(F.length(a), F.lit(0)))


def without_items(items: Column, gone: Column) -> Column:
    """An array without some items, duplicates of the rest kept."""
    return F.filter(items, lambda x: ~F.array_contains(gone, x))


def replaced_items(items: Column, gone: Column, spare: Column) -> Column:
    """An array whose gone items are replaced, in place, by spare ones in order; gone items beyond the spare ones are dropped."""
    numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: F.array_contains(gone, y))).alias("before")))
    swapped = F.transform(numbered, lambda s: F.when(F.array_contains(gone, s["x"]), F.get(spare, s["before"])).otherwise(s["x"]))
    return F.filter(swapped, lambda x: x.isNotNull())


def first_share(items: Column, share: float) -> Column:
    """The first ceil(share * n) of a ranked array."""
    return F.slice(items, F.lit(1), F.ceil(F.size(items) * share).cast("int"))


def sampled_items(items: Column, k: int, seed: Column) -> Column:
    """k items by hash, in the order they had."""
    keyed = F.transform(items, lambda x, i: F.struct(pick(seed, i.cast("string")).alias("k"), i.alias("i"), x.alias("x")))
    some = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(F.array_sort(F.transform(some, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def zeroed(values: Column, places: Column) -> Column:
    return F.transform(values, lambda v, i: F.when(F.array_contains(places, i + 1), F.lit(0).cast("double")).otherwise(v))


def permuted_values(values: Column, places: Column, seed: Column) -> Column:
    """The values at the places, from 1 and in order, dealt out anew among them by hash."""
    chosen = F.transform(places, lambda p: F.get(values, p - 1))
    mixed = hash_order(chosen, seed)
    return F.transform(values, lambda v, i: F.when(F.array_contains(places, i + 1), F.get(mixed, F.array_position(places, i + 1).cast("int") - 1)).otherwise(v))


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def dinucleotide_shuffled(rows: DataFrame, key: str, sequence: str, seed: str = "0") -> DataFrame:
    """key and a shuffle that keeps the counts of all pairs of neighbours: a random Eulerian walk, by Arrow batches.

    The last edge out of each letter is drawn first, until those edges form a tree into the last letter.
    """

    def walk(key_value: object, s: str | None) -> str | None:
        import hashlib
        import random

        if s is None or len(s) < 3:
            return s
        rng = random.Random(hashlib.md5(f"{seed}|{key_value}".encode()).hexdigest())
        out: dict[str, list[str]] = {}
        for a, b in zip(s, s[1:], strict=False):
            out.setdefault(a, []).append(b)
        end = s[-1]
        while True:
            last = {a: rng.choice(bs) for a, bs in out.items() if a != end}
            if all(_reaches(a, end, last) for a in last):
                break
        for a, bs in out.items():
            if a in last:
                bs.remove(last[a])
            rng.shuffle(bs)
            if a in last:
                bs.append(last[a])
        at, done = s[0], [s[0]]
        places = dict.fromkeys(out, 0)
        while at in out and places[at] < len(out[at]):
            places[at] += 1
            at = out[at][places[at] - 1]
            done.append(at)
        return "".join(done)

    def run(batches):
        for pdf in batches:
            pdf["shuffled"] = [walk(k, s) for k, s in zip(pdf[key], pdf[sequence], strict=True)]
            yield pdf[[key, "shuffled"]]

    return rows.select(key, sequence).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, shuffled string")


def _reaches(a: str, end: str, last: dict[str, str]) -> bool:
    seen = set()
    while a != end:
        if a in seen or a not in last:
            return False
        seen.add(a)
        a = last[a]
    return True


def option_list(gold: Column, vocabulary: Column, n: int, seed: Column) -> Column:
    """n options in hash order: the gold and distractors of the vocabulary, chosen by hash; all of it where n is not below its size."""
    others = F.filter(F.array_distinct(vocabulary), lambda x: x != gold)
    some = F.slice(_by_hash(others, F.concat(seed, F.lit("|pick"))), 1, n - 1) if n > 0 else others
    return _by_hash(F.concat(some, F.array(gold)), F.concat(seed, F.lit("|order")))


def _by_hash(items: Column, seed: Column) -> Column:
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("|", seed, x).cast("binary")).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def arms_of(rows: DataFrame, key: str, arms: dict[str, Column]) -> DataFrame:
    """A row a condition: key, condition and its text, all from one pass over the rows."""
    made = F.array(*[F.struct(F.lit(name).alias("condition"), text.alias("text")) for name, text in arms.items()])
    return rows.select(key, F.explode(made).alias("x")).select(key, "x.*")


def prefixes(items: Column, sizes: list[int]) -> Column:
    """The first k of a ranked array for each size k, as structs of k and items."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.slice(items, 1, k).alias("items")) for k in sizes])


def scattered(rows: DataFrame, cell: str, column: str, value: str, columns: DataFrame, salt: str = "scatter") -> DataFrame:
    """The values of each cell dealt to random columns: the i-th value, by column, goes to the i-th column in the cell's hash order."""
    w = Window.partitionBy(cell).orderBy(column)
    n = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.select(cell, value, F.row_number().over(w).alias("_i"))
    free = n.crossJoin(F.broadcast(columns.select(column))).withColumn("_h", pick(F.lit(salt), F.col(cell).cast("string"), F.col(column)))
    free = free.withColumn("_i", F.row_number().over(Window.partitionBy(cell).orderBy("_h", column))).where("_i <= _n")
    return placed.join(free.select(cell, column, "_i"), [cell, "_i"]).select(cell, column, value)


def salient(features: DataFrame, key: str, start: str, end: str, evidence: Column) -> DataFrame:
    """key, place and the best evidence of every place that a feature covers; evidence: a number, the least is the best."""
    return features.select(key, evidence.alias("evidence"), F.explode(F.sequence(start, end)).alias("place")).groupBy(key, "place").agg(F.min("evidence").alias("evidence"))


#: Places of a block: spans are cut at blocks, so that a key's spans are swept in several tasks and a block's starts are bounded.
BLOCK = 1 << 16


def _pieces(features: DataFrame, key: str, start: str, end: str, *others: Column) -> DataFrame:
    """key, block and the part (s, e) of every span in each block that it reaches; a span that ends before it starts has none."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    cut = features.where(e >= s).select(key, s.alias("_s"), e.alias("_e"), *others, F.explode(F.sequence(F.floor(s / BLOCK), F.floor(e / BLOCK))).alias("block"))
    low = F.col("block") * BLOCK
    return cut.withColumn("s", F.greatest("_s", low)).withColumn("e", F.least("_e", low + BLOCK - 1)).drop("_s", "_e")


def covered_places(features: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key and how many places its spans cover together, by a sweep over spans in order of start; no place becomes a row."""
    far = _pieces(features, key, start, end).groupBy(key, "block", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy(key, "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = far.withColumn("_new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s") - 1, F.coalesce(before, F.col("s") - 1))))
    return new.groupBy(key).agg(F.sum("_new").alias("covered"))


def salient_segments(features: DataFrame, key: str, start: str, end: str, evidence: Column) -> DataFrame:
    """key, start, end and evidence of segments: neighbouring places whose best evidence is the same, cut at blocks.

    Spans of a block come sorted by start, one a start and evidence; a heap keeps those that the sweep is in.
    """
    best = _pieces(features, key, start, end, evidence.alias("v")).groupBy(key, "block", "s", "v").agg(F.max("e").alias("e"))
    kinds = [f"{key} {features.schema[key].dataType.simpleString()}", "start long", "end long", f"evidence {best.schema['v'].dataType.simpleString()}"]

    def segments(spans: list[tuple]) -> Iterator[tuple]:
        points = sorted({s for s, _, _ in spans} | {e + 1 for _, e, _ in spans})
        active: list[tuple] = []
        held, i = None, 0
        for a, b in zip(points, points[1:]):
            while i < len(spans) and spans[i][0] == a:
                heappush(active, (spans[i][2], spans[i][1]))
                i += 1
            while active and active[0][1] < a:
                heappop(active)
            now = active[0][0] if active else None
            if held and held[2] == now and held[1] == a - 1:
                held = (held[0], b - 1, now)
                continue
            if held:
                yield held
            held = (a, b - 1, now) if active else None
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def each() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.types[0], pa.int64(), pa.int64(), b.schema.types[4]]
                yield from ((r[:2], r[2:]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        out: list[tuple] = []
        for (k, _), group in groupby(each(), key=lambda r: r[0]):
            out += [(k, *x) for x in segments([x for _, x in group])]
            if len(out) > 50_000:
                yield _batch(out, types, schema)
                out = []
        if out:
            yield _batch(out, types, schema)

    schema = [k.split()[0] for k in kinds]
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = best.where("v IS NOT NULL").select(key, "block", "s", "e", "v").repartition(parts, key, "block").sortWithinPartitions(key, "block", "s")
    return dealt.mapInArrow(run, ", ".join(kinds))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def largest_span(features: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """key and its longest feature, the first by order where several are, and how many places all features cover together."""
    best = features.groupBy(key).agg(F.max_by(F.struct(start, end), F.struct((F.col(end) - F.col(start)).alias("n"), (-F.col(order)).alias("o"))).alias("_b"))
    return best.join(covered_places(features, key, start, end), key, "left").select(key, f"_b.{start}", f"_b.{end}", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"))


def around(x: Column, y: Column, before: int, after: int) -> Column:
    """The letters of x around its first difference to y: before of them ahead of it, after from it on; null where they are equal."""
    at = first_difference(x, y)
    low = F.greatest(F.lit(1), at - before)
    return F.substring(x, low, at + after - low)
