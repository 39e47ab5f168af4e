"""Set measures, intervals and other small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets held as arrays; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard_distance(a: Column, b: Column) -> Column:
    return 1.0 - jaccard(a, b)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    """Whether every term of a is one of b's."""
    return F.size(F.array_except(a, b)) == 0


def retention(a: Column, b: Column) -> Column:
    """The share of a's terms that b keeps; null for an empty a."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_distinct(a)), F.lit(0))


def ratio(top: Column, base: Column, floor: float = 1e-12) -> Column:
    return top / F.greatest(base.cast("double"), F.lit(floor))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share k / n; nulls where n is 0."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = k / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return mid - half, mid + half


def decile(i: Column, n: Column) -> Column:
    """The tenth of a list that place i, from 0, of n falls in."""
    return F.least(F.lit(9), F.floor(i * 10 / n)).cast("long")


def mean_of_map(scores: Column) -> Column:
    values = F.map_values(scores)
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))


def debiased(scores: Column, prior: Column) -> Column:
    """A map of candidate scores less another of the same candidates."""
    return F.map_zip_with(scores, prior, lambda k, a, b: a - F.coalesce(b, F.lit(0.0)))


def best_of_map(scores: Column) -> Column:
    """The candidate of the largest score; equal scores go by name."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))
    return F.array_min(entries)["k"]
