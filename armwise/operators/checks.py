"""Checks as tables: counts of violated invariants, fingerprints, integrity of shuffles; nested and renamed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.functions.sequence import letters
from armwise.operators.metrics import count_if
from armwise.operators.pairing import paired_with_reference


def nested(document: Column, path: str, default: str) -> Column:
    """A field of a JSON document by its path, or the default where any part of the path is missing."""
    return F.coalesce(F.get_json_object(document, f"$.{path}"), F.lit(default))


def renamed(value: Column, names: dict[str, str]) -> Column:
    """A value under its canonical name; a value without one is an error when it is met. Nulls stay."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)
    return F.when(value.isNotNull(), F.coalesce(found, F.raise_error(F.concat(F.lit("no name for "), value))))


def unchanged(rows: DataFrame, entity: str, arm: str, reference: str, value: str) -> DataFrame:
    """By arm: rows, and how many of them differ from the entity's reference arm where they must not."""
    pairs = paired_with_reference(rows, entity, arm, reference, [value])
    return pairs.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), count_if(~F.col(value).eqNullSafe(F.col(f"ref_{value}"))).alias("violations"))


def fingerprint(*settings: Column) -> Column:
    return F.sha2(F.concat_ws("|", *settings).cast("binary"), 256)


def resumable(rows: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """How many keys would resume onto a record of the same fingerprint, of another (which must be refused), and on none."""
    met = rows.select(key, F.col(mark).alias("_new")).join(stored.select(key, F.col(mark).alias("_old")), key, "left")
    return met.agg(count_if(F.col("_new") == F.col("_old")).alias("same"), count_if(F.col("_new") != F.col("_old")).alias("refused"), count_if(F.col("_old").isNull()).alias("fresh"))


def shuffle_integrity(before: Column, after: Column) -> Column:
    """Whether a shuffle kept the multiset of letters, and at how many places the letter stayed."""
    a, b = letters(before), letters(after)
    stayed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.struct((F.array_sort(a) == F.array_sort(b)).alias("kept"), stayed.cast("long").alias("stayed"), F.length(before).cast("long").alias("length"))
