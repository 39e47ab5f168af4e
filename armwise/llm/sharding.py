"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm.common import ranked, text_of


def _unit(key: Column, shard: int, seed: str) -> Column:
    """A number in (0, 1) that depends on key, shard and seed alone: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(shard)), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard whose -weight / ln(u) is largest; equal scores go to the lower shard.

    A shard's own score depends on no other shard, so one more shard takes rows only into itself and a changed weight moves
    rows only to or from the shard that it belongs to. With one weight for all, the largest u wins and no logarithm is taken.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one a shard")
    even = len(set(weights)) == 1
    scores = []
    for s, w in enumerate(weights):
        u = _unit(key, s, seed)
        scores.append(F.struct((u if even else F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-s).alias("neg")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["neg"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", seed: str = "shard") -> DataFrame:
    """key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot within the shard in key order, grown_shard.

    Only these narrow columns are shuffled, never a text. Slots come from a range partitioning by (shard, key, salt), so that
    neither a large shard nor a repeated key makes a large task.
    Defined cases: a null text has size 1 and the CRC of no bytes; a null key is a key of its own, sorted first; repeated rows
    each get a slot; an empty table gives an empty one; other columns are not read.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    t = text_of(text)
    out = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(name, weights, seed).alias("shard"),
        (rendezvous(name, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    slots = ranked(out, ["_key", "text_crc32"], "slots", group=["shard"], out="slot")
    return slots.select(F.col("_key").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
