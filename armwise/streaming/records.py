"""Records as they arrive: de-duplicated appends, arms joined to their reference, running change rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """JSON-lines files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def _timed(records: DataFrame, time: str, late: str | None) -> DataFrame:
    """records with a watermark, which a stream can be given once: none is set where late is None."""
    return records.withWatermark(time, late) if late else records


def once(records: DataFrame, key: str = "record_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each record id once, within the watermark."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def paired(records: DataFrame, entity: str, arm: str, reference: str, value: str, time: str = "ts", late: str | None = None, within: str = "2 hours") -> DataFrame:
    """Arms beside their entity's reference arm, where both arrive within a span: a join of the stream with itself.

    late: the watermark of records that have none yet; once gives records that have theirs.
    """
    records = _timed(records, time, late)
    base = records.where(F.col(arm) == reference).select(F.col(entity).alias("_e"), F.col(value).alias("ref"), F.col(time).alias("_t"))
    arms = records.where(F.col(arm) != reference).select(entity, arm, F.col(value).alias("new"), time)
    span = F.expr(f"_e = {entity} and {time} between _t - interval {within} and _t + interval {within}")
    return arms.join(base, span).select(entity, arm, "ref", "new", time)


def running_rates(pairs: DataFrame, arm: str, time: str = "ts", late: str | None = None, width: str = "1 hour") -> DataFrame:
    """Changed answers by arm and window; late as for paired."""
    changed = (~F.col("ref").eqNullSafe(F.col("new"))).cast("long")
    return _timed(pairs, time, late).groupBy(F.window(time, width), arm).agg(F.count(F.lit(1)).alias("n"), F.sum(changed).alias("changed"))
