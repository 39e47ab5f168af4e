"""What the operators of this subpackage share: scratch tables, word rules, ranks over whole tables, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="armwise-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/armwise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/armwise/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def n_words(text: Column) -> Column:
    """How many words a text has, without making them."""
    return F.size(words(text)).cast("long")


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo by; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def ranked(df: DataFrame, keys: Sequence[str], name: str, group: Sequence[str] = (), weight: str | None = None, out: str = "rank") -> DataFrame:
    """df with a running total of weight (1 where none) over the rows before each, in the order of group then keys, counted within group.

    Rows are range-partitioned by (group, keys, a salt), so that equal keys can part, and are written sorted. Each
    partition's totals by group, a table of at most partitions x groups-in-partition rows, become offsets.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    order = [*group, *keys, "_salt"]
    sort = [F.col(c).asc_nulls_first() for c in order]
    laid = written(salted.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()), name)
    step = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    per = laid.groupBy("_part", *group).agg(F.sum(step).alias("_all"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_offset", F.coalesce(F.sum("_all").over(before), F.lit(0).cast("long"))).drop("_all")
    per = per.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_offset")
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in (*keys, "_salt")]).rowsBetween(Window.unboundedPreceding, -1)
    mine = F.coalesce(F.sum(step).over(inside), F.lit(0).cast("long"))
    both = laid.withColumn("_mine", mine).join(F.broadcast(per), on)
    return both.withColumn(out, F.col("_offset") + F.col("_mine")).drop("_salt", "_part", "_p", "_offset", "_mine", *[f"_g{i}" for i in range(len(group))])


def looked_up(rows: DataFrame, unique: DataFrame, key: str, count: str, hot_share: int = 2000, how: str = "inner") -> DataFrame:
    """rows joined with unique on key, where unique has a row a key and, in count, how many rows carry that key.

    Keys of more than 1/hot_share of all counted rows, of which there are fewer than hot_share, are broadcast; the rest are
    shuffled, none of them hot. Null keys meet nothing.
    """
    total = unique.agg(F.sum(count)).first()[0] or 0
    least = total // hot_share + 1000
    hot = unique.where(F.col(count) > least)
    hot_keys = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot_keys, key, "left")
    few = tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key)
    many = tagged.where(F.col("_hot").isNull()).drop("_hot").join(unique.where(F.col(count) <= least), key, how)
    return few.unionByName(many)
