"""Linear probes on embeddings with grouped folds, by Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions.sequence import pick


def folds(rows: DataFrame, group: str, k: int, salt: str = "fold") -> DataFrame:
    """Groups go to folds whole, by hash."""
    return rows.withColumn("fold", (pick(F.lit(salt), F.col(group).cast("string")) % k).cast("int"))


def out_of_fold(rows: DataFrame, embedding: str, label: str, group: str, k: int = 5, salt: str = "fold", keep: Sequence[str] = ()) -> DataFrame:
    """For every row the class and scores that a standardised logistic regression of the other folds gives it."""
    data = folds(rows, group, k, salt).select(*keep, group, "fold", F.col(label).cast("double").alias("label"), array_to_vector(F.col(embedding).cast("array<double>")).alias("_x")).cache()
    out = None
    for i in range(k):
        train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
        scale = StandardScaler(inputCol="_x", outputCol="features", withMean=True, withStd=True).fit(train)
        fit = LogisticRegression(regParam=0.01, maxIter=100).fit(scale.transform(train))
        part = fit.transform(scale.transform(test)).select(*keep, group, "fold", "label", F.col("prediction"), vector_to_array("probability").alias("scores"))
        out = part if out is None else out.unionByName(part)
    return out


def repeated(rows: DataFrame, run: Callable[[DataFrame, str], DataFrame], seeds: Sequence[int]) -> DataFrame:
    """run over several fold salts, a column seed telling which."""
    parts = [run(rows, f"seed{s}").withColumn("seed", F.lit(s)) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_differences(rows: DataFrame, pair: str, side: str, embedding: str, label: str) -> DataFrame:
    """Difference vectors of the two members of a pair, and their negatives with the opposite label: an antisymmetric training set."""
    a, b = rows.where(F.col(side) == 0), rows.where(F.col(side) == 1)
    met = a.select(pair, F.col(embedding).alias("_a"), F.col(label).alias("label")).join(b.select(pair, F.col(embedding).alias("_b")), pair)
    d = met.select(pair, "label", F.zip_with("_a", "_b", lambda x, y: x.cast("double") - y).alias("difference"))
    return d.unionByName(d.select(pair, (1 - F.col("label")).alias("label"), F.transform("difference", lambda x: -x).alias("difference")))


def pooled(rows: DataFrame, key: str, place: str, embedding: str) -> DataFrame:
    """Mean and maximum over a sequence's inner rows (first and last left out), side by side, as one vector."""
    ends = rows.groupBy(key).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    inner = rows.join(ends, key).where((F.col(place) > F.col("_lo")) & (F.col(place) < F.col("_hi")))
    dims = inner.select(key, F.posexplode(embedding).alias("_d", "_v")).groupBy(key, "_d").agg(F.avg("_v").alias("_m"), F.max("_v").alias("_x"))
    held = dims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "_m", "_x"))).alias("_s"))
    return held.select(key, F.concat(F.transform("_s", lambda s: s["_m"]), F.transform("_s", lambda s: s["_x"].cast("double"))).alias("pooled"))
