"""Sinks: JSON lines, the long table of numbers, partitioned copies and small reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "figure string, panel string, model string, series string, x string, value double, n long, ci_low double, ci_high double, source string"


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Committed as a whole by Spark's commit protocol."""
    rows.write.mode("append" if append else "errorifexists").json(path)


def metric_long(rows: DataFrame, figure: str, panel: str, series: str | Column, x: str | Column, value: str | Column, n: str | None = None, ci: tuple[str, str] | None = None, model: str = "", source: str = "") -> DataFrame:
    """A metric in the long layout that every figure's numbers share."""
    def c(v: str | Column | None, kind: str) -> Column:
        return (F.lit(None) if v is None else F.col(v) if isinstance(v, str) else v).cast(kind)

    return rows.select(
        F.lit(figure).alias("figure"), F.lit(panel).alias("panel"), F.lit(model).alias("model"), c(series, "string").alias("series"), c(x, "string").alias("x"), c(value, "double").alias("value"),
        c(n, "long").alias("n"), c(ci and ci[0], "double").alias("ci_low"), c(ci and ci[1], "double").alias("ci_high"), F.lit(source).alias("source"),
    )


def all_metrics(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_csv(rows: DataFrame, path: str, compressed: bool = False) -> None:
    """Fields in quotes, blanks at their ends kept."""
    how = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(compression="gzip" if compressed else "none", **how).csv(path)


def write_by_condition(rows: DataFrame, path: str, condition: str = "condition") -> None:
    """A folder of JSON lines a condition, so that readers of one condition open nothing else."""
    rows.repartition(condition).write.partitionBy(condition).json(path)


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small result as a table of at most `limit` rows."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows.limit(limit).collect())


def latex(rows: DataFrame, limit: int = 200) -> str:
    body = "".join(" & ".join("" if v is None else str(v).replace("_", r"\_").replace("%", r"\%") for v in r) + " \\\\\n" for r in rows.limit(limit).collect())
    return f"\\begin{{tabular}}{{{'l' * len(rows.columns)}}}\n{' & '.join(c.replace('_', chr(92) + '_') for c in rows.columns)} \\\\\n{body}\\end{{tabular}}\n"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="armwise-"))
        there = spark.sparkContext.getCheckpointDir()
    return f"{there.rstrip('/')}/armwise/{name}-{uuid.uuid4().hex}"


def write_lines(rows: DataFrame, line: Column, path: str) -> str:
    """One text line a row; gives the path."""
    rows.select(line.alias("value")).write.text(path)
    return path


def write_shards(rows: DataFrame, folder: str, n: int, name: str = "records.jsonl") -> None:
    """JSON lines in n files: name, and name.0, name.1, ..."""
    spark = rows.sparkSession
    rows.repartition(n).write.json(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path, part), spark._jvm.org.apache.hadoop.fs.Path(path, name if i == 0 else f"{name}.{i - 1}"))
