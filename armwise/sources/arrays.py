"""Array files (.npy): vectors written as shards named by content, headers read as a table, rows read range by range.

Files are opened through pyarrow's file systems inside tasks, so a folder on any of them works that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range that is read at once, and bytes of arrays that a task reads in all.
ROWS, TASK = 4096, 128 << 20


def _spread(files: DataFrame, size: str, least: int = 1) -> DataFrame:
    """Rows that name work of `size` bytes, dealt to as many tasks as the work asks for: they are too short to be dealt by their own size."""
    work = files.agg(F.sum(size)).first()[0] or 0
    return files.repartition(max(least, -(-int(work) // TASK)), F.xxhash64(*files.columns))


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_arrays(rows: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """Writes vectors as shards of doubles and their whole-number keys beside them; gives the shards (shard, rows, width).

    A shard holds one Arrow batch's vectors of one length (spark.sql.execution.arrow.maxRecordsPerBatch bounds it). It is named by the SHA-1 of its content, so a task that runs again writes the same
    files, and the table of shards, committed by Spark under path/shards, says which files count. Rows without key or vector,
    and vectors with null components, are left out.
    """
    def write(batches: Iterator) -> Iterator:
        import hashlib
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for width, part in pdf.groupby(pdf["v"].map(len)):
                keys, data = part["k"].to_numpy("int64"), np.array(part["v"].tolist(), dtype="float64").reshape(len(part), int(width))
                name = hashlib.sha1(keys.tobytes() + data.tobytes()).hexdigest()
                for array, kind in ((data, "vectors"), (keys, "keys")):
                    held = io.BytesIO()
                    np.save(held, array)
                    there, at = _opened(f"{path}/{name}.{kind}.npy")
                    there.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with there.open_output_stream(at) as f:
                        f.write(held.getvalue())
                out.append((name, len(part), int(width)))
            yield pd.DataFrame(out, columns=["shard", "rows", "width"])

    whole = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null and not exists(v, x -> x is null)")
    whole.mapInPandas(write, "shard string, rows long, width int").write.mode("append").parquet(f"{path}/shards")
    return rows.sparkSession.read.parquet(f"{path}/shards")


def array_headers(files: DataFrame) -> DataFrame:
    """A row a file of `path`: path, rows, width, dtype and where its data begin. Only headers are read.

    One- and two-dimensional arrays of numbers in row order; others raise.
    """
    def read(batches: Iterator) -> Iterator:
        import io

        import pandas as pd
        from numpy.lib import format as npy

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                there, at = _opened(path)
                with there.open_input_file(at) as f:
                    head = io.BytesIO(f.read(1 << 16))
                version = npy.read_magic(head)
                shape, by_column, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(head)
                if by_column and len(shape) > 1 or len(shape) not in (1, 2) or dtype.kind not in "iuf":
                    raise ValueError(f"{path}: {shape} of {dtype} is no table of numbers in row order")
                out.append((path, shape[0], shape[1] if len(shape) > 1 else 1, dtype.str, head.tell()))
            yield pd.DataFrame(out, columns=["path", "rows", "width", "dtype", "start"])

    dealt = _spread(files.select("path", F.lit(1 << 16).alias("size")), "size")
    return dealt.select("path").mapInPandas(read, "path string, rows long, width int, dtype string, start long")


def read_arrays(headers: DataFrame, rows: int = ROWS) -> DataFrame:
    """path, row (from 0) and vector of doubles: files are cut into ranges of rows, which tasks read each for itself."""
    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n, dtype = min(rows, r.rows - r.first), np.dtype(r.dtype)
                there, at = _opened(r.path)
                with there.open_input_file(at) as f:
                    f.seek(r.start + r.first * r.width * dtype.itemsize)
                    data = np.frombuffer(f.read(n * r.width * dtype.itemsize), dtype).astype("float64").reshape(n, r.width)
                yield pd.DataFrame({"path": r.path, "row": np.arange(r.first, r.first + n), "vector": list(data)})

    ranges = headers.where("rows > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(rows).cast("long"))))
    sized = ranges.withColumn("size", F.least(F.lit(rows), F.col("rows") - F.col("first")) * F.col("width") * 8)
    return _spread(sized, "size", 8).mapInPandas(read, "path string, row long, vector array<double>")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """shard, key and vector of the shards that write_arrays committed under path. A shard that is listed twice counts once."""
    shards = spark.read.parquet(f"{path}/shards").select("shard").distinct()

    def of(kind: str) -> DataFrame:
        files = shards.select(F.concat(F.lit(f"{path}/"), "shard", F.lit(f".{kind}.npy")).alias("path"))
        return read_arrays(array_headers(files)).withColumn("shard", F.regexp_extract("path", r"([0-9a-f]+)\.\w+\.npy$", 1)).drop("path")

    keys = of("keys").select("shard", "row", F.element_at("vector", 1).cast("long").alias("key"))
    return keys.join(of("vectors"), ["shard", "row"]).select("shard", "key", "vector")


def count_checks(vectors: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Whether arrays hold counts: by group rows, numbers, non-zeros, negatives, fractions and the non-finite."""
    x = F.explode(vector)
    flags = {"nonzero": F.col("x") != 0, "negative": F.col("x") < 0, "fraction": F.col("x") != F.floor("x"), "broken": F.isnan("x") | (F.abs("x") == float("inf"))}
    numbers = vectors.select(by, x.alias("x")).groupBy(by).agg(F.count(F.lit(1)).alias("numbers"), *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in flags.items()])
    return vectors.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).join(numbers, by)
