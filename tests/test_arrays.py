"""Array files: round trips, ranges that cut files, headers of other types, left-out rows, empty tables."""

import numpy as np
import pytest

from armwise.sources import arrays as N


def test_round_trip_of_mixed_lengths(spark, tmp_path):
    rows = [(i, [float(i), i / 3, -1.0][: 1 + i % 3]) for i in range(50)] + [(7, [7.5]), (7, [7.5]), (None, [1.0]), (8, None), (9, [1.0, None]), (60, [])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    path = str(tmp_path / "arrays")
    shards = N.write_arrays(df, "k", "v", path)
    want = sorted((k, tuple(v)) for k, v in rows if k is not None and v is not None and None not in v)
    assert shards.groupBy().sum("rows").first()[0] == len(want)
    assert sorted((r.key, tuple(r.vector)) for r in N.read_keyed(spark, path).collect()) == want


def test_ranges_and_types(spark, tmp_path):
    data = np.arange(70, dtype="<f4").reshape(35, 2)
    np.save(tmp_path / "a.npy", data)
    np.save(tmp_path / "b.npy", np.arange(5, dtype="<i2"))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    files = spark.createDataFrame([(str(tmp_path / f"{n}.npy"),) for n in ("a", "b", "none")], "path string")
    heads = N.array_headers(files)
    assert sorted((r.rows, r.width, r.dtype) for r in heads.collect()) == [(0, 4, "<f8"), (5, 1, "<i2"), (35, 2, "<f4")]
    got = {(r.path.rsplit("/", 1)[1], r.row): r.vector for r in N.read_arrays(heads, rows=8).collect()}
    assert got == {("a.npy", i): list(map(float, data[i])) for i in range(35)} | {("b.npy", i): [float(i)] for i in range(5)}
    np.save(tmp_path / "c.npy", np.asfortranarray(data))
    with pytest.raises(Exception, match="no table of numbers"):
        N.array_headers(spark.createDataFrame([(str(tmp_path / "c.npy"),)], "path string")).collect()


def test_counts_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0, 2.5]), ("a", [-1.0]), ("b", [float("nan"), float("inf")])], "g string, vector array<double>")
    got = {r.g: (r.rows, r.numbers, r.nonzero, r.negative, r.fraction) for r in N.count_checks(df, "g").collect()}
    assert got["a"] == (2, 4, 3, 1, 1) and got["b"][:2] == (1, 2)
    assert {r.g: r.broken for r in N.count_checks(df, "g").collect()} == {"a": 0, "b": 2}
    N.write_arrays(spark.createDataFrame([], "k long, v array<double>"), "k", "v", str(tmp_path / "e"))
    assert N.read_keyed(spark, str(tmp_path / "e")).count() == 0
