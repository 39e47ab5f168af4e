"""Probes that are fitted together against plain fits one by one."""

import numpy as np
import pytest

from armwise.operators import probe_fits as B


def newton(x, t, penalty=1.0):
    z = np.column_stack([x, np.ones(len(x))])
    b, ridge = np.zeros(z.shape[1]), penalty * np.append(np.ones(x.shape[1]), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - t) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        y = int(rng.integers(0, 2))
        x = rng.normal(0, 1, 4) + np.array([0.8 * y, 0, -0.4 * y, 0]) + 0.3 * (i % 23)
        rows.append((i, f"g{i % 23}" if i % 50 else None, [float(v) for v in x], y))
    rows += [(900, "g1", None, 1), (901, "g1", [1.0, 2.0, None, 3.0], 1), (902, "g2", [1.0, 2.0, float("nan"), 3.0], 0), (903, "g2", [1.0] * 4, None)]
    return spark.createDataFrame(rows, "id int, g string, e array<float>, y int")


def test_scores_equal_plain_fits(table):
    scores = B.probe(table, "id", "g", "e", "y", k=4, draws=2)
    rows = scores.toPandas()
    assert len(rows) == 300 * 3 and set(rows["draw"]) == {-1, 0, 1} and set(rows["target"]) == {1.0}
    data = B.prepared(table, "id", "g", "e", "y", 4, [0], 2).toPandas().sort_values("key")
    fold = data["folds"].map(lambda f: f[0]).to_numpy()
    x = np.stack(data["x"].to_list())
    for draw in (-1, 0, 1):
        y = data["y"].to_numpy() if draw < 0 else np.array([n[draw] for n in data["nulls"]])
        got = rows[rows["draw"] == draw].set_index("key")["score"]
        for f in range(4):
            train = fold != f
            mean, sd = x[train].mean(0), x[train].std(0)
            b = newton((x[train] - mean) / sd, y[train])
            want = 1 / (1 + np.exp(-(np.column_stack([(x[~train] - mean) / sd, np.ones((~train).sum())]) @ b)))
            assert np.allclose(got.loc[data["key"][~train]].to_numpy(), want, atol=1e-6)


def test_null_labels_keep_each_folds_counts(table):
    data = B.prepared(table, "id", "g", "e", "y", 4, [0], 5).toPandas()
    fold = data["folds"].map(lambda f: f[0])
    for f, part in data.groupby(fold):
        for d in range(5):
            assert sorted(n[d] for n in part["nulls"]) == sorted(part["y"])
    assert all(np.mean([n[d] == y for n, y in zip(data["nulls"], data["y"])]) < 0.75 for d in range(5))


def test_folds_hold_whole_groups_and_even_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), "abc"[int(rng.integers(0, 3)) if g % 3 else 0]) for g in rng.integers(0, 2000, 6000)] + [(None, "b")] * 40 + [(5000, "c")] * 3000
    df = spark.createDataFrame(rows, "g int, c string")
    folds = B.group_folds(df, "g", "c", 5)
    got = folds.toPandas()
    assert len(got) == len({g for g, _ in rows})
    of = folds.withColumnRenamed("g", "_g")
    held = df.join(of, df.g.eqNullSafe(of["_g"])).groupBy("c", "fold").count().toPandas().pivot(index="c", columns="fold", values="count").fillna(0)
    assert (held.loc[["a", "b"]].max(axis=1) < 1.25 * held.loc[["a", "b"]].mean(axis=1)).all()
    sizes = B.group_folds(df.where("g < 2000"), "g", None, 5)
    n = df.join(sizes, "g").groupBy("fold").count().toPandas()["count"]
    assert n.max() - n.min() < 0.05 * n.sum()


def test_greedy_dealing_evens_classes():
    counts = np.array([[10, 0], [0, 10], [10, 0], [0, 10], [5, 5], [5, 5]])
    folds = B.dealt(counts, 2)
    total = np.zeros((2, 2))
    for f, c in zip(folds, counts, strict=True):
        total[f] += c
    assert (total == [[15, 15], [15, 15]]).all()


def test_family_auroc_and_summary(spark):
    rng = np.random.default_rng(8)
    rows = [(int(d), int(f), float(rng.integers(0, 6)), float(rng.integers(0, 2)), 1.0) for d in (-1, 0, 1) for f in range(6) for _ in range(1 if f == 5 else 40)]
    got = {(r.draw, r.family): r.auroc for r in B.family_auroc(spark.createDataFrame(rows, "draw long, family int, score double, y double, target double"), ["draw"], "family").collect()}
    want = {}
    for d in (-1, 0, 1):
        for f in range(6):
            a = [s for e, g, s, y, _ in rows if (e, g) == (d, f) and y == 1]
            b = [s for e, g, s, y, _ in rows if (e, g) == (d, f) and y == 0]
            if a and b:
                want[d, f] = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_accuracy_over_folds_of_three_classes(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 40, [float(v) for v in rng.normal(0, 0.4, 3) + np.eye(3)[i % 3]], i % 3) for i in range(360)]
    df = spark.createDataFrame(rows, "id int, g int, e array<double>, y int")
    scores = B.probe(df, "id", "g", "e", "y", k=3, draws=1)
    data = B.prepared(df, "id", "g", "e", "y", 3, [0], 1)
    from pyspark.sql import functions as F

    out = B.fold_accuracy(data, scores, data.select("key", F.col("folds")[0].alias("fold"))).first()
    assert out.n == 360 and out.classes == 3 and abs(out.majority - 1 / 3) < 1e-12
    assert out.accuracy > 0.8 and out.null_accuracy < 0.5


def test_one_class_and_no_rows_give_no_scores(table):
    assert B.probe(table.where("y = 1"), "id", "g", "e", "y").count() == 0
    assert B.probe(table.where("false"), "id", "g", "e", "y").count() == 0
