"""Linear probes that share their passes: all folds, seeds, classes and null labelings are fitted together.

A model is a set of training folds and a labeling. A pass over the table gives every model's gradient and curvature at once,
added up where rows lie; the driver solves the small systems, all stacked, and sends the coefficients back. Some eight passes fit
them all, however many they are, and nothing is cached: the table is written once and read in each pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.functions.sequence import pick
from armwise.operators.resample import numbered
from armwise.sources.writers import scratch

#: A group of more than 1 / (HEAVY * k) of all rows is dealt by class counts one at a time; there are at most HEAVY * k such groups.
HEAVY, PASSES, CLOSE = 64, 40, 1e-7


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(counts: np.ndarray, k: int, start: np.ndarray | None = None) -> list[int]:
    """A fold for each group (rows: groups in the order they are dealt, columns: classes), the one whose classes it evens most.

    That is the fold where sum(fold's count * group's count / class total) is least; then the fold of fewer rows, then the first.
    """
    total = np.maximum(counts.sum(0) + (0 if start is None else start.sum(0)), 1)
    have = np.zeros((k, counts.shape[1])) if start is None else start.astype(float)
    out = []
    for c in counts:
        f = min(range(k), key=lambda f: (round(float((have[f] * c / total).sum()), 9), have[f].sum(), f))
        have[f] += c
        out.append(f)
    return out


def group_folds(rows: DataFrame, group: str, label: str | None, k: int, salt: str = "fold") -> DataFrame:
    """group and fold: whole groups in folds with even class counts (even sizes, where there is no label).

    Heavy groups are dealt greedily by their class counts, the largest first, equal ones in hash order; the others, each too small
    to matter, go round by their rank within their commonest class. Null groups are one group; null labels are a class.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kind = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")) if label else F.lit("")
    counts = rows.groupBy(name.alias("_g"), kind.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.first(group).alias(group))
    per = counts.groupBy("_g").agg(F.first(group).alias(group), F.sum("_n").alias("_all"), F.max_by("_c", F.struct("_n", "_c")).alias("_main"), F.collect_list(F.struct("_c", "_n")).alias("_cs"))
    per = _kept(per.withColumn("_h", pick(F.lit(salt), F.col("_g"))), "groups")
    total = per.agg(F.sum("_all")).first()[0] or 0
    heavy = per.where(F.col("_all") * HEAVY * k > total).collect()  # HEAVY * k groups at most
    heavy.sort(key=lambda r: (-r._all, r._h, r._g))
    classes = sorted({c._c for r in heavy for c in r._cs})
    table = np.zeros((len(heavy), len(classes)))
    for i, r in enumerate(heavy):
        for c in r._cs:
            table[i, classes.index(c._c)] = c._n
    given = rows.sparkSession.createDataFrame([(r._g, f) for r, f in zip(heavy, dealt(table, k), strict=True)], "_g string, fold int")
    first = per.select("_g", group).join(F.broadcast(given), "_g").select(group, "fold")
    light = numbered(per.where(F.col("_all") * HEAVY * k <= total).select("_g", group, "_main", "_all", "_h"), [], ["_main", "_all", "_h", "_g"])
    turn = F.col("_i") % (2 * k)  # there and back, so that sizes even out
    return first.unionByName(light.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold")))


def large_classes(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with at least so many rows."""
    return rows.join(rows.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


def null_labels(rows: DataFrame, key: str, fold: str, label: str, draws: int, salt: str = "null") -> DataFrame:
    """key and nulls, an array of draws labels: the labels of each fold dealt out anew within it, so that every training set keeps its counts.

    Rows are ranked by hash in their fold once; draw d takes the label of the row so many ranks on, a hash of (fold, d) saying how many.
    """
    placed = numbered(rows.select(key, fold, label, pick(F.lit(salt), F.col(key).cast("string")).alias("_h")), [], [fold, "_h", key])
    spans = placed.groupBy(fold).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_size"))  # a row a fold
    placed = placed.drop("_n").join(F.broadcast(spans), fold).withColumn("_at", F.col("_i") - F.col("_first"))
    step = 1 + pick(F.lit(salt), F.col(fold).cast("string"), F.col("_d").cast("string")) % F.greatest(F.col("_size") - 1, F.lit(1))
    asks = placed.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(key, fold, "_d", ((F.col("_at") + step) % F.col("_size")).alias("_at"))
    met = asks.join(placed.select(fold, "_at", label), [fold, "_at"])
    return met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", label))), lambda s: s[label]).alias("nulls"))


@dataclass(frozen=True)
class Model:
    """Of seed's folds all but one train; draw: -1 for the labels, else a null labeling; target: the class told from the rest."""

    seed: int
    fold: int
    draw: int
    target: float


def fit_together(data: DataFrame, dims: int, models: Sequence[Model], penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept last) of every model on standardised columns, and the means and deviations of its training rows.

    data: x array<double>, y double, nulls array<double> and folds array<int>, a fold a seed. Each model minimises the logistic loss plus penalty / 2 times
    its squared coefficients by Newton steps, halved until the loss falls. A task holds the sums of all models, and so does the driver.
    """
    splits = sorted({(m.seed, m.fold) for m in models})
    place = {s: i for i, s in enumerate(splits)}
    of = np.array([place[m.seed, m.fold] for m in models])
    upper = np.triu_indices(dims + 1)

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = b.num_rows
        return b.column(0).flatten().to_numpy().reshape(n, dims), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(n, -1), b.column(3).flatten().to_numpy().reshape(n, -1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(splits), 2 * dims + 1))
        for b in (b for b in batches if b.num_rows):
            x, _, _, folds = columns(b)
            for i, (seed, fold) in enumerate(splits):
                some = x[folds[:, seed] != fold]
                total[i] += np.concatenate([some.sum(0), (some * some).sum(0), [len(some)]])
        yield _stats(total)

    got = _added(data, moments, len(splits))
    n = np.maximum(got[:, -1:], 1)
    mean = got[:, :dims] / n
    deviation = np.sqrt(np.maximum(got[:, dims:-1] / n - mean * mean, 0))
    deviation[deviation < 1e-12] = 1.0

    def slopes(beta: np.ndarray, live: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(live), 1 + dims + 1 + len(upper[0])))
            for b in (b for b in batches if b.num_rows):
                x, y, nulls, folds = columns(b)
                for s, (seed, fold) in enumerate(splits):
                    mine = np.flatnonzero(of[live] == s)
                    train = folds[:, seed] != fold
                    if not len(mine) or not train.any():
                        continue
                    z = np.column_stack([(x[train] - mean[s]) / deviation[s], np.ones(train.sum())])
                    for j in mine:
                        m = models[live[j]]
                        t = ((y[train] if m.draw < 0 else nulls[train, m.draw]) == m.target).astype(float)
                        e = z @ beta[live[j]]
                        p = 1 / (1 + np.exp(-np.clip(e, -500, 500)))
                        h = (z * (p * (1 - p))[:, None]).T @ z
                        total[j] += np.concatenate([[(np.logaddexp(0, e) - t * e).sum()], z.T @ (p - t), h[upper]])
            yield _stats(total)

        return run

    beta = np.zeros((len(models), dims + 1))
    ridge = penalty * np.append(np.ones(dims), 0)
    live, trial, step = np.arange(len(models)), beta.copy(), np.zeros_like(beta)
    loss = np.full(len(models), np.inf)
    size = np.ones(len(models))
    for _ in range(PASSES):
        got = _added(data, slopes(trial, live), len(live))
        now = got[:, 0] + 0.5 * (trial[live] ** 2 @ ridge)
        better = now <= loss[live] + 1e-12 * np.abs(now)
        for j, m in enumerate(live):
            if better[j]:
                beta[m], loss[m], size[m] = trial[m], now[j], 1.0
                h = np.zeros((dims + 1, dims + 1))
                h[upper] = got[j, dims + 2 :]
                h = h + np.triu(h, 1).T + np.diag(ridge + 1e-9)
                step[m] = np.linalg.solve(h, got[j, 1 : dims + 2] + ridge * beta[m])
            else:
                size[m] /= 2
            trial[m] = beta[m] - size[m] * step[m]
        live = live[np.abs(trial[live] - beta[live]).max(1) > CLOSE]
        if not len(live):
            break
    return beta, mean[of], deviation[of]


def _stats(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["m", "s"])


def _added(data: DataFrame, sums, n: int) -> np.ndarray:
    """The rows that tasks give for each m, added up as they stream past, and brought to the driver: n rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for m, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(s)
                held[m] = held[m] + v if m in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["m", "s"])

    parts = min(n, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = data.mapInArrow(sums, "m long, s binary").repartition(parts, "m").mapInArrow(add, "m long, s binary").collect()
    return np.stack([np.frombuffer(r.s) for r in sorted(got, key=lambda r: r.m)])


def scored(data: DataFrame, dims: int, models: Sequence[Model], fitted: tuple[np.ndarray, np.ndarray, np.ndarray], keep: Sequence[str]) -> DataFrame:
    """keep, seed, draw, target and score: what every model gives the rows of the fold that it left out."""
    beta, mean, deviation = fitted
    held = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            n = b.num_rows
            x, folds = b.column(0).flatten().to_numpy().reshape(n, dims), b.column(1).flatten().to_numpy().reshape(n, -1)
            for i, m in enumerate(models):
                rows = np.flatnonzero(folds[:, m.seed] == m.fold)
                if len(rows):
                    e = (x[rows] - mean[i]) / deviation[i] @ beta[i, :-1] + beta[i, -1]
                    of = b.take(pa.array(rows))
                    same = [pa.array(np.full(len(rows), v)) for v in (m.seed, m.draw)]
                    yield pa.RecordBatch.from_arrays([*of.columns[2:], *same, pa.array(np.full(len(rows), float(m.target))), pa.array(1 / (1 + np.exp(-np.clip(e, -500, 500))))], [*keep, "seed", "draw", "target", "score"])

    return data.select("x", "folds", *keep).mapInArrow(run, f"{held}, seed long, draw long, target double, score double")


def prepared(rows: DataFrame, key: str, group: str, embedding: str, label: str, k: int, seeds: Sequence[int], draws: int, stratify: bool = True) -> DataFrame:
    """key, group, x, y, nulls (in the folds of the first seed) and folds for every row with a label and a whole embedding, written."""
    whole = rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v.cast("double"))))
    base = whole.select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    folds = None
    for i, s in enumerate(seeds):
        one = group_folds(base, "group", "y" if stratify else None, k, f"fold{s}").select(F.col("group").alias("_g"), F.struct(F.lit(i).alias("i"), "fold").alias("_f"))
        folds = one if folds is None else folds.unionByName(one)
    folds = folds.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list("_f")), lambda f: f["fold"]).alias("folds"))  # a fold a seed
    base = base.join(folds, F.col("group").eqNullSafe(F.col("_g"))).select("key", "group", "x", "y", "folds")
    base = _kept(base, "probe")
    if not draws:
        return base.withColumn("nulls", F.array().cast("array<double>"))
    nulls = null_labels(base.withColumn("fold", F.col("folds")[0]), "key", "fold", "y", draws)
    return _kept(base.join(nulls, "key"), "probe")


def probe(rows: DataFrame, key: str, group: str, embedding: str, label: str, k: int = 5, seeds: Sequence[int] = (0,), draws: int = 0, penalty: float = 1.0, stratify: bool = True, targets: Sequence[float] | None = None) -> DataFrame:
    """key, group, y, seed, draw (-1: the labels themselves), target and score, out of fold, for all seeds, folds, labelings and targets.

    targets: classes that are told from the rest; by default all of them, or the larger one of two. Keys are unique. Null labelings keep to the first seed.
    Rows without a label or a whole embedding are left out; a group is never split; an empty table gives an empty one.
    """
    data = prepared(rows, key, group, embedding, label, k, seeds, draws, stratify)
    first = data.agg(F.max(F.size("x")).alias("dims"), F.collect_set("y").alias("classes"), F.collect_set(F.col("folds")[0]).alias("used")).first()
    classes = sorted(first.classes)
    targets = list(targets) if targets is not None else classes[1:] if len(classes) == 2 else classes
    used = {s: [r[0] for r in data.select(F.col("folds")[i]).distinct().collect()] for i, s in enumerate(seeds)}  # k rows a seed
    models = [Model(i, f, d, t) for i, s in enumerate(seeds) for f in sorted(used[s]) for d in range(-1, draws if i == 0 else 0) for t in targets]
    empty = f"key {data.schema['key'].dataType.simpleString()}, group {data.schema['group'].dataType.simpleString()}, y double, seed long, draw long, target double, score double"
    if not models or len(classes) < 2:
        return data.sparkSession.createDataFrame([], empty)
    fitted = fit_together(data.select("x", "y", "nulls", "folds"), first.dims, models, penalty)
    return scored(data, first.dims, models, fitted, ["key", "group", "y"])


def decided(scores: DataFrame) -> DataFrame:
    """key, group, y, seed, draw and pred: the target of the highest score; of two classes, whether the score is at least a half."""
    best = scores.groupBy("key", "group", "y", "seed", "draw").agg(F.max_by("target", F.struct("score", (-F.col("target")).alias("t"))).alias("_t"), F.count(F.lit(1)).alias("_n"), F.max("score").alias("_s"))
    right = F.when(F.col("_n") == 1, (F.col("_s") >= 0.5) == (F.col("y") == F.col("_t"))).otherwise(F.col("_t") == F.col("y"))
    return best.select("key", "group", "y", "seed", "draw", right.alias("hit"))


def family_auroc(scores: DataFrame, by: Sequence[str], family: str, score: str = "score", positive: Column | None = None) -> DataFrame:
    """by, family, n, n1 and auroc for families with both labels.

    Ranks come from one global order, in range partitions, less where the family starts; so no family is sorted in one task.
    """
    positive = (F.col("y") == F.col("target")) if positive is None else positive
    placed = numbered(scores.select(*by, family, F.col(score).alias("_v"), positive.cast("long").alias("_one")), [], [*by, family, "_v"])
    tied = placed.groupBy(*by, family, "_v").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.sum("_one").alias("_k"), F.count(F.lit(1)).alias("_c"))
    s = tied.groupBy(*by, family).agg(F.min("_lo").alias("_first"), F.sum("_c").alias("n"), F.sum("_k").alias("n1"), F.sum(F.col("_k") * (F.col("_lo") + F.col("_hi") + 2)).alias("_r2"))
    n0 = F.col("n") - F.col("n1")
    twice = F.col("_r2") - 2 * F.col("_first") * F.col("n1") - F.col("n1") * (F.col("n1") + 1)
    return s.where((F.col("n1") > 0) & (n0 > 0)).select(*by, family, "n", "n1", (twice / (2 * F.col("n1") * n0)).alias("auroc"))


def null_summary(per_family: DataFrame) -> DataFrame:
    """auroc (mean over families), families, and the null's draws, mean, standard deviation, least and most; one row."""
    means = per_family.groupBy("draw").agg(F.avg("auroc").alias("m"), F.count(F.lit(1)).alias("families"))
    own, null = F.col("draw") < 0, F.col("draw") >= 0
    return means.agg(
        F.max(F.when(own, F.col("m"))).alias("auroc"), F.max(F.when(own, F.col("families"))).alias("families"), F.count(F.when(null, 1)).alias("draws"),
        F.avg(F.when(null, F.col("m"))).alias("null_mean"), F.stddev_pop(F.when(null, F.col("m"))).alias("null_sd"), F.min(F.when(null, F.col("m"))).alias("null_min"), F.max(F.when(null, F.col("m"))).alias("null_max"),
    )


def fold_accuracy(rows: DataFrame, scores: DataFrame, folds: DataFrame) -> DataFrame:
    """n, classes, accuracy and its deviation over folds, the commonest class's rate, and the accuracy on null labels; one row.

    scores: of one seed, with draw 0 as the null labeling; folds: key and fold.
    """
    hit = decided(scores).join(folds, "key")
    per = hit.groupBy("draw", "fold").agg(F.avg(F.col("hit").cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    out = per.agg(F.avg(F.when(F.col("draw") < 0, F.col("a"))).alias("accuracy"), F.stddev_pop(F.when(F.col("draw") < 0, F.col("a"))).alias("accuracy_sd"), F.avg(F.when(F.col("draw") == 0, F.col("a"))).alias("null_accuracy"))
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("classes"), (F.max("c") / F.sum("c")).alias("majority"))
    return sizes.crossJoin(F.broadcast(out))  # one row each
