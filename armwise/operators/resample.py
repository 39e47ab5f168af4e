"""Resampling and fits. Draws are MD5 picks, so that any engine makes the same; draws are made over clusters' sums, not rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwise.functions.sequence import pick
from armwise.sources.writers import scratch


def draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "draw")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their place from 0 in their group, and the group's size.

    Without a group, places come from range partitions and their offsets, so that no task holds all rows.
    """
    if by:
        return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(rows.sparkSession, "numbered")
    laid.write.parquet(path)
    laid = rows.sparkSession.read.parquet(path).withColumn("_p", F.shiftright("_at", 33))  # a partition's ids start at its number times 2^33
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    placed = laid.join(F.broadcast(sizes), "_p").withColumn("_i", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return placed.drop("_p", "_at", "_before")


#: Groups up to which a table of a row a group is broadcast.
FEW_GROUPS = 50_000


def placed_in_groups(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their place from 0 in their group and the group's size, from one global order; no group is sorted in one task. Null groups have no place."""
    placed = numbered(rows, [], [*by, *order]).drop("_n")
    spans = placed.groupBy(*by).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Few groups are named as the side to broadcast: by estimates Spark may broadcast the rows and leave what follows to one task.
    few = spans.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return placed.join(spans.hint("broadcast" if few else "shuffle_hash"), list(by)).withColumn("_i", F.col("_i") - F.col("_first")).drop("_first")


def resampled(units: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], n_draws: int, salt: str = "boot") -> DataFrame:
    """by, draw and the sums over a draw of as many units as the group has, with replacement.

    units: a row a cluster (or a row a row), already summed. For each draw and place a hash picks a unit: n_draws rows a unit,
    made by explode and reduced at once. Spark estimates exploded rows as if there were one a unit, so the join names the units
    as the side to hash; left to the estimate, all picks may be collected and broadcast.
    """
    placed = placed_in_groups(units, by, order) if by else numbered(units, by, order)
    slots = placed.select(*by, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    picked = slots.select(*by, "draw", (pick(F.lit(salt), F.col("draw").cast("string"), F.col("_i").cast("string")) % F.col("_n")).alias("_i"))
    return picked.join(placed.select(*by, "_i", *sums).hint("shuffle_hash"), [*by, "_i"]).groupBy(*by, "draw").agg(*[F.sum(s).alias(s) for s in sums])


def interval(values: DataFrame, by: Sequence[str], value: str, n_draws: int, alpha: float = 0.05) -> DataFrame:
    """Bounds by index: sorted[int(a/2 B)] and sorted[min(B - 1, int((1 - a/2) B))]; nulls are left out."""
    low, high = int(alpha / 2 * n_draws), min(n_draws - 1, int((1 - alpha / 2) * n_draws))
    held = values.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return held.select(*by, F.get("_v", F.lit(low)).alias("ci_low"), F.get("_v", F.lit(high)).alias("ci_high"))


def interpolated_interval(values: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Bounds by linear interpolation."""
    kept = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*by).agg(F.percentile(value, alpha / 2).alias("ci_low"), F.percentile(value, 1 - alpha / 2).alias("ci_high"))


def bootstrap_mean(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str], n_draws: int = 2000, salt: str = "boot") -> DataFrame:
    """by, draw and the sum and size of each draw of rows; means are sums over sizes."""
    units = rows.withColumn("_one", F.lit(1).cast("long"))
    return resampled(units, by, order, [value, "_one"], n_draws, salt).withColumnRenamed("_one", "n").withColumn("mean", F.col(value) / F.col("n"))


def cluster_bootstrap(rows: DataFrame, by: Sequence[str], cluster: str, hit: str, n_draws: int = 2000, salt: str = "cluster") -> DataFrame:
    """Whole clusters are drawn and the per-row rate kept: sum of hits over sum of sizes."""
    units = rows.groupBy(*by, cluster).agg(F.sum(F.col(hit).cast("long")).alias("hits"), F.count(F.lit(1)).alias("size"))
    return resampled(units, by, [cluster], ["hits", "size"], n_draws, salt).withColumn("rate", F.col("hits") / F.col("size"))


def paired_difference(rows: DataFrame, unit: str, a: str, b: str, n_draws: int = 2000, salt: str = "paired") -> DataFrame:
    """draw and the difference of two means over the same drawn units."""
    units = rows.select(unit, a, b).withColumn("_one", F.lit(1).cast("long"))
    return resampled(units, [], [unit], [a, b, "_one"], n_draws, salt).select("draw", ((F.col(a) - F.col(b)) / F.col("_one")).alias("difference"))


#: The Poisson(1) distribution function at 0, 1, ..., 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


#: POISSON as the first twelve hexadecimal digits of a hash: digits compare like their numbers.
STEPS = tuple(format(ceil(c * (1 << 48)), "012x") for c in POISSON)


def _digits(seed: Column) -> Column:
    return F.substring(F.md5(seed.cast("binary")), 1, 12)


def _steps(digits: Column) -> Column:
    """A Poisson(1) number, 6 at most, from a hash's digits, without making a number of them."""
    return sum(((digits >= h).cast("int") for h in STEPS[1:]), (digits >= STEPS[0]).cast("int"))


def _poisson(seed: Column) -> Column:
    """A Poisson(1) number, 6 at most, from the hash of a seed."""
    return _steps(_digits(seed)).cast("long")


def poisson_weights(units: DataFrame, key: str, n_draws: int, salt: str = "weight") -> DataFrame:
    """key, draw and a Poisson(1) weight by hash: the weights that several statistics share, without a common size to know."""
    weight = _poisson(F.concat_ws("|", F.lit(salt), F.col("draw").cast("string"), F.col(key).cast("string")))
    return units.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")).withColumn("weight", weight)


def poisson_mean(rows: DataFrame, by: Sequence[str], value: str, key: str, n_draws: int, salt: str = "poisson") -> DataFrame:
    """by, draw, the weighted sum of value and the sum of Poisson(1) weights, which hashes of draw and key give.

    A row needs nothing but its own key, so there is no join: draws are made and summed where rows lie, and a task shuffles a
    row a group and draw.
    """
    w = _poisson(F.concat_ws("|", F.lit(salt), F.col("draw").cast("string"), F.col(key).cast("string")))
    drawn = rows.select(*by, key, value, F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")).withColumn("_w", w)
    return drawn.groupBy(*by, "draw").agg(F.sum(F.col("_w") * F.col(value)).alias(value), F.sum("_w").alias("n"))


def sign_flip(rows: DataFrame, unit: str, difference: str, n_draws: int = 10_000, two_sided: bool = False, salt: str = "flip") -> DataFrame:
    """A permutation test by random signs over units: n, observed sum, draws at least as large, p = (ge + 1) / (draws + 1).

    Null below three units; 1 where all differences are zero. Differences are best given as integers. Units are dealt over all
    tasks before draws are made, as a small file is one task's.
    """
    dealt = rows.select(unit, difference).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), unit)
    signs = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"), unit, difference)
    signed = F.when(pick(F.lit(salt), F.col("draw").cast("string"), F.col(unit).cast("string")) % 2 == 0, F.col(difference)).otherwise(-F.col(difference))
    sums = signs.groupBy("draw").agg(F.sum(signed).alias("_s"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(difference).alias("observed"), F.sum(F.abs(difference)).alias("_any"))
    size = F.abs if two_sided else lambda c: c
    out = sums.crossJoin(F.broadcast(seen)).groupBy("n", "observed", "_any").agg(F.sum(F.when(size(F.col("_s")) >= size(F.col("observed")), 1).otherwise(0)).alias("ge"))
    p = F.when(F.col("n") < 3, None).when(F.col("_any") == 0, 1.0).otherwise((F.col("ge") + 1) / (n_draws + 1))
    return out.select("n", "observed", "ge", p.alias("p"))


def permuted_labels(rows: DataFrame, key: str, within: Sequence[str], label: str, draw: int = 0) -> DataFrame:
    """Rows with the labels of their group dealt out anew by hash ranks."""
    by = Window.partitionBy(*within).orderBy(key)
    other = Window.partitionBy(*within).orderBy("_h", key)
    a = rows.withColumn("_i", F.row_number().over(by))
    b = rows.select(*within, key, label, pick(F.lit(f"perm{draw}"), F.col(key).cast("string")).alias("_h"))
    b = b.select(*within, F.row_number().over(other).alias("_i"), F.col(label).alias("permuted"))
    return a.join(b, [*within, "_i"]).drop("_i")


def least_squares(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Intercept and two slopes by the normal equations of sums, and the correlation of y and x1."""
    c = {k: F.covar_pop(a, b) for k, (a, b) in {"yy": (y, y), "y1": (y, x1), "y2": (y, x2), "11": (x1, x1), "22": (x2, x2), "12": (x1, x2)}.items()}
    s = rows.agg(*[v.alias(f"c{k}") for k, v in c.items()], *[F.avg(v).alias(f"m{i}") for i, v in enumerate((y, x1, x2))], F.count(F.lit(1)).alias("n"), F.corr(y, x1).alias("r"))
    det = F.nullif(F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12"), F.lit(0.0))
    s = s.withColumn("b1", (F.col("cy1") * F.col("c22") - F.col("cy2") * F.col("c12")) / det).withColumn("b2", (F.col("cy2") * F.col("c11") - F.col("cy1") * F.col("c12")) / det)
    return s.select("n", (F.col("m0") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", "r")


def weighted_slope(rows: DataFrame, by: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    w = F.col(weight)
    s = rows.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("x"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(x) * F.col(x)).alias("xx"), F.sum(w * F.col(x) * F.col(y)).alias("xy"))
    return s.select(*by, ((F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.col("w") * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))).alias("slope"))


#: Distinct values of a range that are ordered at once.
ORDERED = 100_000


def exact_quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The quantile of a column of doubles by linear interpolation; null of none. Nulls are left out, NaN is the largest.

    A range of values that holds the wanted ranks is narrowed: a sketch of bounded size proposes a smaller one, and counts say
    whether it holds them. When few enough distinct values are left, their counts are ordered. No task holds more than those.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n = v.count()
    if not n:
        return None
    first = int(share * (n - 1))
    last = min(first + 1, n - 1)
    low, high, below = None, None, 0

    def within(df: DataFrame) -> DataFrame:
        return df if low is None else df.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))

    inside, margin = n, 0.001
    while True:
        few = within(v).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        if low == high and low is not None or inside <= ORDERED or few.count() <= ORDERED:
            break
        at = (first - below) / max(1, inside - 1)
        a, b = within(v).agg(F.percentile_approx("v", [max(0.0, at - margin), min(1.0, at + margin)], 10_000)).first()[0]
        seen = within(v).agg(F.sum((F.col("v") < F.lit(a)).cast("long")), F.sum(((F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b))).cast("long"))).first()
        if below + seen[0] <= first and last < below + seen[0] + seen[1] and seen[1] < inside:
            low, high, below, inside, margin = a, b, below + seen[0], seen[1], 0.001
        else:
            margin *= 4
            if margin > 4:
                break  # values stay together however the range is cut: their counts are ordered as they are
    found, so_far = {}, below
    for r in few.orderBy("v").toLocalIterator():
        so_far += r.c
        for rank in (first, last):
            if rank < so_far:
                found.setdefault(rank, r.v)
        if last in found:
            break
    part = share * (n - 1) - first
    return found[first] + (found[last] - found[first]) * part if part else found[first]


def lowest_share(rows: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or below a quantile, interpolated."""
    cut = exact_quantile(rows, value, share)
    return rows.where(F.lit(False)) if cut is None else rows.where(F.col(value) <= F.lit(cut))


def rank_sum_test(rows: DataFrame, feature: str, group: str, value: str, target) -> DataFrame:
    """One group against the rest, a feature a row: rank sum with ties, normal z, two-sided p, and Benjamini-Hochberg q.

    Features are few against rows; q needs one ordering of the features.
    """
    tied = rows.groupBy(feature, value).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(group) == target).cast("long")).alias("_k"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(feature).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = tied.withColumn("_b", below)
    s = run.groupBy(feature).agg(F.sum("_n").alias("n"), F.sum("_k").alias("k"), F.sum(F.col("_k") * (2 * F.col("_b") + F.col("_n") + 1)).alias("r2"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("ties"))
    s = s.where("k > 0 and k < n")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    var = k * (n - k) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (F.col("r2") / 2 - k * (n + 1) / 2) / F.sqrt(var)
    t = 1 / (1 + 0.3275911 * F.abs(F.col("z")) / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    s = s.withColumn("z", z).withColumn("p", poly * F.exp(-F.col("z") * F.col("z") / 2))
    up = Window.orderBy(F.desc("p"), F.desc(feature))
    place = F.row_number().over(Window.orderBy("p", feature))
    every = F.count(F.lit(1)).over(Window.partitionBy())
    return s.withColumn("_q", F.col("p") * every / place).withColumn("q", F.least(F.lit(1.0), F.min("_q").over(up.rowsBetween(Window.unboundedPreceding, 0)))).select(feature, "n", "k", "z", "p", "q")


def marker_table(rows: DataFrame, feature: str, group: str, value: str, target, least_fold: float = 1.0, most_q: float = 0.05) -> DataFrame:
    """feature, z, q, fold (log2 of the mean in the target group over the mean in the rest), whether it is a marker, and its score.

    Values are natural logs of 1 + x, and means are taken back to x before the fold. A marker has a fold of least_fold or more
    and a q below most_q; its score is the fold times -log10(q), q no smaller than 1e-300.
    """
    inside = F.col(group) == target
    means = rows.groupBy(feature).agg(F.avg(F.when(inside, F.col(value))).alias("_a"), F.avg(F.when(~inside, F.col(value))).alias("_b"))
    fold = F.log2((F.expm1("_a") + 1e-9) / (F.expm1("_b") + 1e-9))
    out = rank_sum_test(rows, feature, group, value, target).join(means.withColumn("fold", fold).drop("_a", "_b"), feature)
    marker = (F.col("fold") >= least_fold) & (F.col("q") < most_q)
    return out.withColumn("marker", marker).withColumn("score", F.when(marker, -F.col("fold") * F.log10(F.greatest(F.col("q"), F.lit(1e-300))))).select(feature, "z", "q", "fold", "marker", "score")


def logistic_odds(cells: DataFrame, by: Sequence[str], x: Sequence[str], y: str, weight: str) -> DataFrame:
    """Weighted logistic regression by group of aggregated cells (few rows a group): a row a coefficient, by Newton steps."""
    names = list(x)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        a = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in names]])
        t, w, b = pdf[y].to_numpy(float), pdf[weight].to_numpy(float), np.zeros(len(names) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(len(b))
            step = np.linalg.solve(h, a.T @ (w * (t - p)))
            b += step
            if np.abs(step).max() < 1e-10:
                break
        out = pd.DataFrame({"term": ["intercept", *names], "coefficient": b, "odds_ratio": np.exp(b)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "term", "coefficient", "odds_ratio"]]

    keys = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    return cells.groupBy(*by).applyInPandas(solve, f"{keys}, term string, coefficient double, odds_ratio double")


def odds_intervals(cells: DataFrame, by: Sequence[str], x: Sequence[str], y: str, weight: str, unit: str, n_draws: int = 200, alpha: float = 0.05, salt: str = "odds") -> DataFrame:
    """by, term, odds_ratio of a weighted logistic regression, with an interval from refits on resampled units.

    cells: unit, x, y and weight; (x, y) takes few distinct values. A unit's Poisson(1) weights in all draws come from its own
    hash, so cells are not joined with anything: one aggregation gives every draw's weight of each distinct (x, y), a small table
    that the draws' Newton steps share, and no refit reads the cells again. Draw -1 is the fit itself. Bounds are interpolated.
    """
    units = cells.groupBy(*by, unit, *x, y).agg(F.sum(weight).alias("_w")).groupBy(*by, unit).agg(F.collect_list(F.struct(*x, y, "_w")).alias("_cells"))
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(n_draws - 1))))  # a hash a unit and draw
    drawn = drawn.withColumn("_h", _digits(F.concat_ws("|", F.lit(salt), F.col("draw").cast("string"), F.col(unit).cast("string"))))
    drawn = drawn.withColumn("_d", F.when(F.col("draw") < 0, F.lit(1)).otherwise(_steps(F.col("_h"))).cast("long"))
    # units that a draw leaves out have no cells in it: a filter by weight would hash a row once a step
    flat = drawn.select(*by, "draw", "_d", F.explode(F.when(F.col("_d") > 0, F.col("_cells"))).alias("_c")).select(*by, "draw", "_d", "_c.*")
    table = flat.groupBy(*by, "draw", *x, y).agg(F.sum(F.col("_w") * F.col("_d")).alias("_w")).where("_w > 0")
    fits = logistic_odds(table, [*by, "draw"], x, y, "_w")
    own = fits.where("draw < 0").select(*by, "term", "coefficient", "odds_ratio")
    return own.join(interpolated_interval(fits.where("draw >= 0"), [*by, "term"], "odds_ratio", alpha), [*by, "term"], "left")


def unit_weights(units: DataFrame, by: Sequence[str], unit: str, n_draws: int, salt: str = "weights") -> DataFrame:
    """by, draw, unit and how often the draw takes the unit: one table of multinomial weights that many statistics share."""
    named = units.select(*by, unit).distinct()
    one = named.withColumn("weight", F.lit(1).cast("long"))
    placed = placed_in_groups(one, by, [unit]) if by else numbered(one, by, [unit])
    slots = placed.select(*by, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    picked = slots.select(*by, "draw", (pick(F.lit(salt), F.col("draw").cast("string"), F.col("_i").cast("string")) % F.col("_n")).alias("_i"))
    taken = picked.groupBy(*by, "draw", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return taken.join(placed.select(*by, unit, "_i").hint("shuffle_hash"), [*by, "_i"]).select(*by, "draw", unit, "weight")


def weighted_sums(units: DataFrame, weights: DataFrame, by: Sequence[str], unit: str, sums: Sequence[str]) -> DataFrame:
    """by, draw and the weighted sum of each column: every statistic of a draw from one join."""
    return weights.join(units.hint("shuffle_hash"), [*by, unit]).groupBy(*by, "draw").agg(*[F.sum(F.col("weight") * F.col(s)).alias(s) for s in sums])
