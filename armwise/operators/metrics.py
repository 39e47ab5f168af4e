"""Aggregates over paired arms. Rates come as integer counts next to their ratios, so that results compare exactly.

Every function takes a table of answers, one row an example and arm, and returns a DataFrame; columns are named by argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.stats import jaccard, wilson


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def share(k: str | Column, n: str | Column) -> Column:
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    return k / F.nullif(n, F.lit(0))


def arm_accuracy(answers: DataFrame, arm: str = "arm", correct: str = "correct") -> DataFrame:
    """By arm: n, n_correct, accuracy; a null answer counts as wrong."""
    return answers.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(correct)).alias("n_correct")).withColumn("accuracy", share("n_correct", "n"))


def label_accuracy(answers: DataFrame, arm: str = "arm", pred: str = "pred", gold: str = "gold") -> DataFrame:
    """By arm: n, unmapped, n_correct, accuracy over all and over the answered."""
    out = answers.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(pred).isNull()).alias("unmapped"), count_if(F.col(pred) == F.col(gold)).alias("n_correct"))
    return out.withColumn("accuracy", share("n_correct", "n")).withColumn("accuracy_answered", share("n_correct", F.col("n") - F.col("unmapped")))


def cluster_mean(answers: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    """The mean over clusters of each cluster's mean."""
    inner = answers.groupBy(*by, cluster).agg(F.avg(F.col(value).cast("double")).alias("_m"))
    return inner.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.avg("_m").alias("mean"))


def pooled_ratio(rows: DataFrame, by: Sequence[str], top: str, base: str, floor: float = 1e-12) -> DataFrame:
    out = rows.groupBy(*by).agg(F.sum(top).alias("top"), F.sum(base).alias("base"))
    return out.withColumn("ratio", F.col("top") / F.greatest(F.col("base").cast("double"), F.lit(floor)))


def weighted_mean(rows: DataFrame, by: Sequence[str], rate: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(rate) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean"), F.sum(weight).alias("weight"))


def macro_and_pooled(rows: DataFrame, group: str, hit: str) -> DataFrame:
    """A row a group and one for all (group null), by grouping sets: n, k, rate, and for all the unweighted mean of rates."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(hit)).alias("k")).withColumn("rate", share("k", "n"))
    every = out.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.avg("rate").alias("macro"))
    return out.withColumn("macro", F.lit(None).cast("double")).unionByName(every.select(F.lit(None).cast(rows.schema[group].dataType).alias(group), "n", "k", share("k", "n").alias("rate"), "macro"))


def most_common(rows: DataFrame, by: Sequence[str], value: str, first: str, k: int) -> DataFrame:
    """The k commonest values of each group; equal counts go by the first appearance."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "_first", value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")


def mode_lookup(train: DataFrame, test: DataFrame, key: str, label: str) -> DataFrame:
    """Test rows with the commonest training label of their key, or of all where the key is new; `seen` says which. Ties go by label."""
    def mode(by: Sequence[str]) -> DataFrame:
        return train.groupBy(*by, label).count().groupBy(*by).agg(F.min_by(label, F.struct((-F.col("count")).alias("c"), F.col(label).alias("l"))).alias("_mode"))

    every = mode([]).withColumnRenamed("_mode", "_all")
    joined = test.join(mode([key]), key, "left").crossJoin(F.broadcast(every))  # one row
    return joined.withColumn("seen", F.col("_mode").isNotNull()).withColumn("pred", F.coalesce("_mode", "_all")).drop("_mode", "_all")


def response_table(pairs: DataFrame, by: Sequence[str], should: str, did: str) -> DataFrame:
    """Should change against did change: the four counts, sensitivity, specificity and Youden's J, null for an empty margin."""
    s, d = F.col(should), F.col(did)
    out = pairs.groupBy(*by).agg(count_if(s & d).alias("tp"), count_if(s & ~d).alias("fn"), count_if(~s & d).alias("fp"), count_if(~s & ~d).alias("tn"))
    out = out.withColumn("sensitivity", share("tp", F.col("tp") + F.col("fn"))).withColumn("specificity", share("tn", F.col("tn") + F.col("fp")))
    return out.withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1)


def pair_accuracy(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Both, one or neither member right; pairs with a missing answer apart."""
    x, y = F.col(a), F.col(b)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(x.isNull() | y.isNull()).alias("missing"), count_if(x & y).alias("both"),
        count_if((x & ~y) | (~x & y)).alias("one"), count_if(~x & ~y).alias("neither"),
    )


def directional_precision(pairs: DataFrame, by: Sequence[str], changed: str, towards: str) -> DataFrame:
    """Of the changed pairs, the share that moved where they should."""
    out = pairs.groupBy(*by).agg(count_if(F.col(changed)).alias("changed"), count_if(F.col(changed) & F.col(towards)).alias("right"))
    return out.withColumn("precision", share("right", "changed"))


def utilisation(accuracy: DataFrame, arm: str, value: str, reference: str, controls: Sequence[str]) -> DataFrame:
    """For each control arm: the reference's accuracy less its own, and the fraction that survives it."""
    wide = accuracy.groupBy().pivot(arm, [reference, *controls]).agg(F.first(value))
    rows = [F.struct(F.lit(c).alias("control"), (F.col(f"`{reference}`") - F.col(f"`{c}`")).alias("used"), (F.col(f"`{c}`") / F.nullif(F.col(f"`{reference}`"), F.lit(0.0))).alias("surviving")) for c in controls]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def donor_following(rows: DataFrame, by: Sequence[str], pred: str, donor: str, original: str) -> DataFrame:
    """Answers that follow the donor, the original (donor first) or neither, over rows with all three."""
    scorable = rows.where(F.col(pred).isNotNull() & F.col(donor).isNotNull() & F.col(original).isNotNull())
    out = scorable.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(pred) == F.col(donor)).alias("donor"), count_if((F.col(pred) != F.col(donor)) & (F.col(pred) == F.col(original))).alias("original"))
    return out.withColumn("neither", F.col("n") - F.col("donor") - F.col("original"))


def transitions(pairs: DataFrame, by: Sequence[str], ref: str, new: str, gold: str) -> DataFrame:
    """How answers move from the reference arm: same and right or wrong, right to wrong, wrong to right, wrong to another wrong.

    A missing answer is an answer of its own: two of them are the same. With the Wilson interval of the share changed.
    """
    same = F.col(ref).eqNullSafe(F.col(new))
    right = F.coalesce(F.col(ref) == F.col(gold), F.lit(False))
    now = F.coalesce(F.col(new) == F.col(gold), F.lit(False))
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(same & right).alias("same_right"), count_if(same & ~right).alias("same_wrong"),
        count_if(~same & right & ~now).alias("right_to_wrong"), count_if(~same & ~right & now).alias("wrong_to_right"), count_if(~same & ~right & ~now).alias("wrong_to_wrong"),
    )
    out = out.withColumn("changed", F.col("n") - F.col("same_right") - F.col("same_wrong")).withColumn("change_rate", share("changed", "n"))
    low, high = wilson(F.col("changed"), F.col("n"))
    return out.withColumn("wilson_low", low).withColumn("wilson_high", high)


def upper_median(value: str | Column) -> Column:
    """The element at n // 2 of the sorted values."""
    held = F.sort_array(F.collect_list(value))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def set_change(pairs: DataFrame, by: Sequence[str], ref: str, new: str) -> DataFrame:
    """Term sets of an arm against the reference: changed, mean and upper median Jaccard, share of half or more, empty sets."""
    out = pairs.withColumn("_j", jaccard(F.col(ref), F.col(new)))
    return out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("_j") < 1).alias("changed"), F.avg("_j").alias("mean_jaccard"), upper_median("_j").alias("median_jaccard"),
        count_if(F.col("_j") >= 0.5).alias("half_or_more"), count_if(F.size(ref) == 0).alias("empty_ref"), count_if(F.size(new) == 0).alias("empty_new"),
    )


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """gold, pred (`none` where missing), n, the share of the gold's rows, and the count expected if both were independent."""
    cell = rows.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit("none")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    of_gold, of_pred, every = Window.partitionBy("gold"), Window.partitionBy("pred"), rows.count()
    out = cell.withColumn("_g", F.sum("n").over(of_gold)).withColumn("_p", F.sum("n").over(of_pred))
    return out.select("gold", "pred", "n", (F.col("n") / F.col("_g")).alias("row_share"), (F.col("_g") * F.col("_p") / F.lit(every)).alias("expected"))


def chance_match(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Observed matches of two columns, and those expected if they were independent."""
    left = rows.groupBy(F.col(a).alias("v")).agg(F.count(F.lit(1)).alias("_x"))
    right = rows.groupBy(F.col(b).alias("v")).agg(F.count(F.lit(1)).alias("_y"))
    crossed = left.join(right, "v").agg(F.sum(F.col("_x") * F.col("_y")).alias("crossed"))
    return crossed.crossJoin(rows.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(a) == F.col(b)).alias("matches"))).select("n", "matches", (F.col("crossed") / F.col("n")).alias("expected"))


def macro_f1(rows: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """By group: the mean F1 over the union of true and predicted labels, 0 where nothing matches."""
    sides = rows.select(*by, F.explode(F.array(
        F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold).eqNullSafe(F.col(pred))).cast("int").alias("t")),
        F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")),
    )).alias("s")).select(*by, "s.*").where(F.col("label").isNotNull())
    label = sides.groupBy(*by, "label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    return label.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.avg(2 * F.col("t") / (F.col("g") + F.col("p"))).alias("macro_f1"))


def average_precision(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """Sum over distinct scores, from the top, of the precision there times the gain in recall; equal scores enter together."""
    tied = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(positive)).alias("_k"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = tied.withColumn("_cn", F.sum("_n").over(w)).withColumn("_ck", F.sum("_k").over(w))
    out = run.groupBy(*by).agg(F.sum("_k").alias("positives"), F.sum(F.col("_k") * F.col("_ck") / F.col("_cn")).alias("_s"))
    return out.where("positives > 0").select(*by, "positives", (F.col("_s") / F.col("positives")).alias("average_precision"))


def auroc(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney area by average ranks, for groups with both labels: twice the rank sum is an integer until the end."""
    tied = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(positive)).alias("_k"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    run = tied.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = run.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_k").alias("positives"), F.sum(F.col("_k") * (2 * F.col("_below") + F.col("_n") + 1)).alias("_r"))
    out = out.withColumn("negatives", F.col("n") - F.col("positives")).where("positives > 0 and negatives > 0")
    return out.select(*by, "positives", "negatives", ((F.col("_r") - F.col("positives") * (F.col("positives") + 1)) / (2 * F.col("positives") * F.col("negatives"))).alias("auroc"))


def balanced_accuracy(rows: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """The mean over gold classes of the share answered right."""
    inner = rows.groupBy(*by, gold).agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(gold).eqNullSafe(F.col(pred))).alias("_k"))
    return inner.groupBy(*by).agg(F.avg(F.col("_k") / F.col("_n")).alias("balanced_accuracy"))


def propagated_f1(gold: DataFrame, pred: DataFrame, by: Sequence[str], entity: str = "entity", aspect: str = "aspect", term: str = "term", weights: DataFrame | None = None) -> DataFrame:
    """Protein-centred F1 of propagated term sets by group and aspect: precision over entities that predict, recall over all with gold.

    weights (term, weight): parts are weighed by them and summed as decimals, so that order does not matter.
    One aggregation over the said terms, flagged where gold has them, one over the gold terms; entities of gold without any
    said term count in the recall by number alone.
    """
    size = (lambda c: F.count(F.when(c, F.lit(1))).cast("double")) if weights is None else (lambda c: F.sum(F.when(c, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).cast("decimal(38,12)")).cast("double"))
    weighed = (lambda df: df) if weights is None else (lambda df: df.join(weights, term, "left"))
    truth = gold.select(aspect, entity, term).distinct()
    wanted = weighed(truth).groupBy(aspect, entity).agg(size(F.lit(True)).alias("g"))
    said = pred.select(*by, aspect, entity, term).distinct().join(truth.withColumn("_gold", F.lit(True)), [aspect, entity, term], "left")
    parts = weighed(said).groupBy(*by, aspect, entity).agg(size(F.lit(True)).alias("p"), size(F.col("_gold")).alias("tp")).join(wanted, [aspect, entity])
    some = F.col("p") > 0
    sums = parts.groupBy(*by, aspect).agg(count_if(some).alias("predicting"), F.avg(F.when(some, F.col("tp") / F.col("p"))).alias("precision"), F.sum(F.col("tp") / F.col("g")).alias("_r"))
    groups = pred.select(*by).distinct().crossJoin(F.broadcast(wanted.groupBy(aspect).agg(F.count(F.lit(1)).alias("entities"))))  # arms x aspects
    out = groups.join(sums, [*by, aspect], "left").select(*by, aspect, "entities", F.coalesce("predicting", F.lit(0)).alias("predicting"), "precision", (F.coalesce("_r", F.lit(0.0)) / F.col("entities")).alias("recall"))
    p, r = F.coalesce("precision", F.lit(0.0)), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def option_use(rows: DataFrame, place: str, n_options: str) -> DataFrame:
    """Where answers stand among their options: counts in ten bins of the relative place, and first and last rates."""
    bins = rows.select(F.least(F.lit(9), F.floor(F.col(place) * 10 / F.col(n_options))).cast("long").alias("bin"), (F.col(place) == 0).alias("_f"), (F.col(place) == F.col(n_options) - 1).alias("_l"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_f")).alias("first"), count_if(F.col("_l")).alias("last"))


def entropy(rows: DataFrame, by: Sequence[str], value: str, n_options: int) -> DataFrame:
    """Entropy of the answers over ln(options)."""
    counts = rows.groupBy(*by, value).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.log("_p")) / F.log(F.lit(float(n_options)))).alias("entropy"))


def chance_adjusted(accuracy: DataFrame, arm: str, value: str, reference: str, bare: str, chance: float) -> DataFrame:
    """The bare arm's accuracy over the reference's, plain and with chance taken off both; null where the reference is at chance."""
    wide = accuracy.groupBy().pivot(arm, [reference, bare]).agg(F.first(value))
    r, b = F.col(f"`{reference}`"), F.col(f"`{bare}`")
    return wide.select(r.alias("reference"), b.alias("bare"), (b / F.nullif(r, F.lit(0.0))).alias("ratio"), F.when(r > chance, F.greatest(F.lit(0.0), b - chance) / (r - chance)).alias("adjusted"))


def dose_table(rows: DataFrame, dose: str, arms: Sequence[str], arm: str, value: str) -> DataFrame:
    """Means by dose, an arm a column, and the gap of the first two arms."""
    wide = rows.groupBy(dose).pivot(arm, list(arms)).agg(F.avg(value))
    return wide.withColumn("gap", F.col(f"`{arms[0]}`") - F.col(f"`{arms[1]}`"))


def stratified(rows: DataFrame, axes: dict[str, Column], by: Sequence[str], value: str) -> DataFrame:
    """Means of a value by each axis's strata, all axes in one pass."""
    long = rows.select(*by, value, F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), v.cast("string").alias("stratum")) for k, v in axes.items()])).alias("s"))
    return long.groupBy("s.axis", "s.stratum", *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def two_by_two(rows: DataFrame, by: Sequence[str], left: str, right: str, value: str) -> DataFrame:
    """Effects of two swapped inputs, each A or B: of the first, of the second, and their interaction."""
    arm = F.concat_ws("_", left, right)
    wide = rows.withColumn("_arm", arm).groupBy(*by).pivot("_arm", ["A_A", "A_B", "B_A", "B_B"]).agg(F.avg(value))
    aa, ab, ba, bb = (F.col(c) for c in ("A_A", "A_B", "B_A", "B_B"))
    return wide.select(*by, ((aa + ab - ba - bb) / 2).alias("first_effect"), ((aa + ba - ab - bb) / 2).alias("second_effect"), (aa - ab - ba + bb).alias("interaction"))


def citation_table(rows: DataFrame, place: str, length: str, classes: Sequence[str], cited: str) -> DataFrame:
    """Slots and citations by tenth of the list and class, with all margins, by grouping sets."""
    tenth = F.least(F.lit(9), F.floor(F.col(place) * 10 / F.col(length))).cast("long")
    return rows.withColumn("decile", tenth).cube("decile", *classes).agg(F.count(F.lit(1)).alias("slots"), count_if(F.col(cited)).alias("cited"))


def text_ceiling(rows: DataFrame, group: str, label: str) -> DataFrame:
    """What the text alone can reach: rows whose label is their group's commonest, and rows of a strict majority, minority or tie."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group, label))
    top = rows.withColumn("_n", n).withColumn("_most", F.max("_n").over(Window.partitionBy(group)))
    leaders = top.where("_n = _most").groupBy(group).agg(F.count_distinct(label).alias("_leaders"), F.max("_n").alias("_size"))
    out = top.join(leaders, group)
    tied = F.col("_leaders") > 1
    return out.agg(
        F.count(F.lit(1)).alias("n"), count_if(~tied & (F.col("_n") == F.col("_most"))).alias("major"), count_if(F.col("_n") < F.col("_most")).alias("minor"),
        count_if(tied & (F.col("_n") == F.col("_most"))).alias("tied"),
    ).crossJoin(leaders.agg(F.sum("_size").alias("ceiling")))


def group_strata(rows: DataFrame, group: str, variant: str, label: str) -> DataFrame:
    """Groups with several variants: `sensitivity` with several labels, `stability` with one."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(variant).alias("variants"), F.count_distinct(label).alias("labels"))
    return g.where("variants > 1").withColumn("stratum", F.when(F.col("labels") > 1, "sensitivity").otherwise("stability"))


def non_modal(rows: DataFrame, group: str, pred: str) -> DataFrame:
    """By group: rows, distinct answers, and rows whose answer is not a commonest one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group, pred))
    w = rows.withColumn("_n", n)
    return w.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(pred).alias("distinct"), (F.count(F.lit(1)) - F.max("_n")).alias("non_modal"))


def across_seeds(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def coverage_groups(rows: DataFrame, arm: str, entity: str) -> DataFrame:
    """Arms grouped by the set of entities that they cover."""
    sets = rows.groupBy(arm).agg(F.array_sort(F.collect_set(entity)).alias("_set"))
    return sets.groupBy(F.md5(F.concat_ws(",", F.transform("_set", lambda x: x.cast("string"))).cast("binary")).alias("coverage")).agg(F.array_sort(F.collect_list(arm)).alias("arms"), F.first(F.size("_set")).alias("entities"))


def coverage_classes(rows: DataFrame, arm: str, entity: str) -> DataFrame:
    """Arms grouped by the set of entities that they cover, told by its size and two sums of hashes: no set is gathered."""
    h = [F.sum(F.xxhash64(F.col(entity), F.lit(i)).cast("decimal(38,0)")).alias(f"_h{i}") for i in (1, 2)]
    sums = rows.select(arm, entity).distinct().groupBy(arm).agg(F.count(F.lit(1)).alias("entities"), *h)
    return sums.groupBy("entities", "_h1", "_h2").agg(F.array_sort(F.collect_list(arm)).alias("arms")).select("arms", "entities")


def validity_gates(rows: DataFrame, reference: str, arm: str, entity: str, should_change: str, should_stay: str) -> DataFrame:
    """By arm: how often the input that should change did, and the one that should stay did; and a verdict."""
    base = rows.where(F.col(arm) == reference).select(entity, F.col(should_change).alias("_c"), F.col(should_stay).alias("_s"))
    met = rows.where(F.col(arm) != reference).join(base, entity)
    out = met.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(should_change) != F.col("_c")).alias("changed"), count_if(F.col(should_stay).eqNullSafe(F.col("_s"))).alias("stayed"))
    return out.withColumn("verdict", F.when(F.col("stayed") < F.col("n"), "FAIL stay").when(F.col("changed") * 2 < F.col("n"), "FAIL change").otherwise("PASS"))


def confusable_rank(scores: DataFrame, by: Sequence[str], candidate: str, score: str, truth: str, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Recall at each k over candidate scores: equal scores go by candidate."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), candidate)
    ranked = scores.withColumn("_rank", F.row_number().over(order)).where(F.col(candidate) == F.col(truth))
    return ranked.agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col("_rank") <= k).alias(f"hits_at_{k}") for k in ks])


def margins(scores: DataFrame, by: Sequence[str], candidate: str, score: str, truth: str) -> DataFrame:
    """The true candidate's score less the best other one."""
    hit = F.col(candidate) == F.col(truth)
    return scores.groupBy(*by).agg(F.max(F.when(hit, F.col(score))).alias("own"), F.max(F.when(~hit, F.col(score))).alias("other")).withColumn("margin", F.col("own") - F.col("other"))


def score_quantile(scores: DataFrame, cell: str, candidate: str, score: str, label: str) -> DataFrame:
    """For each cell and its own label: among cells of other labels, how many score that label lower. By counts below, no pair is made."""
    tied = scores.groupBy(candidate, score).agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(label) == F.col(candidate)).alias("_own"))
    w = Window.partitionBy(candidate).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = tied.withColumn("below", F.coalesce(F.sum(F.col("_n") - F.col("_own")).over(w), F.lit(0))).withColumn("others", F.sum(F.col("_n") - F.col("_own")).over(Window.partitionBy(candidate)))
    own = scores.where(F.col(label) == F.col(candidate)).select(cell, candidate, score)
    return own.join(below.select(candidate, score, "below", "others"), [candidate, score]).select(cell, candidate, "below", "others", share("below", "others").alias("quantile"))


def precision_at(rows: DataFrame, by: Sequence[str], place: str, hit: str, ks: Sequence[int]) -> DataFrame:
    """Hits among the first k places, for each k, and over all."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col(hit) & (F.col(place) <= k)).alias(f"hits_{k}") for k in ks], count_if(F.col(hit)).alias("hits_all"))
    return out


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Correlation of average ranks by group; groups below least rows give null."""
    def ranks(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2

    return rows.withColumn("_x", ranks(x)).withColumn("_y", ranks(y)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("_r")).select(*by, "n", F.when(F.col("n") >= least, F.col("_r")).alias("spearman"))


def capped(rows: DataFrame, order: Column, caps: dict[str, int]) -> DataFrame:
    """At most k rows of each value, column by column in the given order: the set form of greedy diversity caps."""
    out = rows
    for column, k in caps.items():
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy(order))).where(F.col("_r") <= k).drop("_r")
    return out
