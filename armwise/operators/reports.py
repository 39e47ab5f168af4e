"""Whole reports of a run as long tables, a statistic a row, every one with its interval.

Resampling needs no joins and no places: a unit's Poisson(1) weight in a draw comes from the hash of both, so arms, groups and
statistics share their draws and differences are paired. Sums are made by unit first and are whole numbers (fractions in
millionths), so that they are exact in any order. Draw -1 weighs every unit once: the observed value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.sequence import pick
from armwise.functions.stats import jaccard
from armwise.operators.metrics import count_if
from armwise.operators.pairing import paired_with_reference
from armwise.operators.resample import POISSON, odds_intervals
from armwise.sources.writers import scratch


#: The Poisson distribution function's steps as the first twelve hexadecimal digits of a hash: digits compare like their numbers.
STEPS = [format(ceil(c * (1 << 48)), "012x") for c in POISSON]


def micro(c: Column) -> Column:
    """Millionths, as a whole number."""
    return F.round(c * 1e6).cast("long")


def drawn_sums(rows: DataFrame, by: Sequence[str], unit: str, sums: Sequence[str], n_draws: int, salt: str = "report") -> DataFrame:
    """by, draw (-1 for the observed) and the weighted sums of each draw. Nulls add nothing; a null unit is a unit of its own."""
    per = rows.groupBy(*by, unit).agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in sums])
    units = per.groupBy(unit).agg(F.collect_list(F.struct(*by, *sums)).alias("_cells"))
    drawn = units.select(unit, "_cells", F.explode(F.sequence(F.lit(-1), F.lit(n_draws - 1))).alias("draw"))  # a hash a unit and draw
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("draw").cast("string"), F.col(unit).cast("string")).cast("binary")), 1, 12)
    weight = F.when(F.col("draw") < 0, 1).otherwise(reduce(lambda x, y: x + y, [(F.col("_h") >= h).cast("int") for h in STEPS]))
    drawn = drawn.withColumn("_h", digits).withColumn("_w", weight)  # no filter by weight here: it would hash a row once a step
    flat = drawn.select("draw", "_w", F.explode(F.when(F.col("_w") > 0, F.col("_cells"))).alias("_c")).select("draw", "_w", "_c.*")
    return flat.groupBy(*by, "draw").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums])


#: Rows that a task sorts at most, unless one key has more.
TASK = 500_000


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as their number asks for, so that what a task sorts does not grow with the table."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK)), *keys)


def held(df: DataFrame, name: str) -> DataFrame:
    """A small table of sums that several statistics read, written once to the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def bounded(drawn: DataFrame, by: Sequence[str], stats: dict[str, tuple[Column, Column]], section: str) -> DataFrame:
    """section, by, series, n, value and its bounds (2.5 and 97.5 percent, interpolated), in millionths; p is null.

    stats: series name -> (n, value) of a draw. Draws without a value (an empty base) are left out of the bounds.
    """
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), n.cast("long").alias("n"), v.alias("v")) for k, (n, v) in stats.items()]))
    long = drawn.select(*by, "draw", one.alias("_s")).select(*by, "draw", "_s.*")
    seen = F.col("draw") < 0
    out = long.groupBy(*by, "series").agg(F.max(F.when(seen, F.col("n"))).alias("n"), F.max(F.when(seen, F.col("v"))).alias("_v"), F.percentile(F.when(~seen, F.col("v")), [0.025, 0.975]).alias("_q"))
    return out.select(F.lit(section).alias("section"), *by, "series", "n", micro(F.col("_v")).alias("value_e6"), micro(F.get("_q", F.lit(0))).alias("low_e6"), micro(F.get("_q", F.lit(1))).alias("high_e6"), F.lit(None).cast("long").alias("p_e6"))


def sign_flips(rows: DataFrame, by: Sequence[str], unit: str, difference: str, n_draws: int, salt: str = "flip") -> DataFrame:
    """by and p_e6 of a one-sided permutation test by random signs, for every group at once: (ge + 1) / (draws + 1).

    difference is a whole number, one row a unit. Null below three units, 1 where all differences are zero.
    """
    d = F.col(difference)
    drawn = rows.select(*by, unit, d.alias("_x"), F.explode(F.sequence(F.lit(-1), F.lit(n_draws - 1))).alias("draw"))
    plus = (F.col("draw") < 0) | (pick(F.lit(salt), F.col("draw").cast("string"), F.col(unit).cast("string")) % 2 == 0)
    sums = drawn.groupBy(*by, "draw").agg(F.sum(F.when(plus, F.col("_x")).otherwise(-F.col("_x"))).alias("s"), F.count("_x").alias("n"), F.sum(F.abs("_x")).alias("any"))
    seen = F.col("draw") < 0
    all_draws = sums.groupBy(*by).agg(F.max(F.when(seen, F.col("s"))).alias("o"), F.max("n").alias("n"), F.max("any").alias("any"), F.collect_list(F.when(~seen, F.col("s"))).alias("v"))
    ge = F.size(F.filter("v", lambda s: s >= F.col("o")))
    p = F.when(F.col("n") < 3, None).when(F.col("any") == 0, F.lit(1.0)).otherwise((ge + 1) / F.lit(n_draws + 1))
    return all_draws.select(*by, micro(p).alias("p_e6"))


def _cluster_means(rows: DataFrame, by: Sequence[str], unit: str, value: Column, name: str) -> DataFrame:
    """A row a cluster: its rows and the mean of value in millionths; nulls are left out, a cluster of nulls has no row."""
    return rows.where(value.isNotNull()).groupBy(*by, unit).agg(micro(F.sum(value.cast("long")) / F.count(value)).alias(name), F.count(F.lit(1)).alias("rows"), F.lit(1).cast("long").alias("one"))


def arm_report(rows: DataFrame, arm: str = "arm", unit: str = "unit", split: str = "split", n_draws: int = 200) -> DataFrame:
    """Every arm's accuracy over clusters with its interval, plain rates, accuracy of the answered, and accuracy by split.

    rows: arm, unit (cluster), split, and booleans correct, mapped, answered, named; null counts as false. Rates of rows keep
    their weight by row, accuracies of clusters weigh clusters alike.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False)).cast("long") for c in ("correct", "mapped", "answered", "named")}
    r = rows.select(F.col(arm).alias("arm"), F.col(unit).alias("unit"), F.col(split).cast("string").alias("split"), *[v.alias(k) for k, v in flags.items()]).withColumn("rows", F.lit(1).cast("long"))
    by_split = held(drawn_sums(r, ["arm", "split"], "unit", ["rows", *flags], n_draws), "arms")
    plain = by_split.groupBy("arm", "draw").agg(*[F.sum(c).alias(c) for c in ("rows", *flags)])
    n = F.col("rows")
    rates = bounded(plain, ["arm"], {
        "accuracy_rows": (n, ratio("correct", n)), "reached": (n, ratio("named", n)), "unmapped": (n, ratio(n - F.col("mapped"), n)), "no_answer": (n, ratio(n - F.col("answered"), n))}, "arm")
    means = drawn_sums(_cluster_means(r, ["arm"], "unit", F.col("correct"), "m"), ["arm"], "unit", ["m", "one"], n_draws)
    answered = drawn_sums(_cluster_means(r.where("answered = 1"), ["arm"], "unit", F.col("correct"), "m"), ["arm"], "unit", ["m", "one"], n_draws)
    parts = [
        rates, bounded(means, ["arm"], {"accuracy": (F.col("one"), ratio("m", "one") / 1e6)}, "arm"), bounded(answered, ["arm"], {"accuracy_answered": (F.col("one"), ratio("m", "one") / 1e6)}, "arm"),
        bounded(by_split, ["arm", "split"], {"s": (n, ratio("correct", n))}, "split").withColumn("series", F.coalesce("split", F.lit("none"))).drop("split"),
    ]
    return reduce(DataFrame.unionByName, parts)


def delta_report(rows: DataFrame, reference: str, arm: str = "arm", entity: str = "entity", unit: str = "unit", pred: str = "pred", correct: str = "correct", n_draws: int = 200, n_flips: int = 1000) -> DataFrame:
    """Each arm against the reference, example by example: the mean over clusters of the loss of accuracy, its interval and the
    one-sided p that the reference is better; and the rate of changed answers (a missing answer equals a missing one)."""
    base = rows.where(F.col(arm) == reference).select(F.col(entity).alias("_e"), F.col(pred).alias("_p"), F.coalesce(F.col(correct), F.lit(False)).cast("long").alias("_c"))
    mine = F.coalesce(F.col(correct), F.lit(False)).cast("long")
    met = rows.where(F.col(arm) != reference).join(base, F.col(entity) == F.col("_e")).select(
        F.col(arm).alias("arm"), F.col(unit).alias("unit"), (F.col("_c") - mine).alias("d"), (~F.col(pred).eqNullSafe(F.col("_p"))).cast("long").alias("changed"), F.lit(1).cast("long").alias("rows"))
    per = _cluster_means(met, ["arm"], "unit", F.col("d"), "m")
    loss = bounded(drawn_sums(per, ["arm"], "unit", ["m", "one"], n_draws), ["arm"], {"loss": (F.col("one"), ratio("m", "one") / 1e6)}, "delta")
    loss = loss.drop("p_e6").join(sign_flips(per, ["arm"], "unit", "m", n_flips), "arm")
    moved = bounded(drawn_sums(met, ["arm"], "unit", ["rows", "changed"], n_draws), ["arm"], {"changed": (F.col("rows"), ratio("changed", "rows"))}, "delta")
    return loss.unionByName(moved)


def pair_report(rows: DataFrame, text: str, variant: str, label: str, pred: str) -> DataFrame:
    """The response table of all pairs of one text with different variants, without making a pair.

    By stratum (sensitivity: labels differ, stability: they are equal): pairs, pairs whose answer changed, and pairs with both,
    one or neither answer right. Pairs that agree on some columns are n (n - 1) / 2 of the groups by those columns, and pairs
    that differ on the others follow by inclusion and exclusion. Rows are counted first, so a text of any number of rows costs
    its distinct combinations. Rows without text, variant, label or answer are in no pair.
    """
    keys = ["v", "l", "p"]
    cells = rows.select(F.col(text).alias("t"), F.col(variant).alias("v"), F.col(label).alias("l"), F.col(pred).alias("p")).dropna().groupBy("t", *keys).agg(F.count(F.lit(1)).alias("n"))
    sets = [[k for i, k in enumerate(keys) if m >> i & 1] for m in range(8)]
    right = F.col("l") == F.col("p")

    def agreeing(df: DataFrame, tag: str) -> DataFrame:
        # one pass: a cell in each of the eight groupings, told apart by a mask
        masks = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.struct(*[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys]).alias("k")) for m, s in enumerate(sets)]))
        g = df.select("t", "n", masks.alias("s")).groupBy("t", "s.mask", "s.k").agg(F.sum("n").alias("n"))
        half = F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)"))
        return g.groupBy("mask").agg(half.alias("a")).groupBy().pivot("mask", list(range(8))).agg(F.first("a")).select(*[F.coalesce(F.col(str(m)), F.lit(0)).cast("decimal(38,0)").alias(f"{tag}{m}") for m in range(8)])

    whole = agreeing(cells, "a").crossJoin(agreeing(cells.where(right), "r")).crossJoin(agreeing(cells.where(~right), "w"))  # a row each

    def count(tag: str, same: int, differ: int) -> Column:
        """Pairs that agree on `same` and differ on every column of `differ` (bit masks)."""
        terms = [(1 if bin(m).count("1") % 2 == 0 else -1, same | m) for m in range(8) if m & ~differ == 0]
        return reduce(lambda x, y: x + y, [s * F.col(f"{tag}{m}") for s, m in terms])

    out = []
    for stratum, same, differ in (("sensitivity", 0, 3), ("stability", 2, 1)):
        pairs, still = count("a", same, differ), count("a", same | 4, differ)
        both, neither = count("r", same, differ), count("w", same, differ)
        out.append(F.struct(F.lit(stratum).alias("stratum"), *[c.cast("long").alias(k) for k, c in (("pairs", pairs), ("changed", pairs - still), ("both", both), ("one", pairs - both - neither), ("neither", neither))]))
    return whole.select(F.explode(F.array(*out)).alias("s")).select("s.*")


def set_report(rows: DataFrame, reference: str, axes: dict[str, Column], n_draws: int = 200, entity: str = "entity", arm: str = "arm", terms: str = "terms") -> DataFrame:
    """Term sets of every arm against the reference's: the share left unchanged, the mean Jaccard distance, and the distance by
    strata. axes: name -> a column of the reference row that gives the stratum."""
    ref = rows.where(F.col(arm) == reference).select(F.col(entity).alias("_e"), F.col(terms).alias("_t"), F.array(*[F.concat_ws(":", F.lit(k), v.cast("string")) for k, v in axes.items()]).alias("_axes"))
    met = rows.where(F.col(arm) != reference).join(ref, F.col(entity) == F.col("_e"))
    x, y = F.array_distinct(terms), F.array_distinct("_t")
    d = met.select(F.col(arm).alias("arm"), F.col(entity).alias("entity"), "_axes", (F.array_sort(x) == F.array_sort(y)).cast("long").alias("kept"), micro(1 - jaccard(x, y)).alias("moved"), F.lit(1).cast("long").alias("one"))
    whole = bounded(drawn_sums(d, ["arm"], "entity", ["one", "kept", "moved"], n_draws), ["arm"], {"retained": (F.col("one"), ratio("kept", "one")), "distance": (F.col("one"), ratio("moved", "one") / 1e6)}, "sets")
    strata = d.withColumn("stratum", F.explode("_axes"))
    by = bounded(drawn_sums(strata, ["arm", "stratum"], "entity", ["one", "moved"], n_draws), ["arm", "stratum"], {"s": (F.col("one"), ratio("moved", "one") / 1e6)}, "strata")
    return whole.unionByName(by.withColumn("series", F.col("stratum")).drop("stratum"))


def grounding_report(rows: DataFrame, reference: str, salient: str, control: str, n_draws: int = 200, n_flips: int = 1000, entity: str = "entity", arm: str = "arm", terms: str = "terms") -> DataFrame:
    """How much farther the salient arm moves from the reference than its control, over entities with all three arms: the mean
    difference of Jaccard distances with interval and one-sided p."""
    p = paired_with_reference(rows.where(F.col(arm).isin(reference, salient, control)), entity, arm, reference, [terms])
    moved = p.select(F.col(entity).alias("entity"), F.col(arm).alias("_a"), micro(1 - jaccard(F.col(terms), F.col(f"ref_{terms}"))).alias("m"))
    wide = moved.groupBy("entity").agg(F.max(F.when(F.col("_a") == salient, F.col("m"))).alias("s"), F.max(F.when(F.col("_a") == control, F.col("m"))).alias("c")).where("s is not null and c is not null")
    gap = wide.select(F.lit(salient).alias("arm"), "entity", (F.col("s") - F.col("c")).alias("gap"), F.lit(1).cast("long").alias("one"))
    out = bounded(drawn_sums(gap, ["arm"], "entity", ["gap", "one"], n_draws), ["arm"], {"gap": (F.col("one"), ratio("gap", "one") / 1e6)}, "grounding")
    return out.drop("p_e6").join(sign_flips(gap, ["arm"], "entity", "gap", n_flips), "arm")


def swap_report(rows: DataFrame, own: str, other: str, n_draws: int = 200, entity: str = "entity", arm: str = "arm", terms: str = "terms") -> DataFrame:
    """Swapped inputs: nearness of the answer to the terms of either source, and how often it is nearer to the other one's."""
    a, b = (micro(jaccard(F.col(terms), F.col(c))) for c in (own, other))
    d = rows.select(F.col(arm).alias("arm"), F.col(entity).alias("entity"), a.alias("a"), b.alias("b"), F.lit(1).cast("long").alias("one")).withColumn("follows", (F.col("b") > F.col("a")).cast("long"))
    one = F.col("one")
    return bounded(drawn_sums(d, ["arm"], "entity", ["one", "a", "b", "follows"], n_draws), ["arm"], {"near_own": (one, ratio("a", "one") / 1e6), "near_other": (one, ratio("b", "one") / 1e6), "follows_other": (one, ratio("follows", "one"))}, "swap")


def f1_report(truth: DataFrame, said: DataFrame, covered: DataFrame, reference: str, bare: str, n_draws: int = 200) -> DataFrame:
    """F1 of propagated terms by arm: by aspect, their mean, its difference to the reference's, and the bare arm over the reference.

    truth (entity, aspect, term, weight) and said (arm, entity, aspect, term), closed under ancestors and distinct; weight is a
    whole number. covered (arm, entity): who answered in an arm, with terms or without. Precision is a mean over entities that
    say something in the aspect, recall over all covered ones with gold there. Plain sums count terms, weighed ones add weights;
    the differences pair an arm with the reference over the arm's own covered entities. Fractions are kept in millionths.
    """
    w = F.col("weight")
    gold = truth.groupBy("aspect", "entity").agg(F.count(F.lit(1)).alias("g"), F.sum(w).alias("gw"))
    weights = truth.select("term", "weight").distinct()
    hits = said.join(weights, "term", "left").withColumn("weight", F.coalesce(w, F.lit(0))).join(truth.select("aspect", "entity", "term", F.lit(True).alias("_hit")), ["aspect", "entity", "term"], "left")
    hit = F.col("_hit").isNotNull()
    parts = hits.groupBy("arm", "aspect", "entity").agg(F.count(F.lit(1)).alias("p"), F.sum(w).alias("pw"), count_if(hit).alias("tp"), F.sum(F.when(hit, w).otherwise(0)).alias("tpw"))
    asked = covered.select("arm", "entity").distinct().join(gold, "entity").join(parts, ["arm", "aspect", "entity"], "left")
    def made(c: Column) -> Column:
        return F.coalesce(micro(c), F.lit(0).cast("long"))

    own = asked.select(
        "arm", "aspect", "entity", F.lit(1).cast("long").alias("one"), (F.coalesce("p", F.lit(0)) > 0).cast("long").alias("says"), (F.coalesce("pw", F.lit(0)) > 0).cast("long").alias("says_w"),
        (F.col("gw") > 0).cast("long").alias("one_w"), made(ratio("tp", "p")).alias("pr"), made(ratio("tp", "g")).alias("re"), made(ratio("tpw", "pw")).alias("pr_w"), made(ratio("tpw", "gw")).alias("re_w"))
    cols = ["one", "says", "one_w", "says_w", "pr", "re", "pr_w", "re_w"]
    ref = own.where(F.col("arm") == reference).drop("arm")
    base = covered.select("arm", "entity").distinct().join(ref, "entity").withColumn("side", F.lit("ref"))
    both = own.join(ref.select("aspect", "entity"), ["aspect", "entity"], "left_semi").withColumn("side", F.lit("own"))
    sides = own.withColumn("side", F.lit("all")).unionByName(both).unionByName(base)

    def f1(pr, says, re, one) -> Column:
        p, r = F.coalesce(ratio(pr, says), F.lit(0.0)) / 1e6, F.coalesce(ratio(re, one), F.lit(0.0)) / 1e6
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

    d = held(drawn_sums(sides, ["side", "arm", "aspect"], "entity", cols, n_draws), "f1").withColumn("f", f1("pr", "says", "re", "one")).withColumn("fw", f1("pr_w", "says_w", "re_w", "one_w"))
    aspects = bounded(d.where("side = 'all'"), ["arm", "aspect"], {"f1": (F.col("one"), F.col("f")), "f1_weighed": (F.col("one"), F.col("fw"))}, "f1")
    aspects = aspects.withColumn("series", F.concat_ws(":", "series", "aspect")).drop("aspect")
    mean = d.groupBy("side", "arm", "draw").agg(F.avg("f").alias("f"), F.avg("fw").alias("fw"), F.max("one").alias("one"))
    means = bounded(mean.where("side = 'all'"), ["arm"], {"f1": (F.col("one"), F.col("f")), "f1_weighed": (F.col("one"), F.col("fw"))}, "f1")
    pick_side = {f"{c}_{s}": F.max(F.when(F.col("side") == s, F.col(c))) for c in ("f", "fw", "one") for s in ("own", "ref")}
    paired = mean.where(F.col("side") != "all").where(F.col("arm") != reference).groupBy("arm", "draw").agg(*[v.alias(k) for k, v in pick_side.items()])
    losses = bounded(paired, ["arm"], {"f1_loss": (F.col("one_own"), F.col("f_ref") - F.col("f_own")), "f1_weighed_loss": (F.col("one_own"), F.col("fw_ref") - F.col("fw_own"))}, "f1")
    share = bounded(paired.where(F.col("arm") == bare), ["arm"], {"f1_left": (F.col("one_own"), ratio("f_own", "f_ref")), "f1_weighed_left": (F.col("one_own"), ratio("fw_own", "fw_ref"))}, "f1")
    return reduce(DataFrame.unionByName, [aspects, means, losses, share])


def cited_lists(genes: DataFrame) -> DataFrame:
    """A row a (atlas, cell, cond): what its list held and what was cited of it, whole numbers, chances in millionths.

    genes: atlas, cell, cond, gene's rank in the list (from 1, null outside), its place among the cited (from 1, null uncited),
    and booleans ribo, deg. A cell's list is one entity's, bounded by nature. The rank correlation is of cited genes inside the
    list, from whole numbers, for cells with three or more. Places among cited genes of the list are counted by sorting them twice.
    """
    cited, inside, first = F.col("cite").isNotNull(), F.col("rank").isNotNull(), F.col("cite") <= 5
    by = ["atlas", "cell", "cond"]
    c = genes.groupBy(*by).agg(
        F.count("rank").alias("n"), F.count("cite").alias("n_ref"), count_if(cited & inside).alias("ref_in"), count_if(cited & F.col("ribo")).alias("ref_ribo"), count_if(cited & inside & F.col("deg")).alias("ref_deg"),
        count_if(first).alias("n_ref5"), count_if(first & F.col("ribo")).alias("ref5_ribo"), count_if(first & inside & F.col("deg")).alias("ref5_deg"), count_if(inside & F.col("deg")).alias("_deg"),
        count_if(inside & F.col("ribo")).alias("_ribo"), F.sum(F.when(cited & inside, F.col("rank"))).alias("_ranks"), F.sort_array(F.collect_list(F.when(cited & inside, F.struct("rank", "cite")))).alias("_both"))
    # places by citation: pairs of (cite, place by rank) in the order of cite, so that a gene's two places stand side by side
    turned = F.sort_array(F.transform("_both", lambda x, i: F.struct(x["cite"].alias("c"), i.alias("i"))))
    d2 = F.aggregate(F.transform(turned, lambda x, i: (x["i"] - i).cast("long") * (x["i"] - i)), F.lit(0).cast("long"), lambda a, b: a + b)
    m = F.size("_both").cast("long")
    enough, span = m >= 3, m * (m * m - 1)
    return c.select(
        *by, F.lit(1).cast("long").alias("cells"), "n_ref", "ref_in", "ref_ribo", "ref_deg", "n_ref5", "ref5_ribo", "ref5_deg",
        *[F.coalesce(micro(ratio(F.col(k) * F.col(r), "n")), F.lit(0).cast("long")).alias(a) for a, k, r in (("chance_deg", "n_ref", "_deg"), ("chance_deg5", "n_ref5", "_deg"), ("chance_ribo", "n_ref", "_ribo"))],
        enough.cast("long").alias("ranked"), F.when(enough, micro(1 - ratio(6 * d2, span))).otherwise(0).cast("long").alias("rho"), (enough & (6 * d2 < span)).cast("long").alias("rising"),
        (m > 0).cast("long").alias("placed"), F.when(m > 0, micro((ratio("_ranks", m) - 1) / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(0).cast("long").alias("depth"))


def sized(genes: DataFrame) -> DataFrame:
    """Genes with the number of those in their cell's list."""
    return genes.withColumn("_n", F.count("rank").over(Window.partitionBy("cell", "cond")))


def cited_slots(genes: DataFrame) -> DataFrame:
    """A row a (atlas, cell, cond, tenth of the list, ribo, deg): slots and cited ones."""
    s = (genes if "_n" in genes.columns else sized(genes)).where("cell is not null and cond is not null and rank is not null")
    tenth = F.least(F.lit(9), F.floor((F.col("rank") - 1) * 10 / F.col("_n") + 1e-9)).cast("long")
    return s.groupBy("atlas", "cell", "cond", tenth.alias("decile"), "ribo", "deg").agg(F.count(F.lit(1)).alias("tot"), F.count("cite").alias("cit"))


#: Contrasts of classes: name -> (series, series against it).
CONTRASTS = {"ribo_vs_nonribo": ("ribo", "nonribo"), "deg_vs_nondeg": ("deg", "nondeg"), "deg_in_nonribo": ("nonribo_deg", "nonribo_other"), "deg_in_ribo": ("ribo_deg", "ribo_other")}


def order_report(genes: DataFrame, reference: str, scrambled: str, n_draws: int = 200) -> DataFrame:
    """Citation by place and class: section, atlas (each and `pooled`), cond, series, decile (-1 for all), n, value and bounds.

    Sections: cited (rate by tenth and class, and margins), ratio (rate ratios of classes, crude and by tenth), position (first
    tenth over the last), input (classes' share of slots), cells (shares of the cited, chances, precision over chance, mean rank
    correlation and depth), paired (reference less scrambled). Cells are resampled; draws are summed at the finest grain once,
    and margins, pools and ratios are made of those sums.
    """
    by = ["atlas", "cond", "decile"]
    genes = held(sized(genes), "genes")
    fine = drawn_sums(cited_slots(genes).withColumn("ribo", F.coalesce("ribo", F.lit(False))).withColumn("deg", F.coalesce("deg", F.lit(False))), [*by, "ribo", "deg"], "cell", ["tot", "cit"], n_draws)
    ribo, deg = F.when(F.col("ribo"), "ribo").otherwise("nonribo"), F.when(F.col("deg"), "deg").otherwise("nondeg")
    kind = F.concat(ribo, F.when(F.col("deg"), "_deg").otherwise("_other"))
    pools = F.explode(F.array(F.col("atlas").cast("string"), F.lit("pooled")))
    d = fine.withColumn("atlas", pools).withColumn("series", F.explode(F.array(F.lit("all"), ribo, deg, kind))).withColumn("decile", F.explode(F.array(F.col("decile"), F.lit(-1).cast("long"))))
    d = held(d.groupBy(*by, "series", "draw").agg(F.sum("tot").alias("tot"), F.sum("cit").alias("cit")), "cited")
    rates = bounded(d.withColumnRenamed("series", "s"), [*by, "s"], {"x": (F.col("tot"), ratio("cit", "tot"))}, "cited").withColumn("series", F.col("s")).drop("s")

    def of(series: str, c: str) -> Column:
        return F.max(F.when(F.col("series") == series, F.col(c)))

    sides = d.groupBy(*by, "draw").agg(*[of(s, c).alias(f"{s}__{c}") for s in dict.fromkeys(x for p in CONTRASTS.values() for x in p) for c in ("tot", "cit")])
    r = {k: (F.col(f"{a}__tot") + F.col(f"{b}__tot"), ratio(ratio(f"{a}__cit", f"{a}__tot"), ratio(f"{b}__cit", f"{b}__tot"))) for k, (a, b) in CONTRASTS.items()}
    ratios = bounded(sides, by, r, "ratio").where("value_e6 is not null")
    ends = d.where(F.col("series").isin("all", "ribo", "nonribo")).groupBy("atlas", "cond", "series", "draw").agg(*[F.max(F.when(F.col("decile") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 9) for c in ("tot", "cit")])
    position = bounded(ends.withColumnRenamed("series", "s").withColumn("decile", F.lit(-1).cast("long")), [*by, "s"], {"x": (F.col("tot0") + F.col("tot9"), ratio(ratio("cit0", "tot0"), ratio("cit9", "tot9")))}, "position")
    position = position.withColumn("series", F.col("s")).drop("s").where("value_e6 is not null")
    kinds = dict.fromkeys(x for k in ("ribo", "nonribo") for x in (f"{k}_deg", f"{k}_other"))
    mix = d.where("decile = -1").groupBy(*by, "draw").agg(of("all", "tot").alias("tot"), *[F.coalesce(of(k, "tot"), F.lit(0)).alias(k) for k in kinds])
    shares = bounded(mix, by, {k: (F.col("tot"), ratio(k, "tot")) for k in kinds}, "input")

    lists = cited_lists(genes)
    sums = [c for c in lists.columns if c not in ("atlas", "cell", "cond")]
    cells = drawn_sums(lists, ["atlas", "cond"], "cell", sums, n_draws).withColumn("atlas", pools).groupBy("atlas", "cond", "draw").agg(*[F.sum(c).alias(c) for c in sums])
    cells = held(cells, "lists").withColumn("decile", F.lit(-1).cast("long"))
    n = F.col("cells")
    shares_of = {
        "in_list": ratio("ref_in", "n_ref"), "ribo_share": ratio("ref_ribo", "n_ref"), "deg_precision": ratio("ref_deg", "n_ref"), "deg_precision5": ratio("ref5_deg", "n_ref5")}
    stats = {
        "mean_cited": ratio("n_ref", n), **shares_of, "ribo_share5": ratio("ref5_ribo", "n_ref5"), "ribo_chance": ratio("chance_ribo", "n_ref") / 1e6, "deg_chance": ratio("chance_deg", "n_ref") / 1e6,
        "deg_chance5": ratio("chance_deg5", "n_ref5") / 1e6, "deg_over_chance": ratio(F.col("ref_deg") * 1_000_000, "chance_deg"), "deg_over_chance5": ratio(F.col("ref5_deg") * 1_000_000, "chance_deg5"),
        "spearman": ratio("rho", "ranked") / 1e6, "spearman_rising": ratio("rising", "ranked"), "depth": ratio("depth", "placed") / 1e6}
    own = bounded(cells, by, {k: (n, v) for k, v in stats.items()}, "cells")
    at = {k: (F.max(F.when(F.col("cond") == reference, v)), F.max(F.when(F.col("cond") == scrambled, v))) for k, v in shares_of.items()}
    two = cells.where(F.col("cond").isin(reference, scrambled)).groupBy("atlas", "decile", "draw").agg(F.max("cells").alias("cells"), *[(a - b).alias(k) for k, (a, b) in at.items()]).withColumn("cond", F.lit(f"{reference}-{scrambled}"))
    paired = bounded(two, by, {k: (n, F.col(k)) for k in at}, "paired")
    return reduce(DataFrame.unionByName, [rates, ratios, position, shares, own, paired]).drop("p_e6")


def citation_odds(slots: DataFrame, atlases: Sequence[str], n_draws: int = 200) -> DataFrame:
    """cond, term, odds_ratio and bounds of cited ~ tenth + ribo + deg + a dummy an atlas, from slots summed by cell, refitted on
    resampled cells. atlases: those that get a dummy (all but one)."""
    both = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("cit").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("tot") - F.col("cit")).alias("w"))))
    names = [f"atlas_{a}" for a in atlases]
    rows = slots.withColumn("_s", both).where("_s.w > 0").select(
        "cond", "cell", F.col("decile").cast("int").alias("tenth"), F.coalesce("ribo", F.lit(False)).cast("int").alias("ribo"), F.coalesce("deg", F.lit(False)).cast("int").alias("deg"),
        *[(F.col("atlas").cast("string") == a).cast("int").alias(n) for a, n in zip(atlases, names)], "_s.y", "_s.w")
    return odds_intervals(rows, ["cond"], ["tenth", "ribo", "deg", *names], "y", "w", "cell", n_draws)
