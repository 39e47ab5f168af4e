"""Joins that match arms, donors, partners and controls. Chance is an MD5 of key and salt, ties end at the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.sequence import pick
from armwise.operators.matching import in_order
from armwise.operators.resample import numbered, placed_in_groups


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the last by the order columns, by one aggregation."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*[F.col(c) for c in order])).alias("_r")).select("_r.*")


def paired_with_reference(rows: DataFrame, entity: str, arm: str, reference: str, values: Sequence[str]) -> DataFrame:
    """Each arm's values beside the reference arm's (prefix ref_); entities without a reference arm are left out."""
    base = rows.where(F.col(arm) == reference).select(entity, *[F.col(v).alias(f"ref_{v}") for v in values])
    return rows.where(F.col(arm) != reference).select(entity, arm, *values).join(base, entity)


def complete_entities(rows: DataFrame, entity: str, arm: str, needed: Sequence[str]) -> DataFrame:
    """Rows of entities that have every needed arm."""
    have = rows.where(F.col(arm).isin(*needed)).groupBy(entity).agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == len(set(needed)))
    return rows.join(have.select(entity), entity, "left_semi")


def with_missing(requests: DataFrame, results: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Requests with their results where there are any, and whether one is missing."""
    return requests.join(results, list(on), "left").withColumn("missing", F.col(value).isNull())


def only_once(rows: DataFrame, key: str, category: str) -> DataFrame:
    """Rows whose key is in one category alone."""
    twice = rows.groupBy(key).agg(F.count_distinct(category).alias("_n")).where("_n > 1")
    return rows.join(twice, key, "left_anti")


def at_least(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of groups with k rows or more."""
    return rows.join(rows.groupBy(*keys).count().where(F.col("count") >= k).drop("count"), list(keys), "left_semi")


def deranged(rows: DataFrame, key: str, within: Sequence[str], salt: str = "derange") -> DataFrame:
    """key and donor, the next in hash order around its group: a permutation without fixed points in groups of two or more."""
    w = Window.partitionBy(*within).orderBy("_h", key)
    placed = rows.select(key, *within, pick(F.lit(salt), F.col(key).cast("string")).alias("_h")).withColumn("_i", F.row_number().over(w))
    whole = Window.partitionBy(*within)
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(whole)).where("_n > 1")
    donors = placed.select(*within, F.col(key).alias("donor"), F.col("_i").alias("_j"))
    return placed.withColumn("_j", F.col("_i") % F.col("_n") + 1).join(donors, [*within, "_j"]).select(*within, key, "donor")


def unlike_donors(rows: DataFrame, key: str, within: Sequence[str], label: str, salt: str = "donor") -> DataFrame:
    """key and donor: in hash order around its group, the first row after it of another label.

    A row's donor is the first row of the next run of labels, and after the last row the order starts again; no pair is made.
    """
    w = Window.partitionBy(*within).orderBy("_h", key)
    placed = rows.select(key, *within, label, pick(F.lit(salt), F.col(key).cast("string")).alias("_h"))
    runs = placed.withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = runs.groupBy(*within, "_run").agg(F.min_by(key, F.struct("_h", key)).alias("donor"), F.first(label).alias("_l"))
    order = Window.partitionBy(*within).orderBy("_run")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, first_label, second = F.first("donor").over(whole), F.first("_l").over(whole), F.nth_value("donor", 2).over(whole)
    heads = heads.withColumn("donor2", F.coalesce(F.lead("donor").over(order), F.when(first_label != F.col("_l"), first).otherwise(second)))
    return runs.join(heads.select(*within, "_run", "donor2"), [*within, "_run"]).where("donor2 is not null").select(*within, key, F.col("donor2").alias("donor"))


def rank_matched(left: DataFrame, right: DataFrame, key: str, by: str, within: Sequence[str]) -> DataFrame:
    """One-to-one pairs of equal ranks by one number: the cheapest assignment in one dimension for sides of one size."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(by, key)
        return df.select(*within, F.col(key).alias(name), F.col(by).alias(f"{name}_{by}"), F.row_number().over(w).alias("rank"))

    return ranked(left, "left").join(ranked(right, "right"), [*within, "rank"])


#: Keys of a block at most on average. A task holds the pairs of two blocks at a time, so that this is to be small.
BLOCK = 256


def blocks(rows: DataFrame, by: Sequence[str], key: str, values: Sequence[str] = ()) -> DataFrame:
    """by, _b and _rows: each group's rows (key and values) in blocks by hash, as many as the rows' column _blocks says."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(key, *values), F.col("_blocks")))
    return dealt.groupBy(*by, "_b").agg(F.collect_list(F.struct(F.col(key).alias("key"), *values)).alias("_rows"))


def met_in_blocks(met: DataFrame, cut: DataFrame, by: Sequence[str], own: Sequence[str] = ()) -> DataFrame:
    """met with _x and _y, a row of the one group and one of the other: all pairs, made where two blocks meet and never shuffled.

    A row of met is a pair of groups of cut: they agree in by, own_a and own_b name the one and the other, _blocks_a and _blocks_b
    are their numbers of blocks. A group that meets itself gives each unordered pair of keys once. Numbers of blocks are paired
    first and fetch their rows block by block, so that a large group is the work of all tasks at every step.
    """
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = " AND ".join(["true", *[f"{c}_a = {c}_b" for c in own]])
    for s in "ab":
        met = met.withColumn(f"_b_{s}", F.explode(F.sequence(F.lit(0), F.col(f"_blocks_{s}") - 1))).drop(f"_blocks_{s}")
    # Of two blocks of one group either comes second as often as the other.
    met = met.where(f"NOT ({same}) OR _b_a = _b_b OR (_b_a < _b_b) = ((_b_a + _b_b) % 2 = 0)")
    for s in "ab":
        at = [*by, *[f"{c}_{s}" for c in own], f"_b_{s}"]
        side = cut.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in own], F.col("_b").alias(f"_b_{s}"), F.col("_rows").alias(f"_rows_{s}"))
        met = met.repartition(n, *at).join(side.hint("shuffle_hash"), at)
    made = met.withColumn("_x", F.explode("_rows_a")).drop("_rows_a").withColumn("_y", F.explode("_rows_b")).drop("_rows_b")
    return made.where(f"NOT ({same}) OR _b_a <> _b_b OR _x.key < _y.key")


def same_text_pairs(rows: DataFrame, text: str, key: str, variant: str, label: str) -> DataFrame:
    """Unordered pairs of one text with different variants, and whether the answer should change.

    As many rows as there are pairs; a text's rows are cut into blocks and pairs of blocks dealt over all tasks, so only blocks
    are shuffled, and a frequent text is no one task's.
    """
    r = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull() & F.col(variant).isNotNull())
    sizes = r.groupBy(text).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    cut = blocks(r.select(text, key, F.col(variant).alias("v"), F.col(label).alias("l")).join(sizes, text), [text], key, ["v", "l"])
    met = sizes.select(text, F.col("_blocks").alias("_blocks_a"), F.col("_blocks").alias("_blocks_b"))
    made = met_in_blocks(met, cut, [text]).where("_x.v <> _y.v AND _x.key <> _y.key")
    return made.select(text, F.least("_x.key", "_y.key").alias("a"), F.greatest("_x.key", "_y.key").alias("b"), (F.col("_x.l") != F.col("_y.l")).alias("should_change"))


def shared_member_pairs(rows: DataFrame, within: str, key: str, member: str) -> DataFrame:
    """Unordered pairs of keys that share a member within a group, and how many they share.

    Keys of one group with the same members are a class. Classes meet by an equi-join on (group, member), a row a class, and how
    many members two classes share is counted once for all their keys; the pairs of keys are then made from blocks of both
    classes and never shuffled. Keys with members of their own are classes of one, and the join is that of keys.
    """
    r = rows.select(within, key, member).where(F.col(within).isNotNull() & F.col(key).isNotNull() & F.col(member).isNotNull())
    sets = r.groupBy(within, key).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    classes = sets.groupBy(within, "_set").agg(F.min(key).alias("_class"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    cut = blocks(sets.join(classes, [within, "_set"]), [within, "_class"], key)
    m = classes.select(within, "_class", "_blocks", F.explode("_set").alias("_m"))
    a, b = (m.withColumnsRenamed({"_class": f"_class_{s}", "_blocks": f"_blocks_{s}"}) for s in "ab")
    met = a.join(b, [within, "_m"]).where("_class_a <= _class_b").groupBy(within, "_class_a", "_class_b", "_blocks_a", "_blocks_b").agg(F.count(F.lit(1)).alias("shared"))
    made = met_in_blocks(met, cut, [within], ["_class"])
    return made.select(within, F.least("_x.key", "_y.key").alias("a"), F.greatest("_x.key", "_y.key").alias("b"), "shared")


def contrasts(negatives: DataFrame, positives: DataFrame, on: Sequence[str], a: str, b: str, score: str) -> DataFrame:
    """Negative statements against positive ones that meet on some columns: the best score of each pair."""
    met = negatives.join(positives, list(on)).where(F.col(a) != F.col(b))
    best = Window.partitionBy(a, b).orderBy(F.desc(score), *on)
    return met.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def unrelated_pairs(types: DataFrame, related: DataFrame, key: str) -> DataFrame:
    """Ordered pairs of types of which neither is an ancestor of the other. types is a small closed list; the product is checked."""
    n = types.count()
    if n > 5_000:
        raise ValueError(f"{n} types are too many to pair")
    a, b = types.select(F.col(key).alias("a")), types.select(F.col(key).alias("b"))
    both = related.select(F.col("a"), F.col("b")).unionByName(related.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return a.crossJoin(F.broadcast(b)).where("a <> b").join(both, ["a", "b"], "left_anti")


def balanced_sample(rows: DataFrame, by: Sequence[str], k: int, key: str, prefer: Column | None = None, salt: str = "sample") -> DataFrame:
    """At most k rows of each stratum in hash order, preferred ones first."""
    order = [*([prefer.desc()] if prefer is not None else []), pick(F.lit(salt), F.col(key).cast("string")), F.col(key)]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def matched_controls(targets: DataFrame, pool: DataFrame, within: Sequence[str], key: str, order: str, salt: str = "control") -> DataFrame:
    """For each target an unused control of its group: the i-th target in order takes the i-th control by hash."""
    t = targets.withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy(order, key)))
    c = pool.select(*within, F.col(key).alias("control"), pick(F.lit(salt), F.col(key).cast("string")).alias("_h"))
    c = c.withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy("_h", "control"))).drop("_h")
    return t.join(c, [*within, "_i"], "left").drop("_i")


def greedy_nearest(targets: DataFrame, pool: DataFrame, within: str, key: str, value: str, tiers: Sequence[str] = ()) -> DataFrame:
    """One-to-one greedy pairs: targets in hash order take the nearest unused control, first among those that agree on most tiers.

    Pairs are those of one walk after the other; rounds over ranges of the axis make them (see matching), no group is one task's.
    """
    turn = targets.withColumn("_turn", F.md5(F.col(key).cast("string")))
    levels = [tiers[: len(tiers) - i] for i in range(len(tiers) + 1)]
    return in_order(turn, pool, [within], key, value, ["_turn"], levels).where("control is not null").drop("level")


def with_source_arm(rows: DataFrame, entity: str, arm: str, text_arm: str, input_arm: str, text: str, other: str, name: str) -> DataFrame:
    """A crossed arm: the text of one arm with the input of another, entity by entity."""
    a = rows.where(F.col(arm) == text_arm).select(entity, text)
    b = rows.where(F.col(arm) == input_arm).select(entity, other)
    return a.join(b, entity).withColumn(arm, F.lit(name))


def shard_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Shards by hash: all rows of a key go to one, in any run."""
    return rows.withColumn("shard", (pick(F.lit("shard"), F.col(key).cast("string")) % n).cast("int"))


def dealt_shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with the shard that keys in sorted order fall in, dealt in turn (turn) and cut into n blocks as even as can be (block)."""
    placed = numbered(rows, [], [key])
    return placed.withColumn("turn", (F.col("_i") % n).cast("int")).withColumn("block", F.floor(F.col("_i") * n / F.col("_n")).cast("int")).drop("_i", "_n")


def tried_donors(rows: DataFrame, key: str, within: Sequence[str], unlike: Sequence[str], tries: int = 8, salt: str = "try") -> DataFrame:
    """key and donor: the first of so many random rows of the group that differs in every one of the unlike columns; null where none does.

    A try is a hash of key and its number, which names a place in the group's order by key; tries meet rows by that place, so
    no pair of rows is made that was not tried. Nulls are a value.
    """
    placed = placed_in_groups(rows.select(key, *within, *unlike), within, [key])
    asks = placed.select(key, *within, *[F.col(c).alias(f"_{i}") for i, c in enumerate(unlike)], "_n", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("_t"))
    asks = asks.withColumn("_i", pick(F.lit(salt), F.col("_t").cast("string"), F.col(key).cast("string")) % F.col("_n"))
    met = asks.join(placed.select(*within, "_i", F.col(key).alias("donor"), *unlike), [*within, "_i"])
    for i, c in enumerate(unlike):
        met = met.where(~F.col(f"_{i}").eqNullSafe(F.col(c)))
    return rows.select(key).join(met.groupBy(key).agg(F.min_by("donor", "_t").alias("donor")), key, "left")


def not_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the sink yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def once_each(rows: DataFrame, content: str, run, **names: str) -> DataFrame:
    """run over the distinct contents only, and its result joined back to every row by content hash."""
    hashed = rows.withColumn("_sha", F.sha1(F.col(content).cast("binary")))
    unique = hashed.select("_sha", content).dropDuplicates(["_sha"])
    return hashed.join(run(unique).drop(content), "_sha").drop("_sha")


def with_donor(rows: DataFrame, donors: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows beside their donor's values (prefix donor_); donors: key, donor."""
    of = rows.select(F.col(key).alias("donor"), *[F.col(v).alias(f"donor_{v}") for v in values])
    return rows.join(donors.select(key, "donor"), key).join(of, "donor")


def with_members(pairs: DataFrame, rows: DataFrame, key: str, values: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pairs beside both members' values (suffixes _a and _b), nulls where a member has none."""
    for side, name in ((a, "a"), (b, "b")):
        pairs = pairs.join(rows.select(F.col(key).alias(side), *[F.col(v).alias(f"{v}_{name}") for v in values]), side, "left")
    return pairs


def near_or_any_donors(rows: DataFrame, key: str, near: Sequence[str], wide: Sequence[str], label: str) -> DataFrame:
    """key, donor and whether the donor is near: of another label within the near group where there is one, else within the wide group."""
    close = unlike_donors(rows, key, near, label).select(key, F.col("donor").alias("_close"))
    far = unlike_donors(rows, key, wide, label).select(key, F.col("donor").alias("_far"))
    return far.join(close, key, "full").select(key, F.coalesce("_close", "_far").alias("donor"), F.col("_close").isNotNull().alias("near"))


def grouped_pairs(rows: DataFrame, within: Sequence[str], key: str) -> DataFrame:
    """Unordered pairs of distinct keys of one group, once each: for groups that are small by nature."""
    r = rows.select(*within, key).distinct()
    return r.withColumnRenamed(key, "a").join(r.withColumnRenamed(key, "b"), list(within)).where("a < b")


def pair_scores(pairs: DataFrame, scores: DataFrame, cell: str, candidate: str, score: str) -> DataFrame:
    """Pairs (a, b, label_a, label_b) with the four scores of each cell for each label: two joins by cell, one aggregation."""
    sides = pairs.select("a", "b", "label_a", "label_b", F.explode(F.array("a", "b")).alias(cell))
    met = sides.join(scores, cell)

    def of(side: str, label: str):
        return F.max(F.when((F.col(cell) == F.col(side)) & (F.col(candidate) == F.col(f"label_{label}")), F.col(score))).alias(f"{side}_{label}")

    return met.groupBy("a", "b", "label_a", "label_b").agg(of("a", "a"), of("a", "b"), of("b", "a"), of("b", "b"))


def batches(rows: DataFrame, by: Sequence[str], key: str, size: str, budget: int) -> DataFrame:
    """Rows of each group longest first, with the batch that each falls in where batches are cut whenever sizes before it fill the budget again."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("batch", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / budget).cast("long"))
