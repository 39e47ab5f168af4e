"""Ontologies as edge tables (child, parent): closures, information, common ancestors and inherited facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which a table of an ontology is sent to every task.
FEW = 500_000


def sent(table: DataFrame) -> DataFrame:
    """A table that joins send to every task if it is small, by its count: estimates of closures and derived edges say nothing of their size."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def closure(edges: DataFrame, depth: int = 64) -> DataFrame:
    """term, ancestor, distance (shortest), each term its own ancestor at 0. Distances double at each join, so a deep graph takes few.

    Steps are checkpointed where the session has a checkpoint folder.
    """
    terms = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    now = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).unionByName(terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance")))
    now = now.groupBy("term", "ancestor").agg(F.min("distance").alias("distance"))
    size, reach = -1, 1
    keep = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    while reach < depth:
        now = now.checkpoint() if keep else now.cache()
        n = now.count()
        if n == size:
            break
        size, reach = n, reach * 2
        up = now.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
        now = now.join(up, "ancestor").groupBy("term", F.col("_a").alias("ancestor")).agg(F.min(F.col("distance") + F.col("_d")).alias("distance"))
    return now


def propagated(annotations: DataFrame, closed: DataFrame, entity: Sequence[str], term: str = "term", once: bool = True) -> DataFrame:
    """Every term of an entity and all its ancestors; once, unless what follows makes sets of them anyway.

    Rows are dealt by the first entity column before ancestors are added, so that what follows by entity shuffles nothing more.
    """
    up = sent(closed.select(F.col("term").alias(term), "ancestor"))
    said = annotations.select(*entity, term).repartition(entity[0]).distinct()
    rows = said.join(up, term).select(*entity, F.col("ancestor").alias(term))
    return rows.distinct() if once else rows


def resolved(terms: DataFrame, alternatives: DataFrame, term: str = "term") -> DataFrame:
    """Terms with alternative ids replaced by their main ids; alternatives: alt, main."""
    return terms.join(alternatives, terms[term] == alternatives["alt"], "left").withColumn(term, F.coalesce("main", term)).drop("alt", "main")


def structural_information(closed: DataFrame) -> DataFrame:
    """term, descendants (itself included) and -ln(descendants / terms)."""
    n = closed.select("term").distinct().count()
    return closed.groupBy(F.col("ancestor").alias("term")).agg(F.count(F.lit(1)).alias("descendants")).withColumn("ic", -F.log(F.col("descendants") / n))


def corpus_information(annotations: DataFrame, term: str = "term") -> DataFrame:
    """term, n and -ln(n / all)."""
    counts = annotations.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select(term, "n", (-F.log(F.col("n") / F.col("_all"))).alias("ic"))


def information_accretion(annotations: DataFrame, edges: DataFrame, entity: str = "entity", term: str = "term") -> DataFrame:
    """term, n (entities with it), n_parents (entities with all its parents) and -log2(n / n_parents); 0 for roots.

    annotations are propagated; rows may repeat. They are shuffled once, into an entity's set of terms. A term of one parent has
    the parent's count. Terms with the same parents share one count: where an entity has the rarest of them, its set is looked at
    for the others, so no row of an entity and a child is made to be grouped. Only counts are shuffled after the sets.
    """
    sets = annotations.where(F.col(term).isNotNull()).groupBy(entity).agg(F.collect_set(term).alias("_ts"))
    held = sets.select("_ts", F.explode("_ts").alias(term))
    n = held.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    families = edges.groupBy(F.col("child").alias("_c")).agg(F.array_sort(F.collect_set("parent")).alias("_ps")).where(F.size("_ps") > 0)
    alike = families.where(F.size("_ps") > 1).groupBy("_ps").agg(F.min("_c").alias("_s"))
    few = alike.limit(FEW + 1).count() <= FEW
    each = alike.select("_s", "_ps", F.explode("_ps").alias(term)).join(n, term, "left")
    rarest = each.groupBy("_s", "_ps").agg(F.min_by(term, F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(term).alias("t"))).alias(term))
    met = held.join(F.broadcast(rarest) if few else rarest, term).where(F.size(F.array_except("_ps", "_ts")) == 0)
    whole = met.groupBy("_s").agg(F.count(F.lit(1)).alias("n_parents")).join(alike, "_s").select("_ps", "n_parents")
    single = n.select(F.array(term).alias("_ps"), F.col("n").alias("n_parents"))
    of = families.join(whole.unionByName(single), "_ps", "left").select(F.col("_c").alias(term), F.lit(True).alias("_child"), "n_parents")
    out = n.join(of, term, "left")
    ia = F.when(F.col("_child").isNull(), 0.0).when(F.col("n_parents") > 0, -F.log2(F.col("n") / F.col("n_parents")))
    return out.select(term, "n", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), ia.alias("ia"))


def common_ancestors(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """a, b, ancestor and the two distances for every common ancestor of each pair."""
    x = closed.select(F.col("term").alias("a"), "ancestor", F.col("distance").alias("da"))
    y = closed.select(F.col("term").alias("b"), "ancestor", F.col("distance").alias("db"))
    return pairs.select("a", "b").join(x, "a").join(y, ["b", "ancestor"]).select("a", "b", "ancestor", "da", "db")


def hop_distance(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """The fewest hops over a common ancestor, and that ancestor; equal ones go by name."""
    best = common_ancestors(pairs, closed).withColumn("hops", F.col("da") + F.col("db"))
    return best.groupBy("a", "b").agg(F.min(F.struct("hops", "ancestor")).alias("_m")).select("a", "b", "_m.hops", F.col("_m.ancestor").alias("nearest"))


def most_informative(pairs: DataFrame, closed: DataFrame, information: DataFrame) -> DataFrame:
    """The common ancestor of the largest information; equal ones go by name."""
    met = common_ancestors(pairs, closed).join(information.select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    return met.groupBy("a", "b").agg(F.min(F.struct((-F.col("ic")).alias("i"), "ancestor")).alias("_m")).select("a", "b", F.col("_m.ancestor").alias("mica"), (-F.col("_m.i")).alias("ic"))


def satisfied(terms: DataFrame, closed: DataFrame, entity: str, require: Sequence[str], forbid: Sequence[str]) -> DataFrame:
    """entity and whether its terms lie under every required term and under no forbidden one."""
    up = terms.join(closed.select("term", "ancestor"), "term")
    hits = up.groupBy(entity).agg(F.collect_set("ancestor").alias("_up"))
    need = F.forall(F.array(*[F.lit(r) for r in require]), lambda r: F.array_contains("_up", r)) if require else F.lit(True)
    bad = F.arrays_overlap("_up", F.array(*[F.lit(f) for f in forbid])) if forbid else F.lit(False)
    return hits.select(entity, (need & ~bad).alias("satisfied"))


def inherited_facts(facts: DataFrame, closed: DataFrame) -> DataFrame:
    """term, relation and object of every fact of a term or of an ancestor. facts: term, relation, object."""
    return closed.join(facts.withColumnRenamed("term", "ancestor"), "ancestor").select("term", "relation", "object").distinct()


def contrasting_facts(pairs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Facts of a that b does not have, for each pair."""
    mine = pairs.join(inherited.withColumnRenamed("term", "a"), "a")
    theirs = inherited.withColumnRenamed("term", "b")
    return mine.join(theirs, ["b", "relation", "object"], "left_anti").select("a", "b", "relation", "object")


def shared_facts(pairs: DataFrame, inherited: DataFrame) -> DataFrame:
    mine = pairs.join(inherited.withColumnRenamed("term", "a"), "a")
    return mine.join(inherited.withColumnRenamed("term", "b"), ["b", "relation", "object"]).select("a", "b", "relation", "object")


def contradictions(pairs: DataFrame, inherited: DataFrame, opposed: DataFrame) -> DataFrame:
    """How many facts of a contradict one of b; opposed: relation, other, the pairs of relations that exclude each other."""
    mine = pairs.join(inherited.withColumnRenamed("term", "a"), "a").join(F.broadcast(opposed), "relation")
    theirs = inherited.select(F.col("term").alias("b"), F.col("relation").alias("other"), "object")
    return mine.join(theirs, ["b", "other", "object"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("contradictions"))


def matched_type(rows: DataFrame, closed: DataFrame, pred: str, gold: str) -> DataFrame:
    """rows with fine (equal) and coarse (equal, or the prediction is an ancestor of the gold); nulls where the gold is unmapped."""
    up = closed.where("distance > 0").select(F.col("term").alias(gold), F.col("ancestor").alias(pred)).withColumn("_up", F.lit(True))
    out = rows.join(up, [gold, pred], "left")
    same = F.coalesce(F.col(pred) == F.col(gold), F.lit(False))
    known = F.col(gold).isNotNull()
    return out.withColumn("fine", F.when(known, same)).withColumn("coarse", F.when(known, same | F.coalesce("_up", F.lit(False)))).drop("_up")


def typed_closure(edges: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """Ancestors along paths that stay on nodes of one type; types: term, type."""
    of = types.where(F.col("type") == kind).select("term")
    kept = edges.join(of.withColumnRenamed("term", "child"), "child", "left_semi").join(of.withColumnRenamed("term", "parent"), "parent", "left_semi")
    return closure(kept.select("child", "parent"))


def indent_tree(lines: DataFrame, order: str, depth: str, name: str, tree: str) -> DataFrame:
    """name and parent of an indent-coded tree: the last line before it that is one level up, within its tree."""
    levels = [r[0] for r in lines.select(depth).distinct().orderBy(depth).collect()]  # a level a depth: few
    w = Window.partitionBy(tree).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for d in levels:
        parent = F.when(F.col(depth) == d, F.last(F.when(F.col(depth) == d - 1, F.col(name)), ignorenulls=True).over(w)).otherwise(parent)
    return lines.select(name, parent.alias("parent"))


def same_type(left: DataFrame, right: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """key and whether any term of its left set is, or lies over or under, one of its right set; for keys with both sets."""
    left, right = (side.repartition(key) for side in (left, right))  # all that follows goes by key
    up = sent(closed.select("term", "ancestor"))
    both = left.select(key).distinct().join(right.select(key).distinct(), key)

    def under(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(up, "term").join(b.select(key, F.col("term").alias("ancestor")), [key, "ancestor"]).select(key)

    hit = under(left, right).unionByName(under(right, left)).distinct().withColumn("_hit", F.lit(True))
    return both.join(hit, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("same"))
