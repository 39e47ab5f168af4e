"""Registered queries of sequential matching and of linear probes that share their passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwise.operators import matching as X
from armwise.operators import probe_fits as Q
from armwise.operators import resample as R
from armwise.plans.catalog import PICK, query

# SQL walks each customer's orders one after the other; customers have few.
@query("""WITH RECURSIVE t AS (SELECT o_custkey AS g, o_orderkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT o_custkey AS g, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F'),
w AS (SELECT DISTINCT g, 0::BIGINT AS r, []::BIGINT[] AS used, NULL::BIGINT AS control FROM t
 UNION ALL (SELECT g, r, list_append(used, c), c FROM (SELECT w.g, w.r + 1 AS r, w.used, arg_min(p.k, (abs(p.v - t.v), (p.v >= t.v)::INT, CASE WHEN p.v < t.v THEN -p.k ELSE p.k END))::BIGINT AS c
  FROM w JOIN t ON t.g = w.g AND t.r = w.r + 1 LEFT JOIN p ON p.g = w.g AND NOT list_contains(w.used, p.k) GROUP BY w.g, w.r, w.used)))
SELECT t.g AS o_custkey, t.k AS o_orderkey, w.control, abs(p.v - t.v) AS distance FROM t JOIN w ON w.g = t.g AND w.r = t.r LEFT JOIN p ON p.k = w.control""")
def jn14_nearest_unused(t):
    o = t("orders")
    got = X.in_order(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey"], "o_orderkey", "o_totalprice", ["o_orderpriority"])
    return got.select("o_custkey", "o_orderkey", "control", "distance")


@query()
def jn14_hot_groups(t):
    """Three groups of a third of all lines each: every one lies over many ranges."""
    li = t("lineitem").withColumns({"turn": -F.col("l_quantity"), "line": F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})
    got = X.in_order(li.where("l_quantity > 40"), li.where("l_quantity <= 40"), ["l_returnflag"], "line", "l_extendedprice", ["turn"])
    return got.select("l_returnflag", "line", "control", "distance")


# How many pairs there are follows from the groups' sizes alone.
@query("""WITH c AS (SELECT l_returnflag, sum((l_quantity > 40)::INT)::BIGINT AS t, sum((l_quantity <= 40)::INT)::BIGINT AS p FROM lineitem GROUP BY 1)
SELECT l_returnflag, t AS targets, least(t, p) AS pairs, least(t, p) AS controls FROM c""")
def jn14_one_to_one(t):
    got = jn14_hot_groups(t)
    return got.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("targets"), F.count("control").alias("pairs"), F.count_distinct("control").alias("controls"))


# Which pairs are cheapest is no SQL; how many there are, and that every row comes back once, is.
@query("""WITH c AS (SELECT c_nationkey, sum((c_mktsegment = 'BUILDING')::INT)::BIGINT AS l, sum((c_mktsegment IN ('MACHINERY', 'FURNITURE'))::INT)::BIGINT AS r FROM customer GROUP BY 1)
SELECT c_nationkey, l + r AS n, 2 * least(l, r) AS paired, least(l, r) AS partners, l + r - 2 * least(l, r) AS unmatched FROM c WHERE l + r > 0""")
def jn13_assignment_counts(t):
    got = jn13_assignment(t)
    return got.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("partner").alias("paired"), F.count_distinct(F.when(F.col("side") == "left", F.col("partner"))).alias("partners"), F.sum(F.col("partner").isNull().cast("long")).alias("unmatched"))


@query()
def jn13_assignment(t):
    """Sides of unlike sizes in each nation, by balance and, at a thousand a step, by a second number."""
    c = t("customer").withColumn("step", F.col("c_custkey") % 3)
    return X.assigned(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment IN ('MACHINERY', 'FURNITURE')"), ["c_nationkey"], "c_custkey", {"c_acctbal": 1.0, "step": 1000.0})


def _labelled(t):
    return t("embeddings").select("vec_id", (F.col("vec_id") % 50).alias("family"), "embedding", "label", (F.col("label") >= 5).cast("int").alias("y"))


@query()
def ml4_out_of_fold(t):
    """Out-of-fold scores of the labels and of 20 null labelings, from the same passes."""
    return Q.probe(_labelled(t), "vec_id", "family", "embedding", "y", k=5, draws=20, stratify=False).select("key", "group", "draw", "y", "score")


@query()
def ml4_permuted_null(t):
    scores = Q.probe(_labelled(t), "vec_id", "family", "embedding", "y", k=5, draws=20, stratify=False)
    return Q.null_summary(Q.family_auroc(scores, ["draw"], "group"))


# The area within families of any score: here the first component.
@query("""WITH s AS (SELECT vec_id % 50 AS family, embedding[1]::DOUBLE AS s, label >= 5 AS y FROM embeddings),
r AS (SELECT family, y, rank() OVER (PARTITION BY family ORDER BY s) + (count(*) OVER (PARTITION BY family, s) - 1) / 2.0::DOUBLE AS r FROM s),
a AS (SELECT family, count(*) AS n, sum(y::INT)::BIGINT AS n1, sum(CASE WHEN y THEN r ELSE 0 END) AS r1 FROM r GROUP BY 1)
SELECT family, n, n1, round((r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)) * 1e9)::BIGINT AS auroc_e9 FROM a WHERE n1 > 0 AND n1 < n""")
def ml4_family_auroc(t):
    s = _labelled(t).withColumn("score", F.col("embedding")[0].cast("double"))
    return Q.family_auroc(s, [], "family", positive=F.col("y") == 1).select("family", "n", "n1", F.round(F.col("auroc") * 1e9).cast("long").alias("auroc_e9"))


# Every family lies in one fold, every class is in all folds, and none is off its even share by more than a heavy group.
@query("""SELECT label, count(*) AS n, count(DISTINCT vec_id % 50) AS families, 5::BIGINT AS folds, true AS even FROM embeddings GROUP BY label""")
def ml1_stratified_folds(t):
    e = _labelled(t)
    folds = Q.group_folds(e, "family", "label", 5)
    rows = e.join(folds, "family")
    most = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.max("c").alias("most"))
    per = rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("family").alias("f"))
    even = per.groupBy("label").agg(F.sum("c").alias("n"), F.sum("f").alias("families"), F.count(F.lit(1)).alias("folds"), F.max("c").alias("hi"), F.min("c").alias("lo"))
    # families in folds add up to the distinct families only if none is split
    return even.join(most, "label").select("label", "n", "families", "folds", ((F.col("hi") - F.col("lo")) <= 2 * F.col("most")).alias("even"))


@query()
def ml1_class_probe(t):
    """Ten classes over stratified folds of whole families, with the commonest class's rate and a null labeling as control."""
    rows = Q.large_classes(_labelled(t), "label", 5)
    scores = Q.probe(rows, "vec_id", "family", "embedding", "label", k=5, draws=1)
    folds = Q.group_folds(rows.select(F.col("family").alias("group"), F.col("label").cast("double").alias("y")), "group", "y", 5, "fold0")
    held = rows.select(F.col("vec_id").alias("key"), F.col("family").alias("group"), F.col("label").alias("y"))
    return Q.fold_accuracy(held, scores, held.join(folds, "group").select("key", "fold"))


@query()
def ml3_probe_over_seeds(t):
    """Hits of a probe, seed by seed over ten seeds of grouped folds, all fitted in the same passes."""
    scores = Q.probe(_labelled(t), "vec_id", "family", "embedding", "y", k=5, seeds=range(10))
    return Q.decided(scores).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


def _family_rows(per, draws: int):
    """cat, arm, families, mean area and an interval from resampled families; cat -1 pools all categories' families."""
    named = per.withColumn("fam", F.concat_ws(":", F.col("cat").cast("string"), F.col("family").cast("string")))
    every = named.unionByName(named.withColumn("cat", F.lit(-1).cast("long"))).withColumn("one", F.lit(1).cast("long"))
    drawn = R.resampled(every, ["cat", "arm"], ["fam"], ["auroc", "one"], draws, "families").withColumn("m", F.col("auroc") / F.col("one"))
    own = every.groupBy("cat", "arm").agg(F.count(F.lit(1)).alias("families"), F.avg("auroc").alias("mean"))
    return own.join(R.interpolated_interval(drawn, ["cat", "arm"], "m"), ["cat", "arm"])


_ARMS = [("first", 0), ("second", 1), ("last", 63)]


@query(f"""WITH s AS (SELECT vec_id % 4 AS cat, vec_id % 50 AS family, label >= 5 AS y, unnest([{{'arm': 'first', 's': embedding[1]::DOUBLE}}, {{'arm': 'second', 's': embedding[2]::DOUBLE}}, {{'arm': 'last', 's': embedding[64]::DOUBLE}}], recursive := true) FROM embeddings),
r AS (SELECT cat, family, arm, y, rank() OVER (PARTITION BY cat, family, arm ORDER BY s) + (count(*) OVER (PARTITION BY cat, family, arm, s) - 1) / 2.0::DOUBLE AS r FROM s),
a AS (SELECT cat, family, arm, (sum(CASE WHEN y THEN r ELSE 0 END) - sum(y::INT) * (sum(y::INT) + 1) / 2.0::DOUBLE) / (sum(y::INT) * (count(*) - sum(y::INT))) AS v FROM r GROUP BY 1, 2, 3 HAVING sum(y::INT) > 0 AND sum(y::INT) < count(*)),
u AS (SELECT cat, arm, cat || ':' || family AS fam, v FROM a UNION ALL SELECT -1, arm, cat || ':' || family, v FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY cat, arm ORDER BY fam) - 1 AS i, count(*) OVER (PARTITION BY cat, arm) AS n FROM u),
k AS (SELECT cat, arm, d, {PICK.format("'families|' || d || '|' || i")} % n AS i FROM p, range(100) x(d)), m AS (SELECT k.cat, k.arm, k.d, sum(p.v) / count(*) AS m FROM k JOIN p ON k.cat = p.cat AND k.arm = p.arm AND k.i = p.i GROUP BY ALL)
SELECT cat, arm, families, mean_e6, low_e6, high_e6 FROM (SELECT cat, arm, count(*) AS families, round(avg(v) * 1e6)::BIGINT AS mean_e6 FROM u GROUP BY 1, 2) JOIN (SELECT cat, arm, round(quantile_cont(m, 0.025) * 1e6)::BIGINT AS low_e6, round(quantile_cont(m, 0.975) * 1e6)::BIGINT AS high_e6 FROM m GROUP BY 1, 2) USING (cat, arm)""")
def family_table_arms(t):
    """The family table: for every property and for all, each arm's area within families and its interval over families."""
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col("embedding")[i].cast("double").alias("score")) for a, i in _ARMS])
    rows = _labelled(t).select((F.col("vec_id") % 4).alias("cat"), "family", "y", F.explode(arms).alias("a")).select("cat", "family", "y", "a.*")
    out = _family_rows(Q.family_auroc(rows, ["cat", "arm"], "family", positive=F.col("y") == 1), 100)
    return out.select("cat", "arm", "families", *[F.round(F.col(c) * 1e6).cast("long").alias(n) for c, n in (("mean", "mean_e6"), ("ci_low", "low_e6"), ("ci_high", "high_e6"))])


@query()
def family_table_probe(t):
    """The same table for the probe: its own out-of-fold scores and twenty null labelings, from the passes that fit them all."""
    scores = Q.probe(_labelled(t), "vec_id", "family", "embedding", "y", k=5, draws=20, stratify=False).withColumn("cat", F.col("key") % 4).withColumnRenamed("group", "family")
    per = Q.family_auroc(scores, ["cat", "draw"], "family")
    own = _family_rows(per.where("draw < 0").select("cat", F.lit("probe").alias("arm"), "family", "auroc"), 100)
    null = per.where("draw >= 0").groupBy("cat", "draw").agg(F.avg("auroc").alias("m")).groupBy("cat").agg(F.avg("m").alias("null_mean"), F.stddev_pop("m").alias("null_sd"))
    return own.join(null, "cat", "left")
