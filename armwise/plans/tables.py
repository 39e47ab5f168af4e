"""Registered queries that are whole scorings: the tables that a run's records come to, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions import stats as A
from armwise.functions import text as T
from armwise.operators import metrics as M
from armwise.operators import pairing as P
from armwise.operators import resample as R
from armwise.plans import scoring
from armwise.plans.answers import OPTED, ORACLE_SQL_OF_OPTIONS, opted
from armwise.plans.catalog import ARMS, NORMAL, PICK, SCORES, TERMS, Tables, answers, arm_pairs, candidate_scores, query, term_sets
from armwise.sources import writers as W

LABELS = ("the", "that", "tion", "than", "est", "de la")


def interval_sql(rows: str, by: str, value: str, order: str, n: int, salt: str = "boot") -> str:
    """CTEs iv(by, ci_low, ci_high): the bounds, by index, of n bootstrap means of value over rows."""
    return f"""ip AS (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS m FROM {rows}),
ik AS (SELECT {by}, d AS draw, {PICK.format(f"'{salt}|' || d || '|' || i")} % m AS i FROM ip, range({n}) r(d)), ib AS (SELECT ik.{by}, draw, sum(v) / count(*)::DOUBLE AS m FROM ik JOIN ip ON ik.{by} = ip.{by} AND ik.i = ip.i GROUP BY 1, 2),
iv AS (SELECT {by}, list_sort(list(m))[{int(0.025 * n) + 1}] AS ci_low, list_sort(list(m))[{min(n - 1, int(0.975 * n)) + 1}] AS ci_high FROM ib GROUP BY 1)"""


def with_interval(table: DataFrame, rows: DataFrame, by: str, value: str, order: str, n: int) -> DataFrame:
    return table.join(R.interval(R.bootstrap_mean(rows, [by], value, [order], n), [by], "mean", n), by)


@query(f"""WITH l AS (SELECT unnest([{', '.join(repr(x) for x in LABELS)}]) AS label), x AS (SELECT conv_id * 100 + turn AS k, role, [{', '.join(repr(x) for x in LABELS)}][(conv_id % 6 + 1)::INT] AS gold, {NORMAL.format('text')} AS n FROM conversations),
h AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY length(label) DESC, label) AS r FROM x JOIN l ON contains(n, label)), a AS (SELECT x.k, role, label AS pred, gold, coalesce(label = gold, false)::INT AS hit FROM x LEFT JOIN h ON h.k = x.k AND r = 1),
{interval_sql('a', 'role', 'hit', 'k', 100)}, t AS (SELECT role, count(*) AS n, sum((pred IS NULL)::INT)::BIGINT AS unmapped, sum(hit)::BIGINT AS n_correct FROM a GROUP BY 1)
SELECT role, n, unmapped, n_correct, n_correct / n::DOUBLE AS accuracy, n_correct / nullif(n - unmapped, 0)::DOUBLE AS accuracy_answered, ci_low, ci_high FROM t JOIN iv USING (role)""")
def score_dna(t):
    c = t("conversations").withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    labels = c.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    gold = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("conv_id") % 6).cast("int"))
    a = c.select("k", "role", gold.alias("gold")).join(T.mapped_labels(c, labels, "k", F.col("text")), "k")
    hits = a.withColumn("hit", F.coalesce((F.col("pred") == F.col("gold")).cast("long"), F.lit(0)))
    return with_interval(M.label_accuracy(a, "role"), hits, "role", "hit", "k", 100)


@query(f"""WITH q AS ({ORACLE_SQL_OF_OPTIONS}), p AS ({OPTED}), x AS (SELECT q.k, option, kind, opts, opts[(q.k % 4 + 1)::INT] AS gold FROM q JOIN p ON p.k = q.k)
SELECT count(*) AS n, sum((option = gold)::INT)::BIGINT AS n_correct, sum((kind <> 'none')::INT)::BIGINT AS in_options, sum((option = opts[1])::INT)::BIGINT AS first_option, sum((option = opts[4])::INT)::BIGINT AS last_option, count(DISTINCT option) AS "distinct", 0.25::DOUBLE AS chance FROM x""")
def score_mcq(t):
    o = opted(t).select("k", "opts", T.parsed_option(F.col("said"), F.col("opts")).alias("x")).withColumn("gold", F.get("opts", (F.col("k") % 4).cast("int")))
    option = F.col("x.option")
    return o.agg(
        F.count(F.lit(1)).alias("n"), M.count_if(option == F.col("gold")).alias("n_correct"), M.count_if(F.col("x.kind") != "none").alias("in_options"), M.count_if(option == F.col("opts")[0]).alias("first_option"),
        M.count_if(option == F.col("opts")[3]).alias("last_option"), F.count_distinct(option).alias("distinct"), F.avg(1 / F.size("opts")).alias("chance"),
    )


ARM_SCORES = """ac AS (SELECT o_custkey AS cell, o_orderstatus AS arm, p_type AS cand, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell, arm ORDER BY score DESC, cand) AS r, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][(cell % 6 + 1)::INT] AS label FROM ac), wt AS (SELECT cell, cand AS top FROM rk WHERE arm = 'F' AND r = 1)"""


def arm_scores(t: Tables) -> DataFrame:
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    sc = j.groupBy(F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("arm"), F.col("p_type").alias("cand")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("score"))
    names = F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    order = Window.partitionBy("cell", "arm").orderBy(F.desc("score"), "cand")
    return sc.withColumn("r", F.row_number().over(order)).withColumn("label", F.get(names, (F.col("cell") % 6).cast("int")))


@query(f"""WITH {ARM_SCORES} SELECT arm, count(DISTINCT rk.cell) AS cells, sum((r <= 1 AND cand = label)::INT)::BIGINT AS right_1, sum((r <= 3 AND cand = label)::INT)::BIGINT AS right_3, sum((r <= 1 AND cand = top)::INT)::BIGINT AS same_1, sum((r <= 3 AND cand = top)::INT)::BIGINT AS same_3 FROM rk LEFT JOIN wt USING (cell) GROUP BY 1""")
def score_singlecell(t):
    rk = arm_scores(t)
    wt = rk.where("arm = 'F' and r = 1").select("cell", F.col("cand").alias("top"))
    j = rk.join(wt, "cell", "left")
    hit = {f"{n}_{k}": (F.col("r") <= k) & (F.col("cand") == F.col(c)) for n, c in (("right", "label"), ("same", "top")) for k in (1, 3)}
    return j.groupBy("arm").agg(F.count_distinct("cell").alias("cells"), *[M.count_if(c).alias(n) for n, c in hit.items()])


@query(f"""WITH {TERMS}, p AS (SELECT a.user_id, a.arm, a.terms AS x, r.terms AS y FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view'),
d AS (SELECT user_id, arm, (x = y)::INT AS kept, 1000 * len(list_intersect(x, y)) // len(list_distinct(list_concat(x, y))) AS j FROM p), {interval_sql('d', 'arm', 'kept', 'user_id', 100)}
SELECT arm, count(*) AS n, sum(kept)::BIGINT AS retained, sum(j)::BIGINT AS jaccard_e3, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM d JOIN iv USING (arm) GROUP BY 1""")
def score_protein(t):
    p = P.paired_with_reference(term_sets(t), "user_id", "arm", "view", ["terms"])
    x, y = F.col("terms"), F.col("ref_terms")
    d = p.select("user_id", "arm", A.same_set(x, y).cast("long").alias("kept"), F.floor(1000 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) + 1e-9).cast("long").alias("j"))
    table = d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("kept").alias("retained"), F.sum("j").alias("jaccard_e3"))
    return with_interval(table, d, "arm", "kept", "user_id", 100)


@query(f"""WITH {TERMS}, s AS (SELECT user_id, arm, list_contains(terms, 't1') AND NOT list_contains(terms, 'zz') AS own, list_contains(terms, 't2') AS other FROM sets), g AS (SELECT user_id FROM s WHERE arm = 'view' AND own)
SELECT arm, count(*) AS gated, sum(own::INT)::BIGINT AS retained, sum((NOT own AND other)::INT)::BIGINT AS overridden, sum((NOT own AND NOT other)::INT)::BIGINT AS neither FROM s JOIN g USING (user_id) WHERE arm <> 'view' GROUP BY 1""")
def score_protein_pairs(t):
    s = term_sets(t).select("user_id", "arm", (F.array_contains("terms", "t1") & ~F.array_contains("terms", "zz")).alias("own"), F.array_contains("terms", "t2").alias("other"))
    met = s.where("arm <> 'view'").join(s.where("arm = 'view' and own").select("user_id"), "user_id", "left_semi")
    return met.groupBy("arm").agg(F.count(F.lit(1)).alias("gated"), M.count_if(F.col("own")).alias("retained"), M.count_if(~F.col("own") & F.col("other")).alias("overridden"), M.count_if(~F.col("own") & ~F.col("other")).alias("neither"))


@query(f"""WITH {ARMS}, acc AS (SELECT arm, count(*) AS answered, sum(correct::INT)::BIGINT AS n_correct FROM ans GROUP BY 1), x AS (SELECT arm, count(*) AS n, sum((pred <> ref_pred)::INT)::BIGINT AS changed, sum((ref_pred = gold AND pred <> gold)::INT)::BIGINT AS lost, sum((ref_pred <> gold AND pred = gold)::INT)::BIGINT AS won FROM pairs GROUP BY 1)
SELECT arm, answered, n_correct, n, changed, lost, won, CASE WHEN changed * 2 < n THEN 'FAIL change' ELSE 'PASS' END AS verdict FROM acc JOIN x USING (arm)""")
def score_bioreason(t):
    a = answers(t)
    gates = M.validity_gates(a, "view", "arm", "user_id", "pred", "gold").select("arm", "verdict")
    moved = M.transitions(arm_pairs(t), ["arm"], "ref_pred", "pred", "gold").select("arm", "n", "changed", F.col("right_to_wrong").alias("lost"), F.col("wrong_to_right").alias("won"))
    right = M.arm_accuracy(a).select("arm", F.col("n").alias("answered"), "n_correct")
    return right.join(moved, "arm").join(gates, "arm")


@query("""WITH x AS (SELECT l_linenumber AS k, l_returnflag AS arm, count(*) AS n, sum((l_quantity > 25)::INT)::BIGINT AS hits FROM lineitem GROUP BY 1, 2), w AS (SELECT k, max(hits / n::DOUBLE) FILTER (arm = 'A') AS matched, max(hits / n::DOUBLE) FILTER (arm = 'R') AS top, max(hits / n::DOUBLE) FILTER (arm = 'N') AS other FROM x GROUP BY 1)
SELECT k, matched, top, other, matched - top AS gap, top - other AS against_random, CASE WHEN matched > 0.25::DOUBLE THEN greatest(0, top - 0.25::DOUBLE) / (matched - 0.25::DOUBLE) END AS adjusted FROM w""")
def analyze_deg_removal(t):
    li = t("lineitem").select(F.col("l_linenumber").alias("k"), "l_returnflag", (F.col("l_quantity") > 25).cast("long").alias("h"))
    w = li.groupBy("k").agg(*[(F.sum(F.when(F.col("l_returnflag") == f, F.col("h"))) / F.count(F.when(F.col("l_returnflag") == f, F.lit(1)))).alias(n) for f, n in (("A", "matched"), ("R", "top"), ("N", "other"))])
    adjusted = F.when(F.col("matched") > 0.25, F.greatest(F.lit(0.0), F.col("top") - 0.25) / (F.col("matched") - 0.25))
    return w.select("k", "matched", "top", "other", (F.col("matched") - F.col("top")).alias("gap"), (F.col("top") - F.col("other")).alias("against_random"), adjusted.alias("adjusted"))


@query(f"""WITH {ARMS}, g AS (SELECT *, user_id % 3 AS stratum, user_id % 4 > 0 AS gate FROM pairs) SELECT arm, stratum, count(*) AS n, sum((pred = (ref_pred + 1) % 5)::INT)::BIGINT AS donor, sum((pred <> (ref_pred + 1) % 5 AND pred = ref_pred)::INT)::BIGINT AS original,
(count(*) - sum((pred = (ref_pred + 1) % 5 OR pred = ref_pred)::INT))::BIGINT AS neither FROM g WHERE gate GROUP BY 1, 2 HAVING count(*) >= 3""")
def analyze_text_conflict(t):
    pairs = arm_pairs(t).withColumn("stratum", F.col("user_id") % 3).withColumn("gate", F.col("user_id") % 4 > 0).withColumn("other", (F.col("ref_pred") + 1) % 5)
    return scoring.score_conflicts(pairs, ["arm", "stratum"], "pred", "other", "ref_pred", "gate").where("n >= 3")


@query(f"""WITH {TERMS}, p AS (SELECT a.user_id % 5 AS atlas, len(list_intersect(a.terms, r.terms)) AS kept, len(r.terms) - len(list_intersect(a.terms, r.terms)) AS removed, len(a.terms) - len(list_intersect(a.terms, r.terms)) AS fresh FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm = 'click')
SELECT atlas, count(*) AS cells, sum(kept)::BIGINT AS kept, sum(removed)::BIGINT AS removed, sum(fresh)::BIGINT AS fresh, sum(kept)::BIGINT / greatest(sum(kept + removed)::DOUBLE, 1e-12) AS retained FROM p GROUP BY GROUPING SETS ((atlas), ())""")
def analyze_rationale_removal(t):
    p = P.paired_with_reference(term_sets(t).where(F.col("arm").isin("view", "click")), "user_id", "arm", "view", ["terms"])
    x, y = F.col("terms"), F.col("ref_terms")
    counts = p.select((F.col("user_id") % 5).alias("atlas"), F.size(F.array_intersect(x, y)).alias("kept"), F.size(F.array_except(y, x)).alias("removed"), F.size(F.array_except(x, y)).alias("fresh"))
    out = counts.rollup("atlas").agg(F.count(F.lit(1)).alias("cells"), *[F.sum(c).alias(c) for c in ("kept", "removed", "fresh")])
    return out.withColumn("retained", A.ratio(F.col("kept"), F.col("kept") + F.col("removed")))


@query("""WITH x AS (SELECT o_custkey AS c, o_orderkey, o_orderstatus = 'F' AS cited, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, (o_orderpriority < '3')::INT AS deg FROM orders)
SELECT least(9, i * 10 // n)::BIGINT AS decile, deg, count(*) AS slots, sum(cited::INT)::BIGINT AS cited, sum(cited::INT) / greatest(count(*)::DOUBLE, 1e-12) AS rate FROM x GROUP BY GROUPING SETS ((least(9, i * 10 // n)::BIGINT, deg), (least(9, i * 10 // n)::BIGINT), (deg), ())""")
def analyze_rationale_order(t):
    w = Window.partitionBy("o_custkey")
    x = t("orders").select((F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), (F.col("o_orderstatus") == "F").alias("h"), (F.col("o_orderpriority") < "3").cast("int").alias("deg"))
    out = x.cube(A.decile(F.col("i"), F.col("n")).alias("decile"), "deg").agg(F.count(F.lit(1)).alias("slots"), M.count_if(F.col("h")).alias("cited"))
    return out.withColumn("rate", A.ratio(F.col("cited"), F.col("slots")))


@query(f"""WITH {ARMS} SELECT arm, cluster % 4 AS panel, count(*) AS n, sum((pred <> ref_pred)::INT)::BIGINT AS changed, sum((ref_pred = gold AND pred <> gold)::INT)::BIGINT AS right_to_wrong, sum((ref_pred <> gold AND pred = gold)::INT)::BIGINT AS wrong_to_right FROM pairs GROUP BY 1, 2""")
def answer_change_panels(t):
    p = arm_pairs(t).withColumn("panel", F.col("cluster") % 4)
    return M.transitions(p, ["arm", "panel"], "ref_pred", "pred", "gold").select("arm", "panel", "n", "changed", "right_to_wrong", "wrong_to_right")


@query(f"""WITH s AS (SELECT p_name, count(DISTINCT p_brand) AS variants, count(DISTINCT p_type) AS labels FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1), m AS (SELECT p_name, p_type, count(*) AS c, max(count(*)) OVER (PARTITION BY p_name) AS most FROM part GROUP BY 1, 2)
SELECT CASE WHEN labels > 1 THEN 'sensitivity' ELSE 'stability' END AS stratum, count(DISTINCT s.p_name) AS groups, sum(c)::BIGINT AS rows_in, sum(CASE WHEN c = most THEN c ELSE 0 END)::BIGINT AS at_mode FROM s JOIN m USING (p_name) GROUP BY 1""")
def genome_dependent_strata(t):
    strata = M.group_strata(t("part"), "p_name", "p_brand", "p_type").select("p_name", "stratum")
    counts = t("part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("most", F.max("c").over(Window.partitionBy("p_name")))
    return counts.join(strata, "p_name").groupBy("stratum").agg(F.count_distinct("p_name").alias("groups"), F.sum("c").alias("rows_in"), F.sum(F.when(F.col("c") == F.col("most"), F.col("c")).otherwise(0)).alias("at_mode"))


ATLAS = "SELECT l_suppkey % 5 AS g, l_suppkey % 40 AS u, count(*) AS n, sum((l_returnflag = 'A')::INT)::BIGINT AS a, sum((l_returnflag = 'R')::INT)::BIGINT AS b FROM lineitem GROUP BY 1, 2"


@query(f"""WITH un AS ({ATLAS}), pl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY g) AS size FROM un), pk AS (SELECT g, d AS draw, {PICK.format("'c2s|' || d || '|' || i")} % size AS i FROM pl, range(100) r(d)),
s AS (SELECT pk.g, draw, (sum(a) - sum(b)) / sum(n)::DOUBLE AS x FROM pk JOIN pl ON pl.g = pk.g AND pl.i = pk.i GROUP BY 1, 2) SELECT draw, round(avg(x) * 1e9)::BIGINT AS macro_e9 FROM s GROUP BY 1""")
def c2s_bootstraps(t):
    li = t("lineitem")
    u = li.groupBy((F.col("l_suppkey") % 5).alias("g"), (F.col("l_suppkey") % 40).alias("u")).agg(F.count(F.lit(1)).alias("n"), M.count_if(F.col("l_returnflag") == "A").alias("a"), M.count_if(F.col("l_returnflag") == "R").alias("b"))
    s = R.weighted_sums(u, R.unit_weights(u, ["g"], "u", 100, "c2s"), ["g"], "u", ["n", "a", "b"])
    return s.groupBy(F.col("draw").cast("long").alias("draw")).agg(F.round(F.avg((F.col("a") - F.col("b")) / F.col("n")) * 1e9).cast("long").alias("macro_e9"))


@query("""WITH x AS (SELECT p_brand AS g, p_size::BIGINT AS s, p_type < 'M' AS p FROM part), t AS (SELECT g, s, count(*) AS n, sum(p::INT) AS k FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
a AS (SELECT g, sum(n) AS n, sum(k) AS k, sum(k * (2 * b + n + 1)) AS r FROM c GROUP BY g), f AS (SELECT (r - k * (k + 1))::BIGINT / (2 * k * (n - k))::DOUBLE AS auroc FROM a WHERE k > 0 AND n > k) SELECT count(*) AS families, round(avg(auroc) * 1e9)::BIGINT AS auroc_e9 FROM f""")
def family_table(t):
    x = t("part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("long").alias("s"), (F.col("p_type") < "M").alias("p"))
    return M.auroc(x, ["g"], "s", "p").agg(F.count(F.lit(1)).alias("families"), F.round(F.avg("auroc") * 1e9).cast("long").alias("auroc_e9"))


@query("""WITH c AS (SELECT role, text, conv_id % 2 AS label, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS s FROM conversations) SELECT role, count(*) AS n, sum(length(text))::BIGINT AS letters, sum(length(text) - length(translate(text, 'ae', '')))::BIGINT AS chosen, sum((label = 1)::INT)::BIGINT AS positives FROM c GROUP BY 1""")
def chatnt_task_stats(t):
    c = t("conversations")
    chosen = F.length("text") - F.length(F.translate("text", "ae", ""))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("letters"), F.sum(chosen).cast("long").alias("chosen"), M.count_if(F.col("conv_id") % 2 == 1).alias("positives"))


@query("""WITH g AS (SELECT doc_id, quality FROM labels), x AS (SELECT d.doc_id, d.source, g.quality FROM documents d LEFT JOIN g USING (doc_id)) SELECT source, count(*) AS asked, sum((quality IS NULL)::INT)::BIGINT AS missing, sum((quality = 1)::INT)::BIGINT AS matched, sum((quality = 1)::INT)::BIGINT / nullif(count(quality), 0)::DOUBLE AS rate FROM x GROUP BY 1""")
def prot2text_tasks(t):
    x = P.with_missing(t("documents").select("doc_id", "source"), t("labels").select("doc_id", "quality"), ["doc_id"], "quality")
    out = x.groupBy("source").agg(F.count(F.lit(1)).alias("asked"), M.count_if(F.col("missing")).alias("missing"), M.count_if(F.col("quality") == 1).alias("matched"))
    return out.withColumn("rate", M.share("matched", F.col("asked") - F.col("missing")))


@query(f"""WITH {SCORES}, m AS (SELECT cell, max(score) FILTER (cand = label) - max(score) FILTER (cand <> label) AS margin FROM lab GROUP BY cell)
SELECT CASE WHEN margin > 1000000 THEN 'input' WHEN margin < -1000000 THEN 'text' ELSE 'ambiguous' END AS follows, count(*) AS cells, min(margin) AS least, max(margin) AS most FROM m GROUP BY 1""")
def cellwhisperer_follow(t):
    m = M.margins(candidate_scores(t), ["cell"], "cand", "score", "label")
    return m.groupBy(scoring.follow_class("margin", 1_000_000).alias("follows")).agg(F.count(F.lit(1)).alias("cells"), F.min("margin").alias("least"), F.max("margin").alias("most"))


@query("""WITH s AS (SELECT o_orderstatus AS condition, o_orderkey % 3 AS seed, sum((o_custkey % 4 = 0)::INT)::BIGINT AS hits, count(*) AS n FROM orders GROUP BY 1, 2) SELECT condition, count(*) AS seeds, round(avg(hits / n::DOUBLE) * 1e9)::BIGINT AS mean_e9, round(stddev_samp(hits / n::DOUBLE) * 1e9)::BIGINT AS sd_e9, round(stddev_samp(hits / n::DOUBLE) / sqrt(count(*)) * 1e9)::BIGINT AS sem_e9 FROM s GROUP BY 1""")
def auxiliary_seeds(t):
    s = t("orders").groupBy(F.col("o_orderstatus").alias("condition"), (F.col("o_orderkey") % 3).alias("seed")).agg((M.count_if(F.col("o_custkey") % 4 == 0) / F.count(F.lit(1))).alias("rate"))
    return s.groupBy("condition").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("rate") * 1e9).cast("long").alias("mean_e9"), F.round(F.stddev_samp("rate") * 1e9).cast("long").alias("sd_e9"), F.round(F.stddev_samp("rate") / F.sqrt(F.count(F.lit(1))) * 1e9).cast("long").alias("sem_e9"))


@query(f"""WITH {ARMS}, a AS (SELECT 'accuracy' AS panel, arm AS series, sum(correct::INT) / count(*)::DOUBLE AS value, count(*) AS n FROM ans GROUP BY 2), c AS (SELECT 'changed', arm, sum((pred <> ref_pred)::INT) / count(*)::DOUBLE, count(*) FROM pairs GROUP BY 2)
SELECT 'rq1' AS figure, panel, series, value, n FROM (SELECT * FROM a UNION ALL SELECT * FROM c)""")
def figure_numbers(t):
    a = W.metric_long(M.arm_accuracy(answers(t)), "rq1", "accuracy", "arm", F.lit(""), "accuracy", "n")
    c = W.metric_long(M.transitions(arm_pairs(t), ["arm"], "ref_pred", "pred", "gold"), "rq1", "changed", "arm", F.lit(""), "change_rate", "n", ("wilson_low", "wilson_high"))
    return W.all_metrics([a, c]).select("figure", "panel", "series", "value", "n")
