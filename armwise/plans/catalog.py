"""The registered queries: each operator applied to whole tables of the test schema, next to DuckDB SQL for the same rows.

Entities are users with an arm an event type (the last event of each counts), customers with an arm an order status, parts as
texts with brands and types, documents and conversations as texts, nations and regions as an ontology.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.functions import stats as A
from armwise.functions import text as T
from armwise.operators import metrics as M
from armwise.operators import ontology as O
from armwise.operators import pairing as P
from armwise.operators import resample as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# Shared inputs, once as DataFrames and once as SQL.
ARMS = """arms AS (SELECT user_id, event_type AS arm, value, ts, CAST(floor(value / 5) AS BIGINT) % 5 AS pred FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
gold AS (SELECT user_id, gold FROM (SELECT user_id, g AS gold, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, g) AS r FROM
 (SELECT user_id, CAST(floor(value / 5) AS BIGINT) % 5 AS g, count(*) AS c FROM events GROUP BY 1, 2)) WHERE r = 1),
ans AS (SELECT a.*, g.gold, a.pred = g.gold AS correct, a.user_id % 20 AS cluster FROM arms a JOIN gold g USING (user_id)),
pairs AS (SELECT a.user_id, a.arm, a.pred, a.gold, a.cluster, r.pred AS ref_pred FROM ans a JOIN ans r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view')"""
PICK = "('0x' || substr(md5({}), 1, 12))::BIGINT"
TERMS = """terms AS (SELECT DISTINCT user_id, event_type AS arm, unnest([('t' || (CAST(floor(value) AS BIGINT) % 7)), 'g' || (event_id % 3)]) AS term FROM events),
sets AS (SELECT user_id, arm, list_sort(list(term)) AS terms FROM terms GROUP BY 1, 2)"""
EDGES = """edges AS (SELECT DISTINCT p_name AS child, unnest(['a:' || split_part(p_name, ' ', 1), 'n:' || split_part(p_name, ' ', 2)]) AS parent FROM part
 UNION SELECT DISTINCT 'a:' || split_part(p_name, ' ', 1), 'root' FROM part UNION SELECT DISTINCT 'n:' || split_part(p_name, ' ', 2), 'root' FROM part),
closed AS (SELECT child AS term, parent AS ancestor, 1 AS distance FROM edges UNION SELECT p_name, 'root', 2 FROM part
 UNION SELECT child, child, 0 FROM edges UNION SELECT parent, parent, 0 FROM edges)"""


def bucket(c: str):
    return F.floor(F.col(c) / 5).cast("long") % 5


def answers(t: Tables) -> DataFrame:
    e = t("events")
    last = P.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("arm"), "value", "ts", bucket("value").alias("pred"))
    counts = e.groupBy("user_id", bucket("value").alias("g")).agg(F.count(F.lit(1)).alias("c"))
    gold = counts.groupBy("user_id").agg(F.min_by("g", F.struct((-F.col("c")).alias("c"), "g")).alias("gold"))
    return last.join(gold, "user_id").withColumn("correct", F.col("pred") == F.col("gold")).withColumn("cluster", F.col("user_id") % 20)


def arm_pairs(t: Tables) -> DataFrame:
    a = answers(t)
    return P.paired_with_reference(a, "user_id", "arm", "view", ["pred"]).join(a.select("user_id", "arm", "gold", "cluster"), ["user_id", "arm"])


def term_rows(t: Tables) -> DataFrame:
    e = t("events")
    both = F.array(F.concat(F.lit("t"), (F.floor("value").cast("long") % 7).cast("string")), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")))
    return e.select("user_id", F.col("event_type").alias("arm"), F.explode(both).alias("term")).distinct()


def term_sets(t: Tables) -> DataFrame:
    return term_rows(t).groupBy("user_id", "arm").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def edges(t: Tables) -> DataFrame:
    p = t("part").select("p_name").distinct()
    a, n = F.concat(F.lit("a:"), F.split_part("p_name", F.lit(" "), F.lit(1))), F.concat(F.lit("n:"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    up = p.select(F.col("p_name").alias("child"), F.explode(F.array(a, n)).alias("parent"))
    return up.unionByName(up.select(F.col("parent").alias("child"), F.lit("root").alias("parent"))).distinct()


# Aggregates over arms.
@query(f"WITH {ARMS} SELECT arm, count(*) AS n, sum((correct)::INT)::BIGINT AS n_correct, sum((correct)::INT) / count(*)::DOUBLE AS accuracy FROM ans GROUP BY arm")
def agg1_arm_accuracy(t):
    return M.arm_accuracy(answers(t))


@query(f"WITH {ARMS}, c AS (SELECT arm, cluster, avg(correct::INT) AS m FROM ans GROUP BY 1, 2) SELECT arm, count(*) AS clusters, CAST(round(avg(m) * 1e9) AS BIGINT) AS mean_e9 FROM c GROUP BY arm")
def agg2_cluster_mean(t):
    out = M.cluster_mean(answers(t).withColumn("c", F.col("correct").cast("int")), ["arm"], "cluster", "c")
    return out.select("arm", "clusters", F.round(F.col("mean") * 1e9).cast("long").alias("mean_e9"))


@query("SELECT l_returnflag, sum((l_linestatus = 'F')::BIGINT)::BIGINT AS top, sum(l_quantity::BIGINT)::BIGINT AS base, sum((l_linestatus = 'F')::BIGINT)::BIGINT / greatest(sum(l_quantity::BIGINT)::DOUBLE, 1e-12) AS ratio FROM lineitem GROUP BY 1")
def agg3_pooled_ratio(t):
    rows = t("lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").cast("long").alias("f"), F.col("l_quantity").cast("long").alias("q"))
    return M.pooled_ratio(rows, ["l_returnflag"], "f", "q")


@query("SELECT l_linestatus, sum(l_linenumber * l_quantity::BIGINT)::BIGINT / sum(l_quantity::BIGINT)::DOUBLE AS mean, sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY 1")
def agg4_weighted_mean(t):
    rows = t("lineitem").select("l_linestatus", F.col("l_linenumber").cast("long").alias("r"), F.col("l_quantity").cast("long").alias("w"))
    return M.weighted_mean(rows, ["l_linestatus"], "r", "w")


@query(f"WITH {ARMS}, g AS (SELECT arm, count(*) AS n, sum(correct::INT)::BIGINT AS k FROM ans GROUP BY arm) SELECT arm, n, k, k / n::DOUBLE AS rate FROM g UNION ALL SELECT NULL, sum(n)::BIGINT, sum(k)::BIGINT, sum(k) / sum(n)::DOUBLE FROM g")
def agg5_macro_and_pooled(t):
    return M.macro_and_pooled(answers(t), "arm", "correct").drop("macro")


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, f, o_orderpriority) AS rank FROM c) SELECT o_orderstatus, o_orderpriority, n, rank FROM r WHERE rank <= 3")
def agg6_top_counts(t):
    return M.most_common(t("orders"), ["o_orderstatus"], "o_orderpriority", "o_orderkey", 3).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH tr AS (SELECT * FROM part WHERE p_partkey % 2 = 0), te AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
m AS (SELECT p_name, p_type AS mode FROM (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_type) AS r FROM tr GROUP BY 1, 2) WHERE r = 1),
a AS (SELECT p_type AS mode FROM tr GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)
SELECT te.p_partkey, te.p_type, m.mode IS NOT NULL AS seen, coalesce(m.mode, a.mode) AS pred FROM te LEFT JOIN m USING (p_name) CROSS JOIN a""")
def agg7_mode_lookup(t):
    p = t("part")
    return M.mode_lookup(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_name", "p_type").select("p_partkey", "p_type", "seen", "pred")


@query(f"""WITH {ARMS}, r AS (SELECT arm, sum((s AND d)::INT)::BIGINT AS tp, sum((s AND NOT d)::INT)::BIGINT AS fn, sum((NOT s AND d)::INT)::BIGINT AS fp, sum((NOT s AND NOT d)::INT)::BIGINT AS tn
FROM (SELECT arm, ref_pred <> gold AS s, ref_pred <> pred AS d FROM pairs) GROUP BY arm)
SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity, tn / nullif(tn + fp, 0)::DOUBLE AS specificity, tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE - 1 AS youden FROM r""")
def agg8_response_table(t):
    p = arm_pairs(t).withColumn("s", F.col("ref_pred") != F.col("gold")).withColumn("d", F.col("ref_pred") != F.col("pred"))
    return M.response_table(p, ["arm"], "s", "d")


@query(f"""WITH {ARMS}, x AS (SELECT a.arm, CASE WHEN a.pred = 4 THEN NULL ELSE a.pred = a.gold END AS p, r.pred = r.gold AS q FROM ans a JOIN ans r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view')
SELECT arm, count(*) AS n, sum((p IS NULL OR q IS NULL)::INT)::BIGINT AS missing, coalesce(sum((p AND q)::INT), 0)::BIGINT AS "both", coalesce(sum(((p AND NOT q) OR (NOT p AND q))::INT), 0)::BIGINT AS one, coalesce(sum((NOT p AND NOT q)::INT), 0)::BIGINT AS neither FROM x GROUP BY arm""")
def agg9_pair_accuracy(t):
    p = arm_pairs(t).withColumn("p", F.when(F.col("pred") != 4, F.col("pred") == F.col("gold"))).withColumn("q", F.col("ref_pred") == F.col("gold"))
    return M.pair_accuracy(p, ["arm"], "p", "q")


@query(f"WITH {ARMS} SELECT arm, sum((pred <> ref_pred)::INT)::BIGINT AS changed, sum((pred <> ref_pred AND pred = gold)::INT)::BIGINT AS \"right\", sum((pred <> ref_pred AND pred = gold)::INT) / nullif(sum((pred <> ref_pred)::INT), 0)::DOUBLE AS precision FROM pairs GROUP BY arm")
def agg10_directional_precision(t):
    p = arm_pairs(t).withColumn("c", F.col("pred") != F.col("ref_pred")).withColumn("w", F.col("pred") == F.col("gold"))
    return M.directional_precision(p, ["arm"], "c", "w")


@query(f"""WITH {ARMS}, a AS (SELECT arm, sum(correct::INT) / count(*)::DOUBLE AS x FROM ans GROUP BY arm), v AS (SELECT x AS r FROM a WHERE arm = 'view')
SELECT arm AS control, r - x AS used, x / nullif(r, 0) AS surviving FROM a, v WHERE arm IN ('click', 'error')""")
def agg11_utilisation(t):
    return M.utilisation(M.arm_accuracy(answers(t)), "arm", "accuracy", "view", ["click", "error"])


@query(f"""WITH {ARMS} SELECT arm, count(*) AS n, sum((pred = (ref_pred + 1) % 5)::INT)::BIGINT AS donor, sum((pred <> (ref_pred + 1) % 5 AND pred = ref_pred)::INT)::BIGINT AS original,
(count(*) - sum((pred = (ref_pred + 1) % 5)::INT) - sum((pred <> (ref_pred + 1) % 5 AND pred = ref_pred)::INT))::BIGINT AS neither FROM pairs GROUP BY arm""")
def agg12_donor_following(t):
    return M.donor_following(arm_pairs(t).withColumn("donor_answer", (F.col("ref_pred") + 1) % 5), ["arm"], "pred", "donor_answer", "ref_pred")


@query(f"""WITH {ARMS}, x AS (SELECT arm, pred IS NOT DISTINCT FROM ref_pred AS s, ref_pred = gold AS r, pred = gold AS w FROM pairs),
c AS (SELECT arm, count(*) AS n, sum((s AND r)::INT)::BIGINT AS same_right, sum((s AND NOT r)::INT)::BIGINT AS same_wrong, sum((NOT s AND r AND NOT w)::INT)::BIGINT AS right_to_wrong,
 sum((NOT s AND NOT r AND w)::INT)::BIGINT AS wrong_to_right, sum((NOT s AND NOT r AND NOT w)::INT)::BIGINT AS wrong_to_wrong FROM x GROUP BY arm),
d AS (SELECT *, n - same_right - same_wrong AS changed, (n - same_right - same_wrong) / n::DOUBLE AS p, n::DOUBLE AS m FROM c)
SELECT arm, n, same_right, same_wrong, right_to_wrong, wrong_to_right, wrong_to_wrong, changed, p AS change_rate,
 (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * m)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / m) - 1.96::DOUBLE * sqrt(p * (1 - p) / m + 1.96::DOUBLE * 1.96::DOUBLE / (4 * m * m)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / m) AS wilson_low,
 (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * m)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / m) + 1.96::DOUBLE * sqrt(p * (1 - p) / m + 1.96::DOUBLE * 1.96::DOUBLE / (4 * m * m)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / m) AS wilson_high FROM d""")
def agg13_answer_transitions(t):
    return M.transitions(arm_pairs(t), ["arm"], "ref_pred", "pred", "gold")


@query(f"""WITH {TERMS}, p AS (SELECT a.arm, a.terms AS x, r.terms AS y FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view'),
j AS (SELECT arm, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS j FROM p)
SELECT arm, count(*) AS n, sum((j < 1)::INT)::BIGINT AS changed, list_sort(list(j))[count(*) // 2 + 1] AS median_jaccard, sum((j >= 0.5)::INT)::BIGINT AS half_or_more FROM j GROUP BY arm""")
def agg14_set_change(t):
    p = P.paired_with_reference(term_sets(t), "user_id", "arm", "view", ["terms"])
    return M.set_change(p, ["arm"], "ref_terms", "terms").select("arm", "n", "changed", "median_jaccard", "half_or_more")


@query(f"""WITH {ARMS}, c AS (SELECT gold, pred::VARCHAR AS pred, count(*) AS n FROM ans GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY gold) AS g, sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER () AS a FROM c)
SELECT gold, pred, n, n / g::DOUBLE AS row_share, (g * p)::BIGINT / a::DOUBLE AS expected FROM w""")
def agg15_confusion(t):
    return M.confusion(answers(t).withColumn("pred", F.col("pred").cast("string")), "gold", "pred")


@query(f"""WITH {ARMS}, s AS (SELECT arm, gold AS l, 1 AS g, 0 AS p, (pred = gold)::INT AS h FROM ans UNION ALL SELECT arm, pred, 0, 1, 0 FROM ans),
l AS (SELECT arm, l, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM s GROUP BY 1, 2) SELECT arm, count(*) AS labels, CAST(round(avg(2 * h / (g + p)::DOUBLE) * 1e9) AS BIGINT) AS macro_f1_e9 FROM l GROUP BY arm""")
def agg16_macro_f1(t):
    return M.macro_f1(answers(t), ["arm"], "gold", "pred").select("arm", "labels", F.round(F.col("macro_f1") * 1e9).cast("long").alias("macro_f1_e9"))


RANKED = "x AS (SELECT l_returnflag AS g, l_quantity::BIGINT AS s, l_linestatus = 'F' AS p FROM lineitem), t AS (SELECT g, s, count(*) AS n, sum(p::INT) AS k FROM x GROUP BY 1, 2)"


@query(f"WITH {RANKED}, c AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM t WINDOW w AS (PARTITION BY g ORDER BY s DESC)) SELECT g, sum(k)::BIGINT AS positives, CAST(round(sum(k * ck / cn::DOUBLE) / sum(k) * 1e9) AS BIGINT) AS ap_e9 FROM c GROUP BY g HAVING sum(k) > 0")
def agg17_average_precision(t):
    x = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_linestatus") == "F").alias("p"))
    return M.average_precision(x, ["g"], "s", "p").select("g", "positives", F.round(F.col("average_precision") * 1e9).cast("long").alias("ap_e9"))


@query(f"""WITH {RANKED}, c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
a AS (SELECT g, sum(n) AS n, sum(k) AS k, sum(k * (2 * b + n + 1)) AS r FROM c GROUP BY g)
SELECT g, k::BIGINT AS positives, (n - k)::BIGINT AS negatives, (r - k * (k + 1))::BIGINT / (2 * k * (n - k))::DOUBLE AS auroc FROM a WHERE k > 0 AND n > k""")
def agg18_within_group_auroc(t):
    x = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_linestatus") == "F").alias("p"))
    return M.auroc(x, ["g"], "s", "p")


@query(f"WITH {ARMS}, c AS (SELECT arm, gold, sum(correct::INT) / count(*)::DOUBLE AS r FROM ans GROUP BY 1, 2) SELECT arm, CAST(round(avg(r) * 1e9) AS BIGINT) AS balanced_e9 FROM c GROUP BY arm")
def agg19_balanced_accuracy(t):
    return M.balanced_accuracy(answers(t), ["arm"], "gold", "pred").select("arm", F.round(F.col("balanced_accuracy") * 1e9).cast("long").alias("balanced_e9"))


ANNOTATED = "ann AS (SELECT DISTINCT l_orderkey AS entity, ancestor AS term FROM lineitem JOIN part ON l_partkey = p_partkey JOIN closed ON term = p_name)"


def annotations(t: Tables) -> DataFrame:
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.col("p_name").alias("term"))
    return O.propagated(rows, O.closure(edges(t)), ["entity"], once=False)


@query(f"""WITH {EDGES}, x AS (SELECT DISTINCT l_orderkey AS e, l_returnflag AS arm, ancestor AS term, left(ancestor, 2) AS aspect FROM lineitem JOIN part ON l_partkey = p_partkey JOIN closed ON term = p_name WHERE left(ancestor, 2) IN ('a:', 'n:')),
g AS (SELECT DISTINCT aspect, e, term FROM x WHERE arm <> 'R'), s AS (SELECT arm, aspect, e, term FROM x), k AS (SELECT DISTINCT arm FROM s),
gn AS (SELECT aspect, e, count(*) AS g FROM g GROUP BY 1, 2), pn AS (SELECT arm, aspect, e, count(*) AS p FROM s GROUP BY 1, 2), tn AS (SELECT arm, aspect, e, count(*) AS tp FROM s JOIN g USING (aspect, e, term) GROUP BY 1, 2, 3),
r AS (SELECT k.arm, gn.aspect, gn.e, g, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM gn CROSS JOIN k LEFT JOIN (SELECT arm, aspect, e, count(*) AS p FROM s GROUP BY 1, 2, 3) pn ON pn.arm = k.arm AND pn.aspect = gn.aspect AND pn.e = gn.e LEFT JOIN tn ON tn.arm = k.arm AND tn.aspect = gn.aspect AND tn.e = gn.e)
SELECT arm, aspect, count(*) AS entities, sum((p > 0)::INT)::BIGINT AS predicting, CAST(round(avg(CASE WHEN p > 0 THEN tp / p::DOUBLE END) * 1e8) AS BIGINT) AS precision_e8, CAST(round(avg(tp / g::DOUBLE) * 1e8) AS BIGINT) AS recall_e8 FROM r GROUP BY 1, 2""".replace("pn AS (SELECT arm, aspect, e, count(*) AS p FROM s GROUP BY 1, 2), ", ""))
def agg20_propagated_f1(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("arm"), F.col("p_name").alias("term"))
    up = O.propagated(rows, O.closure(edges(t)), ["entity", "arm"]).withColumn("aspect", F.substring("term", 1, 2)).where(F.col("aspect").isin("a:", "n:"))
    out = M.propagated_f1(up.where("arm <> 'R'"), up, ["arm"])
    return out.select("arm", "aspect", "entities", "predicting", F.round(F.col("precision") * 1e8).cast("long").alias("precision_e8"), F.round(F.col("recall") * 1e8).cast("long").alias("recall_e8"))


@query(f"""WITH {EDGES}, {ANNOTATED}, n AS (SELECT term, count(*) AS n FROM ann GROUP BY 1), k AS (SELECT child AS term, count(*) AS k FROM edges GROUP BY 1),
m AS (SELECT term, count(*) AS n_parents FROM (SELECT e.child AS term, a.entity, count(*) AS c FROM edges e JOIN ann a ON a.term = e.parent GROUP BY 1, 2) JOIN k USING (term) WHERE c = k GROUP BY 1)
SELECT n.term, n.n, coalesce(n_parents, 0) AS n_parents, CAST(round(CASE WHEN k.k IS NULL THEN 0 ELSE -log2(n.n / n_parents::DOUBLE) END * 1e6) AS BIGINT) AS ia_e6 FROM n LEFT JOIN m USING (term) LEFT JOIN k USING (term)""")
def agg22_information_accretion(t):
    return O.information_accretion(annotations(t), edges(t)).select("term", "n", "n_parents", F.round(F.col("ia") * 1e6).cast("long").alias("ia_e6"))


@query("WITH c AS (SELECT p_name AS term, count(*) AS n FROM part GROUP BY 1) SELECT term, n, CAST(round(-ln(n / (SELECT sum(n) FROM c)::DOUBLE) * 1e6) AS BIGINT) AS ic_e6 FROM c")
def agg23_information_content(t):
    return O.corpus_information(t("part").select(F.col("p_name").alias("term"))).select("term", "n", F.round(F.col("ic") * 1e6).cast("long").alias("ic_e6"))


@query("SELECT least(9, l_linenumber * 10 // 8)::BIGINT AS bin, count(*) AS n, sum((l_linenumber = 0)::INT)::BIGINT AS first, sum((l_linenumber = 7)::INT)::BIGINT AS last FROM lineitem GROUP BY 1")
def agg24_option_use(t):
    return M.option_use(t("lineitem").withColumn("k", F.lit(8)), "l_linenumber", "k")


@query("SELECT l_returnflag, CAST(round(-sum(p * ln(p)) / ln(3) * 1e6) AS BIGINT) AS entropy_e6 FROM (SELECT l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE AS p FROM lineitem GROUP BY l_returnflag, l_linestatus) GROUP BY 1")
def agg24_entropy(t):
    return M.entropy(t("lineitem"), ["l_returnflag"], "l_linestatus", 3).select("l_returnflag", F.round(F.col("entropy") * 1e6).cast("long").alias("entropy_e6"))


@query(f"""WITH {ARMS}, a AS (SELECT arm, sum(correct::INT) / count(*)::DOUBLE AS x FROM ans GROUP BY arm), w AS (SELECT max(x) FILTER (arm = 'view') AS r, max(x) FILTER (arm = 'click') AS b FROM a)
SELECT r AS reference, b AS bare, b / nullif(r, 0) AS ratio, CASE WHEN r > 0.1::DOUBLE THEN greatest(0, b - 0.1::DOUBLE) / (r - 0.1::DOUBLE) END AS adjusted FROM w""")
def agg26_chance_adjusted(t):
    return M.chance_adjusted(M.arm_accuracy(answers(t)), "arm", "accuracy", "view", "click", 0.1)


@query("WITH x AS (SELECT l_linenumber AS dose, avg(l_quantity::BIGINT) FILTER (l_returnflag = 'A') AS A, avg(l_quantity::BIGINT) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) SELECT *, A - R AS gap FROM x")
def agg27_dose_table(t):
    rows = t("lineitem").select(F.col("l_linenumber").alias("dose"), "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return M.dose_table(rows, "dose", ["A", "R"], "l_returnflag", "q")


@query("""WITH x AS (SELECT o_orderstatus, o_orderkey % 7 AS v, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, o_orderpriority AS pr FROM orders),
l AS (SELECT o_orderstatus, v, 'price' AS axis, band AS stratum FROM x UNION ALL SELECT o_orderstatus, v, 'priority', pr FROM x) SELECT axis, stratum, o_orderstatus, count(*) AS n, avg(v) AS mean FROM l GROUP BY ALL""")
def agg28_stratified(t):
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    return M.stratified(t("orders").withColumn("v", F.col("o_orderkey") % 7), {"price": band, "priority": F.col("o_orderpriority")}, ["o_orderstatus"], "v")


@query("""WITH x AS (SELECT l_linenumber AS k, avg(q) FILTER (a = 'A' AND b = 'A') AS aa, avg(q) FILTER (a = 'A' AND b = 'B') AS ab, avg(q) FILTER (a = 'B' AND b = 'A') AS ba, avg(q) FILTER (a = 'B' AND b = 'B') AS bb
FROM (SELECT l_linenumber, l_quantity::BIGINT AS q, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS a, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS b FROM lineitem) GROUP BY 1)
SELECT k, CAST(round((aa + ab - ba - bb) / 2 * 1e6) AS BIGINT) AS first_e6, CAST(round((aa + ba - ab - bb) / 2 * 1e6) AS BIGINT) AS second_e6, CAST(round((aa - ab - ba + bb) * 1e6) AS BIGINT) AS interaction_e6 FROM x""")
def agg29_two_by_two(t):
    rows = t("lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("a"), F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("b"))
    out = M.two_by_two(rows, ["k"], "a", "b", "q")
    return out.select("k", *[F.round(F.col(f"{c}") * 1e6).cast("long").alias(n) for c, n in (("first_effect", "first_e6"), ("second_effect", "second_e6"), ("interaction", "interaction_e6"))])


@query("SELECT least(9, l_linenumber * 10 // 8)::BIGINT AS decile, l_returnflag, l_linestatus, count(*) AS slots, sum((l_quantity > 25)::INT)::BIGINT AS cited FROM lineitem GROUP BY CUBE (1, 2, 3)".replace("CUBE (1, 2, 3)", "CUBE (least(9, l_linenumber * 10 // 8)::BIGINT, l_returnflag, l_linestatus)"))
def agg30_citation_cube(t):
    rows = t("lineitem").withColumn("n", F.lit(8)).withColumn("c", F.col("l_quantity") > 25)
    return M.citation_table(rows, "l_linenumber", "n", ["l_returnflag", "l_linestatus"], "c")


@query("WITH x AS (SELECT p_name, p_type, count(*) AS c FROM part GROUP BY 1, 2) SELECT p_name, sum(c)::BIGINT AS n, count(*) AS \"distinct\", (sum(c) - max(c))::BIGINT AS non_modal FROM x GROUP BY 1")
def agg32_non_modal(t):
    return M.non_modal(t("part"), "p_name", "p_type")


@query("""WITH x AS (SELECT p_name, p_type, count(*) AS c FROM part GROUP BY 1, 2), y AS (SELECT *, max(c) OVER (PARTITION BY p_name) AS m FROM x), z AS (SELECT *, sum((c = m)::INT) OVER (PARTITION BY p_name) AS k FROM y)
SELECT sum(c)::BIGINT AS n, sum(CASE WHEN k = 1 AND c = m THEN c ELSE 0 END)::BIGINT AS major, sum(CASE WHEN c < m THEN c ELSE 0 END)::BIGINT AS minor, sum(CASE WHEN k > 1 AND c = m THEN c ELSE 0 END)::BIGINT AS tied,
(SELECT sum(m)::BIGINT FROM (SELECT DISTINCT p_name, m FROM y)) AS ceiling FROM z""")
def agg33_text_ceiling(t):
    return M.text_ceiling(t("part"), "p_name", "p_type")


@query("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS variants, count(DISTINCT p_type) AS labels, CASE WHEN count(DISTINCT p_type) > 1 THEN 'sensitivity' ELSE 'stability' END AS stratum FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def agg34_group_strata(t):
    return M.group_strata(t("part"), "p_name", "p_brand", "p_type")


@query(f"WITH {TERMS} SELECT arm, list_sort(list(DISTINCT term)) AS terms FROM terms GROUP BY arm")
def agg36_union_sets(t):
    return term_rows(t).groupBy("arm").agg(F.array_sort(F.collect_set("term")).alias("terms"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s FROM a WHERE r <= 6)
SELECT p_partkey, p_name, p_brand FROM b WHERE s <= 4""")
def agg37_diversity_caps(t):
    return M.capped(t("part"), F.col("p_partkey"), {"p_name": 6, "p_brand": 4}).select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderstatus, count(*) AS n, CAST(round(avg(v) * 1e6) AS BIGINT) AS mean_e6, CAST(round(stddev_samp(v) * 1e5) AS BIGINT) AS sd_e5, min(v) AS low, max(v) AS high FROM (SELECT o_orderstatus, o_orderkey % 1000 AS v FROM orders) GROUP BY 1")
def agg38_across_seeds(t):
    out = M.across_seeds(t("orders").withColumn("v", F.col("o_orderkey") % 1000), ["o_orderstatus"], "v")
    return out.select("o_orderstatus", "n", F.round(F.col("mean") * 1e6).cast("long").alias("mean_e6"), F.round(F.col("sd") * 1e5).cast("long").alias("sd_e5"), "low", "high")


@query(f"WITH {ARMS}, a AS (SELECT pred AS v, count(*) AS x FROM pairs GROUP BY 1), b AS (SELECT ref_pred AS v, count(*) AS y FROM pairs GROUP BY 1) SELECT count(*) AS n, sum((pred = ref_pred)::INT)::BIGINT AS matches, (SELECT sum(x * y) FROM a JOIN b USING (v))::BIGINT / count(*)::DOUBLE AS expected FROM pairs")
def agg39_chance_match(t):
    return M.chance_match(arm_pairs(t), "pred", "ref_pred")


@query(f"""WITH {ARMS} SELECT arm, count(*) AS n, sum((pred = 4)::INT)::BIGINT AS unmapped, sum((pred = gold AND pred <> 4)::INT)::BIGINT AS n_correct, sum((pred = gold AND pred <> 4)::INT) / count(*)::DOUBLE AS accuracy,
sum((pred = gold AND pred <> 4)::INT) / nullif(count(*) - sum((pred = 4)::INT), 0)::DOUBLE AS accuracy_answered FROM ans GROUP BY arm""")
def agg40_label_accuracy(t):
    return M.label_accuracy(answers(t).withColumn("pred", F.when(F.col("pred") != 4, F.col("pred"))))


# Windows and ranks over candidate scores.
SCORES = """sc AS (SELECT o_custkey AS cell, p_type AS cand, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
lab AS (SELECT cell, CASE cell % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS label, cand, score FROM sc)"""


def candidate_scores(t: Tables) -> DataFrame:
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    sc = j.groupBy(F.col("o_custkey").alias("cell"), F.col("p_type").alias("cand")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("score"))
    names = F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return sc.withColumn("label", F.get(names, (F.col("cell") % 6).cast("int")))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, cand) AS k FROM lab) SELECT count(*) AS n, sum((k <= 1)::INT)::BIGINT AS hits_at_1, sum((k <= 3)::INT)::BIGINT AS hits_at_3, sum((k <= 5)::INT)::BIGINT AS hits_at_5 FROM r WHERE cand = label")
def win1_recall_at_k(t):
    return M.confusable_rank(candidate_scores(t), ["cell"], "cand", "score", "label", (1, 3, 5))


@query(f"WITH {SCORES} SELECT cell, cand AS best FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, cand) AS k FROM sc) WHERE k = 1")
def win2_best_candidate(t):
    held = candidate_scores(t).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("cand", "score"))).alias("m"))
    return held.select("cell", A.best_of_map(F.col("m")).alias("best"))


@query(f"WITH {SCORES} SELECT cell, max(score) FILTER (cand = label) AS own, max(score) FILTER (cand <> label) AS other, max(score) FILTER (cand = label) - max(score) FILTER (cand <> label) AS margin FROM lab GROUP BY cell")
def win3_margin(t):
    return M.margins(candidate_scores(t), ["cell"], "cand", "score", "label")


@query(f"WITH {SCORES} SELECT a.cell, a.cand, count(b.cell) FILTER (b.score < a.score) AS below, count(b.cell) AS others, count(b.cell) FILTER (b.score < a.score) / nullif(count(b.cell), 0)::DOUBLE AS quantile FROM lab a LEFT JOIN lab b ON a.cand = b.cand AND b.label <> a.cand WHERE a.cand = a.label GROUP BY 1, 2")
def win4_score_quantile(t):
    return M.score_quantile(candidate_scores(t), "cell", "cand", "score", "label")


@query("WITH x AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT least(9, i * 10 // n)::BIGINT AS decile, count(*) AS rows_in FROM x GROUP BY 1")
def win5_deciles(t):
    w = Window.partitionBy("o_custkey")
    x = t("orders").select((F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return x.groupBy(A.decile(F.col("i"), F.col("n")).alias("decile")).agg(F.count(F.lit(1)).alias("rows_in"))


@query("SELECT o_custkey, list(o_orderpriority ORDER BY f) AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def win6_first_seen(t):
    held = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    return held.select("o_custkey", F.array_distinct(F.transform("s", lambda x: x["o_orderpriority"])).alias("seen"))


@query("WITH x AS (SELECT o_custkey, o_orderstatus = 'F' AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, count(*) AS n, sum((h AND k <= 2)::INT)::BIGINT AS hits_2, sum((h AND k <= 5)::INT)::BIGINT AS hits_5, sum(h::INT)::BIGINT AS hits_all FROM x GROUP BY 1")
def win7_precision_at_k(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return M.precision_at(t("orders").withColumn("k", F.row_number().over(w)).withColumn("h", F.col("o_orderstatus") == "F"), ["o_custkey"], "k", "h", (2, 5))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, cand) AS k FROM sc) SELECT cell, string_agg(cand, ' ' ORDER BY k) FILTER (k <= 3) AS sentence, coalesce(list(cand ORDER BY k) FILTER (k > 3), []) AS remainder FROM r GROUP BY 1")
def win8_cell_sentence(t):
    from armwise.sources.readers import cell_sentence

    return cell_sentence(candidate_scores(t), "cell", "cand", "score", 3)


@query(f"WITH {SCORES}, r AS (SELECT cell, list(cand ORDER BY score DESC, cand) AS l FROM sc GROUP BY 1) SELECT cell, l[1:ceil(len(l) * 0.5)::INT] AS kept FROM r")
def win9_first_share(t):
    held = candidate_scores(t).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand"))).alias("g"))
    return held.select("cell", S.first_share(F.transform("g", lambda x: x["cand"]), 0.5).alias("kept"))


@query("""WITH x AS (SELECT o_custkey AS c, o_totalprice AS a, o_orderkey AS b FROM orders), r AS (SELECT c, rank() OVER (PARTITION BY c ORDER BY a) + (count(*) OVER (PARTITION BY c, a) - 1) / 2 AS p, rank() OVER (PARTITION BY c ORDER BY b) + (count(*) OVER (PARTITION BY c, b) - 1) / 2 AS q FROM x)
SELECT c, count(*) AS n, CASE WHEN count(*) >= 3 THEN CAST(round(corr(p, q) * 1e6) AS BIGINT) END AS rho_e6 FROM r GROUP BY c""")
def win10_spearman(t):
    out = M.spearman(t("orders").select(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("a"), F.col("o_orderkey").alias("b")), ["c"], "a", "b")
    return out.select("c", "n", F.round(F.col("spearman") * 1e6).cast("long").alias("rho_e6"))


@query(f"SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY {PICK.format(chr(39) + 'sample|' + chr(39) + ' || p_partkey')}, p_partkey) AS r FROM part) WHERE r <= 20")
def win11_balanced_sample(t):
    return P.balanced_sample(t("part"), ["p_type"], 20, "p_partkey").select("p_partkey", "p_type")


@query(f"SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, {PICK.format(chr(39) + 'sample|' + chr(39) + ' || p_partkey')}, p_partkey) AS r FROM part) WHERE r <= 5")
def win12_stratified_preferring(t):
    return P.balanced_sample(t("part"), ["p_brand"], 5, "p_partkey", prefer=F.col("p_size")).select("p_partkey", "p_brand")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win15_keep_last(t):
    return P.keep_last(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"SELECT shard, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM (SELECT o_custkey, ({PICK.format(chr(39) + 'shard|' + chr(39) + ' || o_custkey')} % 7)::INT AS shard FROM orders) GROUP BY 1")
def win17_hash_shards(t):
    return P.shard_of(t("orders"), "o_custkey", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("keys"))


# Sets.
@query(f"WITH {TERMS} SELECT a.user_id, a.arm, len(list_intersect(a.terms, r.terms)) / len(list_distinct(list_concat(a.terms, r.terms)))::DOUBLE AS jaccard, 1 - len(list_intersect(a.terms, r.terms)) / len(list_distinct(list_concat(a.terms, r.terms)))::DOUBLE AS distance, list_sort(a.terms) = list_sort(r.terms) AS equal, len(list_intersect(a.terms, r.terms)) / len(r.terms)::DOUBLE AS retained FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view'")
def set1_jaccard(t):
    p = P.paired_with_reference(term_sets(t), "user_id", "arm", "view", ["terms"])
    a, b = F.col("terms"), F.col("ref_terms")
    return p.select("user_id", "arm", A.jaccard(a, b).alias("jaccard"), A.jaccard_distance(a, b).alias("distance"), A.same_set(a, b).alias("equal"), A.retention(b, a).alias("retained"))


@query(f"WITH {TERMS} SELECT a.user_id, a.arm, len(list_intersect(a.terms, r.terms))::INT AS kept, (len(r.terms) - len(list_intersect(a.terms, r.terms)))::INT AS removed, (len(a.terms) - len(list_intersect(a.terms, r.terms)))::INT AS added FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view'")
def set3_set_counts(t):
    p = P.paired_with_reference(term_sets(t), "user_id", "arm", "view", ["terms"])
    a, b = F.col("terms"), F.col("ref_terms")
    return p.select("user_id", "arm", F.size(F.array_intersect(a, b)).alias("kept"), F.size(F.array_except(b, a)).alias("removed"), F.size(F.array_except(a, b)).alias("added"))


@query("SELECT 'run' AS part, o_orderstatus AS arm, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'derived', o_orderstatus || '_d', count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 2")
def set4_union_arms(t):
    o = t("orders")
    run = o.where("o_orderkey % 2 = 0").select(F.lit("run").alias("part"), F.col("o_orderstatus").alias("arm"))
    derived = o.where("o_orderkey % 2 = 1").select(F.lit("derived").alias("part"), F.concat("o_orderstatus", F.lit("_d")).alias("arm"), F.lit(1).alias("derived_only"))
    return run.unionByName(derived, allowMissingColumns=True).groupBy("part", "arm").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT DISTINCT event_type AS c FROM events), w AS (SELECT unnest(['view', 'click', 'swap']) AS c) SELECT coalesce(s.c, w.c) AS c, CASE WHEN w.c IS NULL THEN 'unexpected' WHEN s.c IS NULL THEN 'missing' ELSE 'seen' END AS state FROM s FULL JOIN w ON s.c = w.c")
def set5_conditions_seen(t):
    seen = t("events").select(F.col("event_type").alias("c")).distinct().withColumn("s", F.lit(True))
    want = seen.sparkSession.createDataFrame([(x,) for x in ("view", "click", "swap")], "c string").withColumn("w", F.lit(True))
    return seen.join(want, "c", "full").select("c", F.when(F.col("w").isNull(), "unexpected").when(F.col("s").isNull(), "missing").otherwise("seen").alias("state"))


@query("WITH s AS (SELECT o_orderstatus AS arm, list_sort(list(DISTINCT o_custkey)) AS l FROM orders GROUP BY 1) SELECT md5(array_to_string(l, ',')) AS coverage, list_sort(list(arm)) AS arms, len(l)::INT AS entities FROM s GROUP BY l")
def set6_coverage_groups(t):
    rows = t("orders").select(F.col("o_orderstatus").alias("arm"), F.col("o_custkey").alias("e"))
    return M.coverage_groups(rows, "arm", "e")


# Joins and filters.
@query(f"WITH {ARMS} SELECT user_id, arm, pred, ref_pred FROM pairs")
def jn1_paired_arms(t):
    return arm_pairs(t).select("user_id", "arm", "pred", "ref_pred")


@query("SELECT doc_id, quality, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def jn2_left_missing(t):
    return P.with_missing(t("documents").select("doc_id"), t("labels").select("doc_id", "quality"), ["doc_id"], "quality")


@query("""WITH r AS (SELECT DISTINCT c_nationkey AS w, o_custkey AS k, o_orderpriority AS m FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT x.w, x.k AS a, y.k AS b, count(*) AS shared FROM r x JOIN r y ON x.w = y.w AND x.m = y.m AND x.k < y.k GROUP BY ALL""")
def jn6_shared_members(t):
    r = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("w"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("m"))
    return P.shared_member_pairs(r, "w", "k", "m")


@query("SELECT x.p_name, x.p_partkey AS a, y.p_partkey AS b, x.p_type <> y.p_type AS should_change FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey AND x.p_brand <> y.p_brand")
def jn8_same_text_pairs(t):
    return P.same_text_pairs(t("part"), "p_name", "p_partkey", "p_brand", "p_type")


@query(f"WITH {EDGES}, ty AS (SELECT DISTINCT term FROM closed WHERE distance = 0) SELECT a.term AS a, b.term AS b FROM ty a JOIN ty b ON a.term <> b.term WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE (c.term = a.term AND c.ancestor = b.term) OR (c.term = b.term AND c.ancestor = a.term))")
def jn9_unrelated_pairs(t):
    c = O.closure(edges(t))
    types = c.where("distance = 0").select("term")
    return P.unrelated_pairs(types, c.where("distance > 0").select(F.col("term").alias("a"), F.col("ancestor").alias("b")), "term")


@query("""WITH l AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer WHERE c_mktsegment = 'BUILDING'),
r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT l.c_nationkey, l.rank, l.c_custkey AS "left", l.c_acctbal AS left_c_acctbal, r.c_custkey AS "right", r.c_acctbal AS right_c_acctbal FROM l JOIN r ON l.c_nationkey = r.c_nationkey AND l.rank = r.rank""")
def jn13_rank_matching(t):
    c = t("customer")
    return P.rank_matched(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_custkey", "c_acctbal", ["c_nationkey"]).withColumn("rank", F.col("rank").cast("long"))


HASHED = PICK.format("'{0}|' || c_custkey")


@query(f"""WITH t AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS i FROM customer WHERE c_mktsegment = 'BUILDING'),
p AS (SELECT c_nationkey, c_custkey AS control, row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASHED.format('control')}, c_custkey) AS i FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT t.c_nationkey, t.c_custkey, control FROM t LEFT JOIN p ON t.c_nationkey = p.c_nationkey AND t.i = p.i""")
def jn15_matched_controls(t):
    c = t("customer")
    return P.matched_controls(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment <> 'BUILDING'"), ["c_nationkey"], "c_custkey", "c_acctbal").select("c_nationkey", "c_custkey", "control")


@query(f"""WITH p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASHED.format('derange')}, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT a.c_nationkey, a.c_custkey, b.c_custkey AS donor FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND b.i = a.i % a.n + 1 WHERE a.n > 1""")
def jn16_derangement(t):
    return P.deranged(t("customer"), "c_custkey", ["c_nationkey"])


@query(f"""WITH p AS (SELECT c_nationkey, c_custkey, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASHED.format('donor')}, c_custkey) AS i FROM customer)
SELECT a.c_nationkey, a.c_custkey, first(b.c_custkey ORDER BY (b.i < a.i)::INT, b.i) AS donor FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.s <> b.s GROUP BY 1, 2""")
def jn17_unlike_donors(t):
    return P.unlike_donors(t("customer"), "c_custkey", ["c_nationkey"], "c_mktsegment")


@query(f"WITH {ARMS} SELECT a.user_id, 'crossed' AS arm, a.pred, b.value FROM ans a JOIN ans b USING (user_id) WHERE a.arm = 'view' AND b.arm = 'click'")
def jn18_crossed_arm(t):
    return P.with_source_arm(answers(t), "user_id", "arm", "view", "click", "pred", "value", "crossed").select("user_id", "arm", "pred", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn20_semi_anti(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return t("customer").select("c_custkey").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3)")
def flt2_complete_entities(t):
    return P.complete_entities(t("orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def flt3_large_groups(t):
    return P.at_least(t("orders"), ["o_custkey"], 12).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1) OR p_name NOT IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)")
def flt5_unambiguous_keys(t):
    return P.only_once(t("part"), "p_name", "p_type").select("p_partkey", "p_name")


@query(f"""WITH {ARMS}, x AS (SELECT a.arm, count(*) AS n, sum((a.pred <> r.pred)::INT)::BIGINT AS changed, sum((a.gold IS NOT DISTINCT FROM r.gold)::INT)::BIGINT AS stayed FROM ans a JOIN ans r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view' GROUP BY 1)
SELECT *, CASE WHEN stayed < n THEN 'FAIL stay' WHEN changed * 2 < n THEN 'FAIL change' ELSE 'PASS' END AS verdict FROM x""")
def chk2_validity_gates(t):
    return M.validity_gates(answers(t), "view", "arm", "user_id", "pred", "gold")


@query("SELECT doc_id, substr(sha1(lang || '|' || source || '|' || text), 1, 16) AS variant_key FROM documents")
def prj3_variant_key(t):
    return t("documents").select("doc_id", F.substring(F.sha1(F.concat_ws("|", "lang", "source", "text").cast("binary")), 1, 16).alias("variant_key"))


@query("SELECT event_id, event_type || '_p' || lpad((event_id % 100)::VARCHAR, 2, '0') || '_s' || (event_id % 3) AS condition, event_id % 100 AS dose, event_id % 3 AS seed FROM events")
def prj4_condition_names(t):
    name = F.concat("event_type", F.format_string("_p%02d_s%d", F.col("event_id") % 100, F.col("event_id") % 3))
    rows = t("events").select("event_id", name.alias("condition"))
    return rows.withColumn("dose", F.regexp_extract("condition", r"_p(\d+)", 1).cast("long")).withColumn("seed", F.regexp_extract("condition", r"_s(\d+)$", 1).cast("long"))


# Texts.
NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_\s\-''/]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {NORMAL.format('text')} AS norm FROM conversations")
def txt1_normalised(t):
    return t("conversations").select("conv_id", "turn", T.normalised_label(F.col("text")).alias("norm"))


@query(f"""WITH l AS (SELECT unnest(['the', 'that', 'tion', 'than', 'est', 'de la']) AS label), x AS (SELECT conv_id, turn, {NORMAL.format('text')} AS n FROM conversations),
h AS (SELECT conv_id, turn, label, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(label) DESC, label) AS r FROM x JOIN l ON contains(n, label))
SELECT x.conv_id || ':' || x.turn AS key, label AS pred FROM x LEFT JOIN h ON x.conv_id = h.conv_id AND x.turn = h.turn AND r = 1""")
def txt2_label_mapping(t):
    rows = t("conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    labels = rows.sparkSession.createDataFrame([(x,) for x in ("the", "that", "tion", "than", "est", "de la")], "label string")
    return T.mapped_labels(rows, labels, "key", F.col("text"))


@query(f"SELECT doc_id, coalesce(contains({NORMAL.format('d.text')}, {NORMAL.format('b.text')}), false) AS named FROM documents d LEFT JOIN benchmark b ON item_id = doc_id")
def txt4_gold_named(t):
    rows = t("documents").select("doc_id", "text").join(t("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("g")), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.contains(T.normalised_label(F.col("text")), T.normalised_label(F.col("g"))) & F.col("g").isNotNull(), F.lit(False)).alias("named"))


@query(f"""WITH d AS (SELECT doc_id, {NORMAL.format('text')} AS n FROM documents), b AS (SELECT DISTINCT {NORMAL.format('text')} AS g FROM benchmark)
SELECT doc_id, EXISTS (SELECT 1 FROM b WHERE g <> '' AND contains(d.n, g)) AS named FROM d""")
def txt4_benchmark_named(t):
    return T.naming_any(t("documents").select("doc_id", "text"), t("benchmark").select(F.col("text").alias("item")), F.col("text"), F.col("item")).select("doc_id", "named")


@query("SELECT page_id, list_distinct(regexp_extract_all(html, 'class=\"[a-z]+\"')) IS NOT NULL AS any, len(list_distinct(regexp_extract_all(html, '<[a-z0-9]+')))::INT AS tags FROM pages")
def txt9_pattern_terms(t):
    return t("pages").select("page_id", T.term_ids(F.col("html"), 'class="[a-z]+"').isNotNull().alias("any"), F.size(T.term_ids(F.col("html"), "<[a-z0-9]+")).alias("tags"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS stripped FROM pages")
def txt16_tags_stripped(t):
    return t("pages").select("page_id", T.strip(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("stripped"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')), '[\\s.]+$', ''), '^(a|an|the)\\s+', '')) AS key FROM conversations")
def txt18_ontology_key(t):
    return t("conversations").select("conv_id", "turn", T.ontology_key(F.col("text")).alias("key"))


@query("SELECT doc_id, array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT starts_with(lower(trim(x)), 'the')], chr(10)) AS rest FROM documents")
def txt21_lines_dropped(t):
    return t("documents").select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda s: ~F.startswith(F.lower(F.trim(s)), F.lit("the"))), "\n").alias("rest"))


# Sequences.
@query("WITH x AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch, unnest(range(0, length(c_name))) AS i FROM customer) SELECT c_custkey, string_agg(ch, '' ORDER BY md5(c_custkey || '|' || i), i) AS shuffled FROM x GROUP BY 1")
def seq1_hash_shuffle(t):
    return t("customer").select("c_custkey", S.shuffled(F.col("c_name"), F.col("c_custkey").cast("string")).alias("shuffled"))


@query("WITH x AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part) SELECT p_partkey, substr(p_name, i, 2) AS kmer, count(*) AS n FROM x GROUP BY 1, 2")
def seq3_kmer_counts(t):
    return S.kmers(t("part"), "p_partkey", F.col("p_name"), 2)


@query("SELECT p_partkey, (length(p_name) - length(translate(p_name, 'aeiou', ''))) / length(p_name)::DOUBLE AS vowels FROM part")
def seq3_letter_share(t):
    return t("part").select("p_partkey", S.share_of(F.col("p_name"), "aeiou").alias("vowels"))


@query("""WITH x AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part), y AS (SELECT *, [i FOR i IN range(1, least(length(a), length(b)) + 1) IF a[i] <> b[i]] AS d FROM x WHERE b IS NOT NULL)
SELECT p_partkey, coalesce(d[1], CASE WHEN length(a) <> length(b) THEN least(length(a), length(b)) + 1 END)::INT AS first, len(d)::INT AS differing FROM y""")
def seq5_first_difference(t):
    p = t("part")
    x = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return x.select("p_partkey", S.first_difference(F.col("a"), F.col("b")).alias("first"), F.size(S.differences(F.col("a"), F.col("b"))).alias("differing"))


@query("SELECT c_custkey, substr(c_name, greatest(1, least(c_custkey % 18 + 1 - 4, length(c_name) - 8 + 1))::INT, 8) AS seen FROM customer")
def seq6_window(t):
    return t("customer").select("c_custkey", S.window(F.col("c_name"), F.col("c_custkey") % 18 + 1, 8).alias("seen"))


@query("SELECT p_partkey, array_to_string([CASE WHEN i IN (1, 3) THEN CASE WHEN p_name[i] = 'a' THEN 'g' ELSE 'a' END ELSE p_name[i] END FOR i IN range(1, length(p_name) + 1)], '') AS substituted, substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 5) AS deleted, repeat('x', (length(p_name) // 4)::INT) || substr(p_name, (length(p_name) // 4)::INT + 1) AS masked FROM part")
def seq7_edits(t):
    x = F.col("p_name")
    return t("part").select("p_partkey", S.substituted(x, F.array(F.lit(1), F.lit(3)), "a", "g").alias("substituted"), S.deleted(x, F.array(F.lit(2), F.lit(4))).alias("deleted"), S.masked_block(x, "start", 0.25, "x").alias("masked"))


@query(f"""WITH {SCORES}, l AS (SELECT cell, list(cand ORDER BY score DESC, cand) AS g FROM sc GROUP BY 1) SELECT cell, [x FOR x IN g IF x NOT IN ('PROMO', 'SMALL')] AS kept FROM l""")
def seq9_items_removed(t):
    held = candidate_scores(t).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand"))).alias("g"))
    return held.select("cell", S.without_items(F.transform("g", lambda x: x["cand"]), F.array(F.lit("PROMO"), F.lit("SMALL"))).alias("kept"))


# Ontologies.
@query(f"WITH {EDGES} SELECT DISTINCT term, ancestor, distance FROM closed")
def dag1_closure(t):
    return O.closure(edges(t))


@query(f"WITH {EDGES} SELECT p_partkey, bool_or(ancestor = 'n:bolt') AND NOT bool_or(ancestor = 'a:red') AS satisfied FROM part JOIN closed ON term = p_name GROUP BY 1")
def dag3_satisfied(t):
    return O.satisfied(t("part").select("p_partkey", F.col("p_name").alias("term")), O.closure(edges(t)), "p_partkey", ["n:bolt"], ["a:red"])


TERM_PAIRS = "pr AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


def term_pairs(t: Tables) -> DataFrame:
    p = t("part")
    return p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("a", "b").distinct()


@query(f"WITH {EDGES}, {TERM_PAIRS}, m AS (SELECT a, b, x.distance + y.distance AS hops, x.ancestor AS nearest FROM pr JOIN (SELECT DISTINCT * FROM closed) x ON x.term = a JOIN (SELECT DISTINCT * FROM closed) y ON y.term = b AND y.ancestor = x.ancestor) SELECT a, b, hops, nearest FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hops, nearest) AS r FROM m) WHERE r = 1")
def dag4_hop_distance(t):
    return O.hop_distance(term_pairs(t), O.closure(edges(t)))


@query(f"""WITH {EDGES}, {TERM_PAIRS}, c AS (SELECT DISTINCT * FROM closed), i AS (SELECT ancestor AS term, count(*) AS d FROM c GROUP BY 1), m AS (SELECT a, b, x.ancestor AS t, d FROM pr JOIN c x ON x.term = a JOIN c y ON y.term = b AND y.ancestor = x.ancestor JOIN i ON i.term = x.ancestor)
SELECT a, b, t AS mica, d AS descendants FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d, t) AS r FROM m) WHERE r = 1""")
def dag5_most_informative(t):
    c = O.closure(edges(t))
    info = O.structural_information(c)
    best = O.most_informative(term_pairs(t), c, info)
    return best.join(info.select(F.col("term").alias("mica"), "descendants"), "mica").select("a", "b", "mica", "descendants")


FACTS = "fc AS (SELECT DISTINCT p_name AS term, 'brand' AS relation, p_brand AS object FROM part UNION SELECT DISTINCT 'a:' || split_part(p_name, ' ', 1), 'like', left(p_name, 1) FROM part), inh AS (SELECT DISTINCT c.term, relation, object FROM closed c JOIN fc ON fc.term = c.ancestor)"


def facts(t: Tables) -> DataFrame:
    p = t("part")
    own = p.select(F.col("p_name").alias("term"), F.lit("brand").alias("relation"), F.col("p_brand").alias("object"))
    up = p.select(F.concat(F.lit("a:"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term"), F.lit("like").alias("relation"), F.substring("p_name", 1, 1).alias("object"))
    return own.unionByName(up).distinct()


@query(f"WITH {EDGES}, {TERM_PAIRS}, {FACTS} SELECT a, b, x.relation, x.object FROM pr JOIN inh x ON x.term = a WHERE NOT EXISTS (SELECT 1 FROM inh y WHERE y.term = b AND y.relation = x.relation AND y.object = x.object)")
def dag6_contrasting_facts(t):
    return O.contrasting_facts(term_pairs(t), O.inherited_facts(facts(t), O.closure(edges(t))))


@query(f"WITH {EDGES}, {TERM_PAIRS}, {FACTS} SELECT a, b, x.relation, x.object FROM pr JOIN inh x ON x.term = a JOIN inh y ON y.term = b AND y.relation = x.relation AND y.object = x.object")
def dag6_shared_facts(t):
    return O.shared_facts(term_pairs(t), O.inherited_facts(facts(t), O.closure(edges(t))))


@query(f"WITH {EDGES} SELECT ancestor AS term, count(*) AS descendants, CAST(round(-ln(count(*) / (SELECT count(DISTINCT term) FROM closed)::DOUBLE) * 1e6) AS BIGINT) AS ic_e6 FROM (SELECT DISTINCT * FROM closed) GROUP BY 1")
def dag7_structural_information(t):
    return O.structural_information(O.closure(edges(t))).select("term", "descendants", F.round(F.col("ic") * 1e6).cast("long").alias("ic_e6"))


# Resampling and statistics.
@query(f"""WITH u AS (SELECT c_mktsegment AS g, c_nationkey AS c, sum((c_custkey % 3 = 0)::BIGINT)::BIGINT AS hits, count(*) AS size FROM customer GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM u),
k AS (SELECT g, d AS draw, {PICK.format("'cluster|' || d || '|' || i")} % n AS i FROM p, range(200) r(d)), b AS (SELECT k.g, draw, sum(hits) / sum(size)::DOUBLE AS rate FROM k JOIN p ON k.g = p.g AND k.i = p.i GROUP BY 1, 2)
SELECT g, list_sort(list(rate))[6] AS ci_low, list_sort(list(rate))[196] AS ci_high FROM b GROUP BY g""")
def bst2_cluster_bootstrap(t):
    rows = t("customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("c"), (F.col("c_custkey") % 3 == 0).alias("h"))
    return R.interval(R.cluster_bootstrap(rows, ["g"], "c", "h", 200), ["g"], "rate", 200)


@query(f"""WITH p AS (SELECT p_type AS g, p_partkey, p_size AS v, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM part),
k AS (SELECT g, d AS draw, {PICK.format("'boot|' || d || '|' || i")} % n AS i FROM p, range(100) r(d)), b AS (SELECT k.g, draw, sum(v) / count(*)::DOUBLE AS m FROM k JOIN p ON k.g = p.g AND k.i = p.i GROUP BY 1, 2)
SELECT g, list_sort(list(m))[3] AS ci_low, list_sort(list(m))[98] AS ci_high FROM b GROUP BY g""")
def bst1_bootstrap_mean(t):
    rows = t("part").select(F.col("p_type").alias("g"), "p_partkey", F.col("p_size").cast("long").alias("v"))
    return R.interval(R.bootstrap_mean(rows, ["g"], "v", ["p_partkey"], 100), ["g"], "mean", 100)


@query(f"""WITH p AS (SELECT n_nationkey AS c, (n_nationkey * 7) % 11 AS a, (n_nationkey * 5) % 13 AS b, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation),
k AS (SELECT d AS draw, {PICK.format("'paired|' || d || '|' || i")} % n AS i FROM p, range(500) r(d)), z AS (SELECT draw, (sum(a) - sum(b)) / count(*)::DOUBLE AS difference FROM k JOIN p USING (i) GROUP BY 1) SELECT draw, difference FROM z""")
def bst4_paired_difference(t):
    rows = t("nation").select(F.col("n_nationkey").alias("c"), ((F.col("n_nationkey") * 7) % 11).cast("long").alias("a"), ((F.col("n_nationkey") * 5) % 13).cast("long").alias("b"))
    return R.paired_difference(rows, "c", "a", "b", 500).withColumn("draw", F.col("draw").cast("long"))


@query(f"""WITH u AS (SELECT n_nationkey AS c, (n_nationkey * 7) % 11 - 4 AS d FROM nation), f AS (SELECT r.d AS draw, sum(CASE WHEN {PICK.format("'flip|' || r.d || '|' || c")} % 2 = 0 THEN u.d ELSE -u.d END) AS s FROM u, range(2000) r(d) GROUP BY 1), o AS (SELECT count(*) AS n, sum(d)::BIGINT AS observed FROM u)
SELECT n, observed, sum((s >= observed)::INT)::BIGINT AS ge, (sum((s >= observed)::INT) + 1) / 2001::DOUBLE AS p FROM f, o GROUP BY n, observed""")
def prm1_sign_flip(t):
    rows = t("nation").select(F.col("n_nationkey").alias("c"), ((F.col("n_nationkey") * 7) % 11 - 4).cast("long").alias("d"))
    return R.sign_flip(rows, "c", "d", 2000)


@query(f"""WITH a AS (SELECT p_name, p_partkey, p_type, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part), b AS (SELECT p_name, p_type AS permuted, row_number() OVER (PARTITION BY p_name ORDER BY {PICK.format("'perm0|' || p_partkey")}, p_partkey) AS i FROM part)
SELECT a.p_partkey, a.p_type, permuted FROM a JOIN b ON a.p_name = b.p_name AND a.i = b.i""")
def prm3_permuted_labels(t):
    return R.permuted_labels(t("part"), "p_partkey", ["p_name"], "p_type").select("p_partkey", "p_type", "permuted")


@query("WITH r AS (SELECT o_orderkey % 100 AS y, o_custkey % 17 AS a, o_orderkey % 13 AS b FROM orders) SELECT count(*) AS n, CAST(round(corr(y, a) * 1e6) AS BIGINT) AS r_e6, CAST(round((covar_pop(y, a) * var_pop(b) - covar_pop(y, b) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) * covar_pop(a, b)) * 1e6) AS BIGINT) AS b1_e6 FROM r")
def sta2_least_squares(t):
    r = t("orders").select((F.col("o_orderkey") % 100).alias("y"), (F.col("o_custkey") % 17).alias("a"), (F.col("o_orderkey") % 13).alias("b"))
    return R.least_squares(r, "y", "a", "b").select("n", F.round(F.col("r") * 1e6).cast("long").alias("r_e6"), F.round(F.col("b1") * 1e6).cast("long").alias("b1_e6"))


@query("""WITH x AS (SELECT p_type AS f, p_size AS v, p_brand = 'Brand#1' AS h FROM part), t AS (SELECT f, v, count(*) AS n, sum(h::INT) AS k FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
s AS (SELECT f, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k * (2 * b + n + 1)) / 2 AS r, sum(n * n * n - n)::DOUBLE AS ti FROM c GROUP BY 1) SELECT f, n::BIGINT AS n, k::BIGINT AS k, CAST(round((r - k * (n + 1) / 2) / sqrt(k * (n - k) / 12 * (n + 1 - ti / (n * (n - 1)))) * 1e6) AS BIGINT) AS z_e6 FROM s WHERE k > 0 AND k < n""")
def sta4_rank_sum(t):
    return R.rank_sum_test(t("part"), "p_type", "p_brand", "p_size", "Brand#1").select(F.col("p_type").alias("f"), "n", "k", F.round(F.col("z") * 1e6).cast("long").alias("z_e6"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.25) FROM customer)")
def sta5_lowest_quartile(t):
    return R.lowest_share(t("customer"), "c_acctbal", 0.25).select("c_custkey", "c_acctbal")


@query("SELECT a.vec_id, CAST(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e6) AS BIGINT) AS cosine_e6 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ml6_cosine(t):
    e = t("embeddings")
    both = e.select("vec_id", S.normalised(F.col("embedding")).alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), S.normalised(F.col("embedding")).alias("b")), "vec_id")
    return both.select("vec_id", F.round(S.dot(F.col("a"), F.col("b")) * 1e6).cast("long").alias("cosine_e6"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dfl2_not_done(t):
    return P.not_done(t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT doc_id, length(text) AS n FROM documents")
def dfl3_once_each(t):
    return P.once_each(t("documents").select("doc_id", "text"), "text", lambda u: u.withColumn("n", F.length("text").cast("long"))).select("doc_id", "n")


@query("SELECT c_custkey, 100.0::DOUBLE * hamming(c_name, reverse(c_name)) / length(c_name) AS changed FROM customer")
def seq8_percent_changed(t):
    return t("customer").select("c_custkey", S.percent_changed(F.col("c_name"), F.reverse("c_name")).alias("changed"))


@query(f"""WITH {TERMS}, p AS (SELECT a.user_id, b.arm, a.terms AS x, b.terms AS y, len(list_intersect(a.terms, b.terms)) AS k FROM sets a JOIN sets b ON a.user_id = b.user_id WHERE a.arm = 'view' AND b.arm <> 'view')
SELECT user_id, arm, 1.0::DOUBLE - k / (len(x) + len(y) - k)::DOUBLE AS distance, k / len(x)::DOUBLE AS retention, x = y AS same FROM p""")
def set2_distance_and_retention(t):
    s = term_sets(t)
    a, b = s.where("arm = 'view'").select("user_id", F.col("terms").alias("x")), s.where("arm <> 'view'").select("user_id", "arm", F.col("terms").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "user_id").select("user_id", "arm", A.jaccard_distance(x, y).alias("distance"), A.retention(x, y).alias("retention"), A.same_set(x, y).alias("same"))


@query("SELECT p_brand, min(p_size) AS least, quantile_cont(p_size, 0.25) AS q25, quantile_cont(p_size, 0.5) AS median, quantile_cont(p_size, 0.75) AS q75, max(p_size) AS most FROM part GROUP BY 1")
def agg35_summaries(t):
    quartiles = [F.percentile("p_size", F.lit(q)).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return t("part").groupBy("p_brand").agg(F.min("p_size").alias("least"), *quartiles, F.max("p_size").alias("most"))


@query(f"WITH {EDGES} SELECT ancestor, count(DISTINCT term) AS descendants FROM closed GROUP BY 1")
def dag2_descendants(t):
    return O.closure(edges(t)).groupBy("ancestor").agg(F.count_distinct("term").alias("descendants"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM conversations),
w AS (SELECT *, regexp_extract(lower(substr(s, 1, 24)), '[a-z]+', 0) AS w, lower(substr(s, 1, 60)) AS more FROM c)
SELECT conv_id, turn, role, CASE WHEN w IN ('yes', 'yeah', 'yep') THEN 'yes' WHEN w IN ('no', 'nope') THEN 'no'
 WHEN regexp_matches(more, '(^|[^\p{L}\p{N}_])(no|not|absent|negative|none|lacks?|false|unlikely)([^\p{L}\p{N}_]|$)') THEN 'no'
 WHEN regexp_matches(more, '(^|[^\p{L}\p{N}_])(yes|present|positive|detected|contains?|true|likely)([^\p{L}\p{N}_]|$)') THEN 'yes' ELSE '' END AS answer, split_part(s, chr(10), 1) AS line FROM w""")
def txt7_yes_no(t):
    return t("conversations").select("conv_id", "turn", "role", T.yes_no(F.col("text")).alias("answer"), F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("line"))


# Without SQL: sequential matching and fits; the tests hold them against plain versions.
@query()
def jn11_greedy_nearest(t):
    c = t("customer")
    return P.greedy_nearest(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_nationkey", "c_custkey", "c_acctbal")


@query()
def seq2_dinucleotide_shuffle(t):
    return S.dinucleotide_shuffled(t("customer"), "c_custkey", "c_name")


@query()
def ml1_grouped_probe(t):
    from armwise.operators.probes import out_of_fold

    e = t("embeddings").withColumn("group", F.col("vec_id") % 50)
    return out_of_fold(e, "embedding", "label", "group", k=3, keep=["vec_id"]).select("vec_id", "fold", "label", "prediction")
