"""Registered queries of shards in order, donors that were tried, set tests, marker tables and prompt edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.functions import stats as A
from armwise.functions import text as T
from armwise.operators import pairing as P
from armwise.operators import resample as R
from armwise.plans.catalog import PICK, TERMS, query, term_sets


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 7)::INT AS turn, floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 7 / count(*) OVER ()::DOUBLE)::INT AS block FROM orders")
def win17_turns_and_blocks(t):
    return P.dealt_shards(t("orders").select("o_orderkey"), "o_orderkey", 7)


@query(f"""WITH p AS (SELECT c_nationkey AS g, c_custkey AS k, c_mktsegment AS a, c_custkey % 3 AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
q AS (SELECT g, k, a, b, t, {PICK.format("'try|' || t || '|' || k")} % n AS i FROM p, range(1, 9) r(t)), m AS (SELECT q.k, arg_min(p.k, q.t) AS donor FROM q JOIN p ON q.g = p.g AND q.i = p.i WHERE q.a <> p.a AND q.b <> p.b GROUP BY 1)
SELECT k AS c_custkey, donor FROM p LEFT JOIN m USING (k)""")
def jn17_tried_donors(t):
    """A donor of another label and of another genome, of eight random tries."""
    c = t("customer").withColumn("genome", F.col("c_custkey") % 3)
    return P.tried_donors(c, "c_custkey", ["c_nationkey"], ["c_mktsegment", "genome"])


@query(f"""WITH {TERMS} SELECT a.user_id, b.arm, list_has_all(b.terms, a.terms) AS kept, list_has_all(a.terms, b.terms) AS inside, a.terms = b.terms AS same FROM sets a JOIN sets b ON a.user_id = b.user_id WHERE a.arm = 'view' AND b.arm <> 'view'""")
def set7_subsets(t):
    s = term_sets(t)
    both = s.where("arm = 'view'").select("user_id", F.col("terms").alias("x")).join(s.where("arm <> 'view'").select("user_id", "arm", F.col("terms").alias("y")), "user_id")
    return both.select("user_id", "arm", A.subset(F.col("x"), F.col("y")).alias("kept"), A.subset(F.col("y"), F.col("x")).alias("inside"), A.same_set(F.col("x"), F.col("y")).alias("same"))


@query("""WITH x AS (SELECT p_brand AS f, ln(1 + p_size::DOUBLE) AS v, p_type = 'PROMO' AS h FROM part), t AS (SELECT f, v, count(*) AS n, sum(h::INT) AS k FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
s AS (SELECT f, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k * (2 * b + n + 1)) / 2.0::DOUBLE AS r, sum(n * n * n - n)::DOUBLE AS ti FROM c GROUP BY 1),
z AS (SELECT f, (r - k * (n + 1) / 2) / sqrt(k * (n - k) / 12 * (n + 1 - ti / (n * (n - 1)))) AS z FROM s WHERE k > 0 AND k < n), e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z),
p AS (SELECT f, z, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2) AS p FROM e),
q AS (SELECT f, z, least(1, min(p * m / r) OVER (ORDER BY p DESC, f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, f) AS r FROM p)),
m AS (SELECT f, log2((exp(avg(v) FILTER (h)) - 1 + 1e-9) / (exp(avg(v) FILTER (NOT h)) - 1 + 1e-9)) AS fold FROM x GROUP BY 1)
SELECT f, round(z * 1e6)::BIGINT AS z_e6, round(fold * 1e6)::BIGINT AS fold_e6, fold >= 0 AND q < 0.9 AS marker, CASE WHEN fold >= 0 AND q < 0.9 THEN round(-fold * log10(greatest(q, 1e-300)) * 1e6)::BIGINT END AS score_e6 FROM q JOIN m USING (f)""")
def sta4_markers(t):
    p = t("part").select("p_brand", "p_type", F.log1p(F.col("p_size").cast("double")).alias("v"))
    out = R.marker_table(p, "p_brand", "p_type", "v", "PROMO", least_fold=0.0, most_q=0.9)
    return out.select(F.col("p_brand").alias("f"), *[F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_e6") for c in ("z", "fold")], "marker", F.round(F.col("score") * 1e6).cast("long").alias("score_e6"))


@query("""WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS g FROM orders GROUP BY 1), u AS (SELECT o_custkey, unnest(g) AS v, unnest(range(1, len(g) + 1)) AS i FROM x),
n AS (SELECT *, sum((v = '1-URGENT')::INT) OVER (PARTITION BY o_custkey ORDER BY i) AS r FROM u) SELECT o_custkey, coalesce(list(CASE WHEN v = '1-URGENT' THEN ['a', 'b', 'c'][r::BIGINT] ELSE v END ORDER BY i) FILTER (v <> '1-URGENT' OR r <= 3), []) AS items FROM n GROUP BY 1""")
def seq9_items_replaced(t):
    held = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("g"))
    spare = F.array(*[F.lit(x) for x in "abc"])
    return held.select("o_custkey", S.replaced_items(F.transform("g", lambda x: x["o_orderpriority"]), F.array(F.lit("1-URGENT")), spare).alias("items"))


@query(r"""SELECT conv_id, turn, array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT starts_with(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), 'the')], chr(10)) AS rest,
array_to_string([split_part(x, ';', 1) FOR x IN string_split(text, chr(10))], chr(10)) AS short FROM conversations""")
def txt21_prompt_edits(t):
    return t("conversations").select("conv_id", "turn", T.lines_without(F.col("text"), "the").alias("rest"), T.without_descriptions(F.col("text")).alias("short"))
