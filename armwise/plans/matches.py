"""Registered queries that join records to donors, members and controls, and that build the arms of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.operators import ontology as O
from armwise.operators import pairing as P
from armwise.operators.reports import dealt
from armwise.plans.catalog import ARMS, EDGES, HASHED, PICK, SCORES, Tables, answers, candidate_scores, edges, query

DERANGED = f"""p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASHED.format('derange')}, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
d AS (SELECT a.c_custkey, b.c_custkey AS donor FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND b.i = a.i % a.n + 1 WHERE a.n > 1)"""


@query(f"WITH {DERANGED} SELECT c.c_custkey, d.donor, c.c_mktsegment, o.c_mktsegment AS donor_c_mktsegment FROM customer c JOIN d USING (c_custkey) JOIN customer o ON o.c_custkey = d.donor")
def jn3_donor_records(t):
    c = t("customer")
    return P.with_donor(c, P.deranged(c, "c_custkey", ["c_nationkey"]), "c_custkey", ["c_mktsegment"]).select("c_custkey", "donor", "c_mktsegment", "donor_c_mktsegment")


@query("SELECT x.l_orderkey AS a, x.l_partkey AS b, o.o_orderstatus AS o_orderstatus_a, p.o_orderstatus AS o_orderstatus_b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x LEFT JOIN orders o ON o.o_orderkey = x.l_orderkey LEFT JOIN orders p ON p.o_orderkey = x.l_partkey")
def jn4_both_members(t):
    pairs = t("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return P.with_members(pairs, t("orders"), "o_orderkey", ["o_orderstatus"])


LAYOUT = [("view", "input", "reference"), ("click", "input", "text"), ("error", "text", "text"), ("purchase", "text", "input")]


@query("SELECT event_id, family, source FROM events JOIN (VALUES " + ", ".join(map(str, LAYOUT)) + ") l(event_type, family, source) USING (event_type)")
def jn5_condition_layout(t):
    e = t("events")
    layout = e.sparkSession.createDataFrame(LAYOUT, "event_type string, family string, source string")
    return e.join(F.broadcast(layout), "event_type").select("event_id", "family", "source")  # a fixed table of conditions


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_returnflag FROM lineitem), m AS (SELECT n.l_partkey AS a, p.l_partkey AS b, max(p.q) AS score FROM s n JOIN s p USING (l_orderkey) WHERE n.l_returnflag = 'R' AND p.l_returnflag <> 'R' AND n.l_partkey <> p.l_partkey GROUP BY 1, 2)
SELECT a, b, score FROM m""")
def jn7_best_contrasts(t):
    s = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("score"), "l_returnflag")
    negative = s.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("a"))
    return P.contrasts(negative, s.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_partkey").alias("b"), "score"), ["l_orderkey"], "a", "b", "score").select("a", "b", "score")


@query("WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey")
def jn10_pairs_in_groups(t):
    return P.grouped_pairs(t("lineitem"), ["l_orderkey"], "l_partkey")


@query(f"""WITH u AS (SELECT c_custkey, c_nationkey, c_nationkey % 5 AS w, c_mktsegment AS s, {HASHED.format('donor')} AS h FROM customer),
n AS (SELECT a.c_custkey, first(b.c_custkey ORDER BY ((b.h, b.c_custkey) < (a.h, a.c_custkey))::INT, b.h, b.c_custkey) AS donor FROM u a JOIN u b ON a.c_nationkey = b.c_nationkey AND a.s <> b.s GROUP BY 1),
f AS (SELECT a.c_custkey, first(b.c_custkey ORDER BY ((b.h, b.c_custkey) < (a.h, a.c_custkey))::INT, b.h, b.c_custkey) AS donor FROM u a JOIN u b ON a.w = b.w AND a.s <> b.s GROUP BY 1)
SELECT f.c_custkey, coalesce(n.donor, f.donor) AS donor, (n.donor IS NOT NULL)::INT AS near FROM f LEFT JOIN n USING (c_custkey)""")
def jn12_near_or_any_donor(t):
    c = t("customer").withColumn("w", F.col("c_nationkey") % 5)
    return P.near_or_any_donors(c, "c_custkey", ["c_nationkey"], ["w"], "c_mktsegment").withColumn("near", F.col("near").cast("int"))


@query("""WITH c AS (SELECT c_nationkey, sum((c_mktsegment = 'BUILDING')::INT) AS t, sum((c_mktsegment = 'MACHINERY')::INT) AS p FROM customer GROUP BY 1)
SELECT c_nationkey, least(t, p)::BIGINT AS pairs, least(t, p)::BIGINT AS targets, least(t, p)::BIGINT AS controls FROM c WHERE least(t, p) > 0""")
def jn11_one_to_one(t):
    c = t("customer")
    pairs = P.greedy_nearest(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_nationkey", "c_custkey", "c_acctbal")
    return pairs.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("c_custkey").alias("targets"), F.count_distinct("control").alias("controls"))


@query(f"WITH {ARMS} SELECT d.user_id, d.arm, w.value AS wt_value, d.value FROM ans d JOIN ans w ON w.user_id = d.user_id AND w.arm = 'view' WHERE d.arm IN ('click', 'error')")
def jn19_derived_with_wt(t):
    a = answers(t)
    return P.paired_with_reference(a.where(F.col("arm").isin("view", "click", "error")), "user_id", "arm", "view", ["value"]).select("user_id", "arm", F.col("ref_value").alias("wt_value"), "value")


@query("""WITH x AS (SELECT p_partkey, p_name AS a, reverse(p_name) AS b FROM part), d AS (SELECT *, list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])[1] AS f FROM x)
SELECT p_partkey, CASE WHEN f IS NOT NULL THEN substr(a, greatest(1, f - 2), f + 3 - greatest(1, f - 2)) END AS seen FROM d""")
def jn21_around_difference(t):
    return t("part").select("p_partkey", S.around(F.col("p_name"), F.reverse("p_name"), 2, 3).alias("seen"))


@query(f"""WITH {SCORES}, l AS (SELECT DISTINCT cell, label FROM lab), p AS (SELECT x.cell AS a, y.cell AS b, x.label AS label_a, y.label AS label_b FROM l x JOIN l y ON y.cell = x.cell + 1)
SELECT a, b, (SELECT score FROM sc WHERE cell = a AND cand = label_a) AS a_a, (SELECT score FROM sc WHERE cell = a AND cand = label_b) AS a_b, (SELECT score FROM sc WHERE cell = b AND cand = label_a) AS b_a, (SELECT score FROM sc WHERE cell = b AND cand = label_b) AS b_b FROM p
WHERE EXISTS (SELECT 1 FROM sc WHERE cell IN (a, b))""")
def jn22_pair_scores(t):
    s = candidate_scores(t)
    cells = s.select("cell", "label").distinct()
    pairs = cells.select(F.col("cell").alias("a"), F.col("label").alias("label_a")).join(cells.select((F.col("cell") - 1).alias("a"), F.col("cell").alias("b"), F.col("label").alias("label_b")), "a")
    return P.pair_scores(pairs, s.select("cell", "cand", "score"), "cell", "cand", "score").drop("label_a", "label_b")


@query(f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {PICK.format(chr(39) + 'classes|' + chr(39) + ' || o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 100")
def win13_class_balanced(t):
    return P.balanced_sample(t("orders"), ["o_orderstatus"], 100, "o_orderkey", salt="classes").select("o_orderkey", "o_orderstatus")


@query("SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS rank FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def win14_longest_first(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc(F.length("p_name")), "p_name")
    return t("part").select("p_brand", "p_name").distinct().withColumn("rank", F.row_number().over(w).cast("long"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, (o_totalprice / 1000)::BIGINT AS n FROM orders), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT o_custkey, o_orderkey, n, floor(before / 700)::BIGINT AS batch FROM s""")
def win16_length_batches(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.rint(F.col("o_totalprice") / 1000).cast("long").alias("n"))  # a half goes to the even number, as in SQL's cast
    return P.batches(rows, ["o_custkey"], "o_orderkey", "n", 700)


@query(f"SELECT r_regionkey, string_agg('ACGT'[({PICK.format(chr(39) + 'neutral|' + chr(39) + ' || i')} % 4 + 1)::INT], '' ORDER BY i) AS neutral FROM region, range(1, 41) r(i) GROUP BY 1")
def seq4_neutral(t):
    return t("region").select("r_regionkey", S.neutral(40).alias("neutral"))


@query("""WITH x AS (SELECT p_partkey, [p_size, p_size + 1, p_size + 2, p_size + 3, p_size + 4]::BIGINT[] AS v FROM part), m AS (SELECT p_partkey, v, list_sort([{'k': md5(p_partkey || '|' || i), 'i': i, 'v': v[[1, 2, 4, 5][i + 1]]} FOR i IN range(0, 4)]) AS m FROM x)
SELECT p_partkey, array_to_string([m[1].v, m[2].v, v[3], m[3].v, m[4].v], ',') AS permuted, array_to_string([CASE WHEN i IN (2, 3) THEN 0 ELSE v[i] END FOR i IN range(1, 6)], ',') AS zeroed FROM m""")
def seq10_permuted_values(t):
    v = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("p_size") + i).cast("long"))
    permuted = S.permuted_values(v, F.array(*[F.lit(i) for i in (1, 2, 4, 5)]), F.col("p_partkey").cast("string"))
    zeroed = S.zeroed(F.transform(v, lambda x: x.cast("double")), F.array(F.lit(2), F.lit(3)))
    return t("part").select("p_partkey", F.array_join(permuted, ",").alias("permuted"), F.array_join(F.transform(zeroed, lambda x: x.cast("long").cast("string")), ",").alias("zeroed"))


@query(f"""WITH {SCORES}, c AS (SELECT DISTINCT p_type AS cand FROM part), a AS (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY cand) AS i FROM sc),
b AS (SELECT n.cell, c.cand, n.n, row_number() OVER (PARTITION BY n.cell ORDER BY {PICK.format("'scatter|' || n.cell || '|' || c.cand")}, c.cand) AS i FROM (SELECT cell, count(*) AS n FROM sc GROUP BY 1) n, c)
SELECT a.cell, b.cand, a.score FROM a JOIN b ON a.cell = b.cell AND a.i = b.i WHERE b.i <= b.n""")
def seq11_scattered_counts(t):
    return S.scattered(candidate_scores(t).select("cell", "cand", "score"), "cell", "cand", "score", t("part").select(F.col("p_type").alias("cand")).distinct())


@query(f"""WITH {SCORES}, g AS (SELECT cell, list(cand ORDER BY score DESC, cand) AS g FROM sc GROUP BY 1), k AS (SELECT cell, g, list_sort([{{'k': {PICK.format("cell || '|' || i")}, 'i': i}} FOR i IN range(0, len(g))])[1:3] AS k FROM g)
SELECT cell, [g[x + 1] FOR x IN list_sort([y.i FOR y IN k])] AS kept FROM k""")
def seq12_sampled_items(t):
    held = candidate_scores(t).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand"))).alias("g"))
    return held.select("cell", S.sampled_items(F.transform("g", lambda x: x["cand"]), 3, F.col("cell").cast("string")).alias("kept"))


_TYPES = "'ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'"


@query(f"""WITH o AS (SELECT p_partkey, p_type, [y.x FOR y IN list_sort([{{'k': md5(p_partkey || '|pick|' || x), 'x': x}} FOR x IN [{_TYPES}] IF x <> p_type])[1:3]] || [p_type] AS o FROM part)
SELECT p_partkey, [y.x FOR y IN list_sort([{{'k': md5(p_partkey || '|order|' || x), 'x': x}} FOR x IN o])] AS options FROM o""")
def seq13_option_lists(t):
    vocabulary = F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ECONOMY")])
    return t("part").select("p_partkey", S.option_list(F.col("p_type"), vocabulary, 4, F.col("p_partkey").cast("string")).alias("options"))


@query("""SELECT p_partkey, 'wt' AS condition, p_name AS text FROM part UNION ALL SELECT p_partkey, 'reversed', reverse(p_name) FROM part UNION ALL SELECT p_partkey, 'no_text', '' FROM part
UNION ALL SELECT p_partkey, 'mask_p25', repeat('x', (length(p_name) // 4)::INT) || substr(p_name, (length(p_name) // 4)::INT + 1) FROM part UNION ALL SELECT p_partkey, 'deleted', substr(p_name, 1, 1) || substr(p_name, 4) FROM part""")
def seq14_condition_arms(t):
    x = F.col("p_name")
    arms = {"wt": x, "reversed": F.reverse(x), "no_text": F.lit(""), "mask_p25": S.masked_block(x, "start", 0.25, "x"), "deleted": S.deleted(x, F.array(F.lit(2), F.lit(3)))}
    return S.arms_of(t("part"), "p_partkey", arms)


@query(f"WITH {DERANGED} SELECT c.c_custkey, 'swap_' || (c.c_custkey % 3) AS condition, c.c_name AS input, o.c_mktsegment AS text FROM customer c JOIN d USING (c_custkey) JOIN customer o ON o.c_custkey = d.donor")
def seq15_swapped_arms(t):
    c = t("customer")
    met = P.with_donor(c, P.deranged(c, "c_custkey", ["c_nationkey"]), "c_custkey", ["c_mktsegment"])
    return met.select("c_custkey", F.concat(F.lit("swap_"), F.col("c_custkey") % 3).alias("condition"), F.col("c_name").alias("input"), F.col("donor_c_mktsegment").alias("text"))


@query(f"WITH {SCORES}, g AS (SELECT cell, list(cand ORDER BY score DESC, cand) AS g FROM sc GROUP BY 1) SELECT cell, k::INT AS k, g[1:k] AS items FROM g, (VALUES (1), (2), (4)) v(k)")
def seq16_prefix_lists(t):
    held = candidate_scores(t).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand"))).alias("g"))
    return held.select("cell", F.explode(S.prefixes(F.transform("g", lambda x: x["cand"]), [1, 2, 4])).alias("x")).select("cell", "x.*")


FEATURES = "f AS (SELECT l_partkey, l_linenumber * 5 + l_suppkey % 5 AS s, l_linenumber * 5 + l_suppkey % 5 + l_suppkey % 7 AS e, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank, l_orderkey FROM lineitem)"


def features(t: Tables) -> DataFrame:
    s = F.col("l_linenumber") * 5 + F.col("l_suppkey") % 5
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t("lineitem").select("l_partkey", s.alias("s"), (s + F.col("l_suppkey") % 7).alias("e"), rank.alias("rank"), "l_orderkey")


@query(f"WITH {FEATURES}, x AS (SELECT l_partkey, rank, unnest(range(s, e + 1)) AS place FROM f) SELECT l_partkey, place, min(rank) AS evidence FROM x GROUP BY 1, 2")
def seq17_salient_places(t):
    return S.salient(features(t), "l_partkey", "s", "e", F.col("rank"))


@query(f"""WITH {FEATURES}, x AS (SELECT l_partkey, rank, unnest(range(s, e + 1)) AS place FROM f), b AS (SELECT l_partkey, place, min(rank) AS evidence FROM x GROUP BY 1, 2),
i AS (SELECT *, place - row_number() OVER (PARTITION BY l_partkey, evidence ORDER BY place) AS island FROM b) SELECT l_partkey, min(place)::BIGINT AS "start", max(place)::BIGINT AS "end", evidence FROM i GROUP BY l_partkey, evidence, island""")
def seq17_salient_segments(t):
    return S.salient_segments(features(t), "l_partkey", "s", "e", F.col("rank"))


@query(f"""WITH {FEATURES}, d AS (SELECT l_partkey, s, e, row_number() OVER (PARTITION BY l_partkey ORDER BY e - s DESC, l_orderkey, s) AS r FROM (SELECT l_partkey, l_orderkey, min(s) AS s, min(e) AS e FROM f GROUP BY 1, 2)),
c AS (SELECT l_partkey, count(DISTINCT place) AS covered FROM (SELECT l_partkey, unnest(range(min(s), min(e) + 1)) AS place FROM f GROUP BY l_partkey, l_orderkey) GROUP BY 1) SELECT l_partkey, s, e, covered FROM d JOIN c USING (l_partkey) WHERE r = 1""")
def seq18_largest_span(t):
    one = dealt(features(t), t("lineitem").count(), "l_partkey").groupBy("l_partkey", "l_orderkey").agg(F.min("s").alias("s"), F.min("e").alias("e"))
    return S.largest_span(one, "l_partkey", "s", "e", "l_orderkey")


@query("SELECT c_custkey, true AS same_pairs, true AS same_ends FROM customer")
def seq2_pairs_kept(t):
    made = S.dinucleotide_shuffled(t("customer"), "c_custkey", "c_name").join(t("customer").select("c_custkey", "c_name"), "c_custkey")

    def pairs(c: str):
        return F.array_sort(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))

    ends = (F.substring("shuffled", 1, 1) == F.substring("c_name", 1, 1)) & (F.substring("shuffled", -1, 1) == F.substring("c_name", -1, 1))
    return made.select("c_custkey", (pairs("shuffled") == pairs("c_name")).alias("same_pairs"), ends.alias("same_ends"))


@query("""WITH p AS (SELECT DISTINCT p_name FROM part), e AS (SELECT p_name AS child, 'a:' || split_part(p_name, ' ', 1) AS parent FROM p UNION SELECT 'a:' || split_part(p_name, ' ', 1), 'root' FROM p)
SELECT child AS term, parent AS ancestor, 1 AS distance FROM e UNION SELECT p_name, 'root', 2 FROM p UNION SELECT child, child, 0 FROM e UNION SELECT 'root', 'root', 0""")
def dag8_typed_closure(t):
    e = edges(t)
    nodes = e.select(F.col("child").alias("term")).union(e.select("parent")).distinct()
    return O.typed_closure(e, nodes.withColumn("type", F.when(F.startswith("term", F.lit("n:")), "other").otherwise("family")), "family")


@query(f"""WITH {EDGES}, c AS (SELECT DISTINCT term, ancestor FROM closed), s AS (SELECT DISTINCT o_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS side, CASE WHEN l_linenumber = 2 THEN 'a:' || split_part(p_name, ' ', 1) ELSE p_name END AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT k, bool_or(EXISTS (SELECT 1 FROM c WHERE (c.term = x.term AND c.ancestor = y.term) OR (c.term = y.term AND c.ancestor = x.term))) AS same FROM s x JOIN s y USING (k) WHERE x.side = 'x' AND y.side = 'y' GROUP BY 1""")
def dag9_same_type(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    term = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("a:"), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.col("p_name"))
    s = j.select(F.col("o_orderkey").alias("k"), (F.col("l_linenumber") % 2 == 0).alias("side"), term.alias("term")).distinct()
    return O.same_type(s.where("side").select("k", "term"), s.where("not side").select("k", "term"), O.closure(edges(t)), "k")
