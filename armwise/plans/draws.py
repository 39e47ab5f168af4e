"""Registered queries of resampling, fits and the remaining aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions import stats as A
from armwise.operators import metrics as M
from armwise.operators import ontology as O
from armwise.operators import probes as B
from armwise.operators import resample as R
from armwise.plans.catalog import EDGES, PICK, Tables, edges, query

# Units: nations with sums over their customers, by market segment.
UNITS = "SELECT c_mktsegment AS g, c_nationkey AS u, count(*) AS n, sum((c_custkey % 3 = 0)::INT)::BIGINT AS a, sum(c_custkey % 7)::BIGINT AS b FROM customer GROUP BY 1, 2"


def weights_sql(salt: str, n: int, by: str = "g", units: str = "un") -> str:
    return f"""pl AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS size FROM {units}),
pk AS (SELECT {by}, d AS draw, {PICK.format(f"'{salt}|' || d || '|' || i")} % size AS i FROM pl, range({n}) r(d)), wt AS (SELECT {by}, draw, i, count(*) AS w FROM pk GROUP BY ALL)"""


def units(t: Tables) -> DataFrame:
    c = t("customer")
    return c.groupBy(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c_custkey") % 3 == 0).cast("long")).alias("a"), F.sum(F.col("c_custkey") % 7).alias("b"))


@query(f"WITH un AS ({UNITS}), {weights_sql('weights', 100)} SELECT wt.g, draw, sum(w * n)::BIGINT AS n, sum(w * a)::BIGINT AS a, sum(w * b)::BIGINT AS b FROM wt JOIN pl ON pl.g = wt.g AND pl.i = wt.i GROUP BY 1, 2")
def bst3_shared_weights(t):
    u = units(t)
    return R.weighted_sums(u, R.unit_weights(u, ["g"], "u", 100), ["g"], "u", ["n", "a", "b"]).withColumn("draw", F.col("draw").cast("long"))


@query(f"""WITH un AS ({UNITS}), {weights_sql('weights', 100)}, s AS (SELECT wt.g, draw, sum(w * a) / sum(w * n)::DOUBLE AS r, sum(w * b) / sum(w * n)::DOUBLE AS m FROM wt JOIN pl ON pl.g = wt.g AND pl.i = wt.i GROUP BY 1, 2)
SELECT g, round(quantile_cont(r, 0.025) * 1e6)::BIGINT AS r_low, round(quantile_cont(r, 0.975) * 1e6)::BIGINT AS r_high, round(quantile_cont(m, 0.025) * 1e6)::BIGINT AS m_low, round(quantile_cont(m, 0.975) * 1e6)::BIGINT AS m_high FROM s GROUP BY 1""")
def bst6_many_intervals(t):
    u = units(t)
    s = R.weighted_sums(u, R.unit_weights(u, ["g"], "u", 100), ["g"], "u", ["n", "a", "b"]).select("g", (F.col("a") / F.col("n")).alias("r"), (F.col("b") / F.col("n")).alias("m"))
    r, m = (R.interpolated_interval(s, ["g"], c) for c in ("r", "m"))
    both = r.withColumnsRenamed({"ci_low": "r_low", "ci_high": "r_high"}).join(m.withColumnsRenamed({"ci_low": "m_low", "ci_high": "m_high"}), "g")
    return both.select("g", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("r_low", "r_high", "m_low", "m_high")])


CLASSES = "SELECT 0 AS g, o_custkey % 40 AS u, sum((o_orderstatus = 'F')::INT)::BIGINT AS n1, sum((o_orderstatus = 'F' AND o_orderkey % 3 > 0)::INT)::BIGINT AS k1, sum((o_orderstatus <> 'F')::INT)::BIGINT AS n0, sum((o_orderstatus <> 'F' AND o_orderkey % 4 > 0)::INT)::BIGINT AS k0 FROM orders GROUP BY 2"


@query(f"""WITH un AS ({CLASSES}), {weights_sql('family', 100)}, s AS (SELECT draw, (sum(w * k1) / sum(w * n1)::DOUBLE + sum(w * k0) / sum(w * n0)::DOUBLE) / 2 AS b FROM wt JOIN pl ON pl.g = wt.g AND pl.i = wt.i GROUP BY 1)
SELECT draw, round(b * 1e9)::BIGINT AS balanced_e9 FROM s""")
def bst7_family_balanced_accuracy(t):
    f, hit = F.col("o_orderstatus") == "F", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3 > 0).otherwise(F.col("o_orderkey") % 4 > 0)
    u = t("orders").groupBy(F.lit(0).alias("g"), (F.col("o_custkey") % 40).alias("u")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("n1", f), ("k1", f & hit), ("n0", ~f), ("k0", ~f & hit))])
    s = R.weighted_sums(u, R.unit_weights(u, ["g"], "u", 100, "family"), ["g"], "u", ["n1", "k1", "n0", "k0"])
    return s.select(F.col("draw").cast("long").alias("draw"), F.round((F.col("k1") / F.col("n1") + F.col("k0") / F.col("n0")) / 2 * 1e9).cast("long").alias("balanced_e9"))


POINTS = "SELECT 0 AS g, l_suppkey % 30 AS u, l_linenumber AS k, sum(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 2, 3"


@query(f"""WITH po AS ({POINTS}), un AS (SELECT DISTINCT g, u FROM po), {weights_sql('slope', 50)}, s AS (SELECT draw, k AS x, sum(w * q)::DOUBLE AS y, sum(w * n)::DOUBLE AS c FROM wt JOIN pl ON pl.g = wt.g AND pl.i = wt.i JOIN po ON po.u = pl.u GROUP BY 1, 2)
SELECT draw, round((sum(c) * sum(c * x * (y / c)) - sum(c * x) * sum(c * (y / c))) / (sum(c) * sum(c * x * x) - sum(c * x) * sum(c * x)) * 1e6)::BIGINT AS slope_e6 FROM s GROUP BY 1""")
def bst8_weighted_slope(t):
    po = t("lineitem").groupBy(F.lit(0).alias("g"), (F.col("l_suppkey") % 30).alias("u"), F.col("l_linenumber").alias("x")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))
    w = R.unit_weights(po, ["g"], "u", 50, "slope")
    means = po.join(w, ["g", "u"]).groupBy("draw", "x").agg((F.sum(F.col("weight") * F.col("q")) / F.sum(F.col("weight") * F.col("n"))).alias("y"), F.sum(F.col("weight") * F.col("n")).cast("double").alias("c"))
    return R.weighted_slope(means, ["draw"], "x", "y", "c").select(F.col("draw").cast("long").alias("draw"), F.round(F.col("slope") * 1e6).cast("long").alias("slope_e6"))


EXACT = "SELECT l_orderkey % 50 AS u, CASE l_returnflag WHEN 'A' THEN 'wt' ELSE 'alt' END AS arm, CASE l_linestatus WHEN 'F' THEN 'x' ELSE 'y' END AS aspect, sum((l_partkey % 3 = 0)::INT)::BIGINT AS tp, count(*) AS p, count(*) + sum((l_partkey % 5 = 0)::INT)::BIGINT AS g FROM lineitem GROUP BY 1, 2, 3"


@query(f"""WITH pa AS ({EXACT}), un AS (SELECT DISTINCT 0 AS g, u FROM pa), {weights_sql('f1', 60)}, s AS (SELECT draw, arm, aspect, sum(w * tp) AS tp, sum(w * p) AS p, sum(w * pa.g) AS gg FROM wt JOIN pl ON pl.g = wt.g AND pl.i = wt.i JOIN pa ON pa.u = pl.u GROUP BY 1, 2, 3),
f AS (SELECT draw, arm, avg(2 * tp / (p + gg)::DOUBLE) AS f1 FROM s GROUP BY 1, 2) SELECT w.draw, round((a.f1 - w.f1) * 1e9)::BIGINT AS difference_e9 FROM f w JOIN f a ON a.draw = w.draw AND a.arm = 'alt' WHERE w.arm = 'wt'""")
def bst5_paired_f1(t):
    li = t("lineitem")
    arm, aspect = F.when(F.col("l_returnflag") == "A", "wt").otherwise("alt"), F.when(F.col("l_linestatus") == "F", "x").otherwise("y")
    pa = li.groupBy((F.col("l_orderkey") % 50).alias("u"), arm.alias("arm"), aspect.alias("aspect")).agg(F.sum((F.col("l_partkey") % 3 == 0).cast("long")).alias("tp"), F.count(F.lit(1)).alias("p"), (F.count(F.lit(1)) + F.sum((F.col("l_partkey") % 5 == 0).cast("long"))).alias("g"))
    w = R.unit_weights(pa.select(F.lit(0).alias("one"), "u"), ["one"], "u", 60, "f1")
    s = pa.join(w, "u").groupBy("draw", "arm", "aspect").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("tp", "p", "g")])
    f = s.groupBy("draw").agg(*[F.avg(F.when(F.col("arm") == a, 2 * F.col("tp") / (F.col("p") + F.col("g")))).alias(a) for a in ("wt", "alt")])
    return f.select(F.col("draw").cast("long").alias("draw"), F.round((F.col("alt") - F.col("wt")) * 1e9).cast("long").alias("difference_e9"))


@query(f"""WITH u AS (SELECT c_custkey AS c, c_custkey % 11 - 5 AS d FROM customer), f AS (SELECT r.d AS draw, sum(CASE WHEN {PICK.format("'flip|' || r.d || '|' || c")} % 2 = 0 THEN u.d ELSE -u.d END) AS s FROM u, range(200) r(d) GROUP BY 1), o AS (SELECT count(*) AS n, sum(d)::BIGINT AS observed FROM u)
SELECT n, observed, sum((abs(s) >= abs(observed))::INT)::BIGINT AS ge, (sum((abs(s) >= abs(observed))::INT) + 1) / 201::DOUBLE AS p FROM f, o GROUP BY n, observed""")
def prm2_two_sided(t):
    return R.sign_flip(t("customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 11 - 5).alias("d")), "c", "d", 200, two_sided=True)


@query("""WITH c AS (SELECT p_type, sum((h AND x)::INT)::DOUBLE AS a, sum((NOT h AND x)::INT)::DOUBLE AS b, sum((h AND NOT x)::INT)::DOUBLE AS c, sum((NOT h AND NOT x)::INT)::DOUBLE AS d FROM (SELECT p_type, p_size > 25 AS x, p_partkey % 3 = 0 AS h FROM part) GROUP BY 1)
SELECT p_type, round(a * d / (b * c) * 1e3)::BIGINT AS odds_e3 FROM c WHERE a * b * c * d > 0""")
def sta3_odds_ratio(t):
    x, h = (F.col("p_size") > 25).cast("int"), (F.col("p_partkey") % 3 == 0).cast("int")
    cells = t("part").groupBy("p_type", x.alias("x"), h.alias("h")).agg(F.count(F.lit(1)).alias("w"))
    return R.logistic_odds(cells, ["p_type"], ["x"], "h", "w").where("term = 'x'").select("p_type", F.round(F.col("odds_ratio") * 1e3).cast("long").alias("odds_e3"))


_ODDS = " + ".join(f"({PICK.format(chr(39) + 'odds|' + chr(39) + ' || d || ' + chr(39) + '|' + chr(39) + ' || u')} / 281474976710656.0::DOUBLE >= {c!r}::DOUBLE)::INT" for c in R.POISSON)


# With one covariate of two values the fit is the cross product of four sums, draw by draw.
@query(f"""WITH c AS (SELECT c_custkey % 40 AS u, c_acctbal > 4500 AS x, c_custkey % 3 = 0 AS h, count(*) AS n FROM customer GROUP BY ALL), d AS (SELECT *, CASE WHEN d < 0 THEN 1 ELSE {_ODDS} END AS w FROM c, range(-1, 60) r(d)),
s AS (SELECT d, sum(CASE WHEN h AND x THEN w * n END)::DOUBLE AS a, sum(CASE WHEN NOT h AND x THEN w * n END)::DOUBLE AS b, sum(CASE WHEN h AND NOT x THEN w * n END)::DOUBLE AS c, sum(CASE WHEN NOT h AND NOT x THEN w * n END)::DOUBLE AS e FROM d GROUP BY 1)
SELECT round(max(CASE WHEN d < 0 THEN a * e / (b * c) END) * 1e4)::BIGINT AS odds_e4, round(quantile_cont(a * e / (b * c), 0.025) FILTER (d >= 0) * 1e4)::BIGINT AS low_e4, round(quantile_cont(a * e / (b * c), 0.975) FILTER (d >= 0) * 1e4)::BIGINT AS high_e4 FROM s""")
def sta3_odds_interval(t):
    c = t("customer").select((F.col("c_custkey") % 40).alias("u"), (F.col("c_acctbal") > 4500).cast("int").alias("x"), (F.col("c_custkey") % 3 == 0).cast("int").alias("h"), F.lit(1).cast("long").alias("w"))
    out = R.odds_intervals(c, [], ["x"], "h", "w", "u", 60).where("term = 'x'")
    return out.select(*[F.round(F.col(c) * 1e4).cast("long").alias(n) for c, n in (("odds_ratio", "odds_e4"), ("ci_low", "low_e4"), ("ci_high", "high_e4"))])


@query()
def sta3_odds_of_slots(t):
    """Three covariates over all lines, resampled by order: what cites a slot, its place, its size and its return."""
    li = t("lineitem").select(F.col("l_orderkey").alias("u"), F.least(F.lit(9), (F.col("l_linenumber") * 10 / 8).cast("int")).alias("decile"), (F.col("l_quantity") > 25).cast("int").alias("large"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_linestatus") == "F").cast("int").alias("cited"), F.lit(1).cast("long").alias("w"))
    return R.odds_intervals(li, [], ["decile", "large", "returned"], "cited", "w", "u", 40)


@query(f"""WITH {EDGES}, w AS (SELECT DISTINCT ancestor AS term, length(ancestor) % 4 AS weight FROM closed), x AS (SELECT DISTINCT l_orderkey AS e, l_returnflag AS arm, ancestor AS term FROM lineitem JOIN part ON l_partkey = p_partkey JOIN closed ON term = p_name),
g AS (SELECT DISTINCT e, term FROM x WHERE arm <> 'R'), gn AS (SELECT e, sum(weight) AS g FROM g JOIN w USING (term) GROUP BY 1), s AS (SELECT arm, e, sum(weight) AS p, sum(CASE WHEN h THEN weight ELSE 0 END) AS tp FROM (SELECT x.*, g.e IS NOT NULL AS h FROM x LEFT JOIN g ON g.e = x.e AND g.term = x.term) JOIN w USING (term) GROUP BY 1, 2)
SELECT arm, (SELECT count(*) FROM gn) AS entities, sum((p > 0)::INT)::BIGINT AS predicting, round(avg(CASE WHEN p > 0 THEN tp / p::DOUBLE END) * 1e6)::BIGINT AS precision_e6, round(sum(tp / g::DOUBLE) / (SELECT count(*) FROM gn) * 1e6)::BIGINT AS recall_e6 FROM s JOIN gn USING (e) GROUP BY 1""")
def agg21_weighted_f1(t):
    closed = O.closure(edges(t))
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("arm"), F.col("p_name").alias("term"))
    up = O.propagated(rows, closed, ["entity", "arm"]).withColumn("aspect", F.lit("all"))
    w = closed.select(F.col("ancestor").alias("term")).distinct().withColumn("weight", (F.length("term") % 4).cast("double"))
    out = M.propagated_f1(up.where("arm <> 'R'"), up, ["arm"], weights=w)
    return out.select("arm", "entities", "predicting", F.round(F.col("precision") * 1e6).cast("long").alias("precision_e6"), F.round(F.col("recall") * 1e6).cast("long").alias("recall_e6"))


@query("WITH o AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1) SELECT count(*) AS n, round(avg(1.0::DOUBLE / k) * 1e9)::BIGINT AS chance_e9 FROM o")
def agg25_chance(t):
    o = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("options"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.size("options")) * 1e9).cast("long").alias("chance_e9"))


@query("""WITH r AS (SELECT least(9, l_linenumber * 10 // 8) AS decile, sum((l_linestatus = 'F' AND l_quantity > 25)::INT) AS a, sum((l_linestatus = 'F')::INT) AS b, sum((l_linestatus <> 'F' AND l_quantity > 25)::INT) AS c, sum((l_linestatus <> 'F')::INT) AS d FROM lineitem GROUP BY GROUPING SETS ((1), ()))
SELECT decile::BIGINT AS decile, (a / greatest(b::DOUBLE, 1e-12)) / greatest(c / greatest(d::DOUBLE, 1e-12), 1e-12) AS ratio FROM r""".replace("GROUPING SETS ((1), ())", "GROUPING SETS ((least(9, l_linenumber * 10 // 8)), ())"))
def agg31_rate_ratio(t):
    li = t("lineitem").select(A.decile(F.col("l_linenumber"), F.lit(8)).alias("decile"), (F.col("l_linestatus") == "F").alias("f"), (F.col("l_quantity") > 25).alias("q"))
    sums = [M.count_if(F.col("f") & F.col("q")).alias("a"), M.count_if(F.col("f")).alias("b"), M.count_if(~F.col("f") & F.col("q")).alias("c"), M.count_if(~F.col("f")).alias("d")]
    both = li.rollup("decile").agg(*sums)
    return both.select("decile", A.ratio(A.ratio(F.col("a"), F.col("b")), A.ratio(F.col("c"), F.col("d"))).alias("ratio"))


@query("""WITH e AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, embedding, label FROM embeddings), d AS (SELECT a.pair, a.label, a.embedding[1]::DOUBLE - b.embedding[1] AS d1, a.embedding[64]::DOUBLE - b.embedding[64] AS d64 FROM e a JOIN e b ON a.pair = b.pair WHERE a.side = 0 AND b.side = 1)
SELECT pair, label, d1, d64 FROM d UNION ALL SELECT pair, 1 - label, -d1, -d64 FROM d""")
def ml2_pair_differences(t):
    e = t("embeddings").select((F.col("vec_id") / 2).cast("long").alias("pair"), (F.col("vec_id") % 2).alias("side"), "embedding", "label")
    return B.pair_differences(e, "pair", "side", "embedding", "label").select("pair", "label", F.col("difference")[0].alias("d1"), F.col("difference")[63].alias("d64"))


FOLD = "({}) % 3"


@query(f"""WITH s AS (SELECT unnest(['seed0', 'seed1']) AS salt, unnest([0, 1]) AS seed), f AS (SELECT seed, p_partkey, p_name, p_type, {FOLD.format(PICK.format("salt || '|' || p_name"))} AS fold FROM part, s),
c AS (SELECT seed, fold, p_type, count(*) AS n FROM f GROUP BY ALL), o AS (SELECT a.seed, a.fold, c.p_type, sum(c.n) AS n FROM (SELECT DISTINCT seed, fold FROM f) a JOIN c ON c.seed = a.seed AND c.fold <> a.fold GROUP BY ALL),
m AS (SELECT seed, fold, p_type AS pred FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY n DESC, p_type) AS r FROM o) WHERE r = 1)
SELECT seed, fold::INT AS fold, count(*) AS n, sum((p_type = pred)::INT)::BIGINT AS hits FROM f JOIN m USING (seed, fold) GROUP BY 1, 2""")
def ml3_majority_over_folds(t):
    def run(rows: DataFrame, salt: str) -> DataFrame:
        f = B.folds(rows, "p_name", 3, salt)
        counts = f.groupBy("fold", "p_type").agg(F.count(F.lit(1)).alias("n"))
        others = counts.withColumnRenamed("fold", "_f").join(f.select("fold").distinct(), F.col("_f") != F.col("fold")).groupBy("fold", "p_type").agg(F.sum("n").alias("n"))
        best = others.groupBy("fold").agg(F.min_by("p_type", F.struct((-F.col("n")).alias("n"), "p_type")).alias("pred"))
        return f.join(best, "fold").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), M.count_if(F.col("p_type") == F.col("pred")).alias("hits"))

    return B.repeated(t("part"), run, [0, 1])


@query("""WITH e AS (SELECT vec_id // 10 AS k, vec_id % 10 AS place, embedding FROM embeddings), b AS (SELECT k, min(place) AS lo, max(place) AS hi FROM e GROUP BY 1), i AS (SELECT e.* FROM e JOIN b USING (k) WHERE place > lo AND place < hi)
SELECT k, 128 AS numbers, round(avg(embedding[1]::DOUBLE) * 1e6)::BIGINT AS mean1_e6, max(embedding[64])::DOUBLE AS most64 FROM i GROUP BY 1""")
def ml5_pooled_rows(t):
    e = t("embeddings").select((F.col("vec_id") / 10).cast("long").alias("k"), (F.col("vec_id") % 10).alias("place"), "embedding")
    return B.pooled(e, "k", "place", "embedding").select("k", F.size("pooled").alias("numbers"), F.round(F.col("pooled")[0] * 1e6).cast("long").alias("mean1_e6"), F.col("pooled")[127].alias("most64"))


@query("SELECT vec_id, label, " + PICK.format("'fold|' || (vec_id % 50)") + " % 3 AS fold FROM embeddings")
def ml1_folds(t):
    return B.folds(t("embeddings").withColumn("group", F.col("vec_id") % 50), "group", 3).select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


_W = " + ".join(f"({PICK.format(chr(39) + 'poisson|' + chr(39) + ' || d || ' + chr(39) + '|' + chr(39) + ' || p_partkey')} / 281474976710656.0::DOUBLE >= {c!r}::DOUBLE)::INT" for c in R.POISSON)


@query(f"WITH w AS (SELECT p_type, d AS draw, p_size, {_W} AS w FROM part, range(40) r(d)) SELECT p_type, draw, sum(w * p_size)::BIGINT AS v, sum(w)::BIGINT AS n FROM w GROUP BY 1, 2")
def bst1_poisson_mean(t):
    return R.poisson_mean(t("part").select("p_type", "p_partkey", F.col("p_size").cast("long").alias("v")), ["p_type"], "v", "p_partkey", 40).withColumn("draw", F.col("draw").cast("long"))


@query(f"""WITH p AS (SELECT c_custkey AS c, c_custkey % 7 AS a, c_custkey % 5 AS b, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), k AS (SELECT d AS draw, {PICK.format("'paired|' || d || '|' || i")} % n AS i FROM p, range(30) r(d))
SELECT draw, (sum(a) - sum(b)) / count(*)::DOUBLE AS difference FROM k JOIN p USING (i) GROUP BY 1""")
def bst4_paired_customers(t):
    rows = t("customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 7).alias("a"), (F.col("c_custkey") % 5).alias("b"))
    return R.paired_difference(rows, "c", "a", "b", 30).withColumn("draw", F.col("draw").cast("long"))


@query("WITH s AS (SELECT l_returnflag || l_linestatus AS arm, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem GROUP BY 1) SELECT list_sort(list(arm)) AS arms, len(l)::BIGINT AS entities FROM s GROUP BY l")
def set6_coverage_classes(t):
    return M.coverage_classes(t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("arm"), F.col("l_linenumber").alias("e")), "arm", "e")
