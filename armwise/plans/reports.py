"""Registered queries that are whole reports: every statistic of a scoring with its interval, as one long table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from armwise.functions.sequence import pick
from armwise.operators import reports as P
from armwise.operators import resample as R
from armwise.plans.catalog import ARMS, PICK, TERMS, Tables, answers, query, term_sets

DRAWS, FLIPS = 40, 60


def weights_sql(units: str, unit: str, n: int = DRAWS) -> str:
    """CTE wt(u, draw, w): Poisson(1) weights above 0 by hash; draw -1 weighs 1."""
    u = PICK.format("'report|' || d || '|' || u") + " / 281474976710656.0::DOUBLE"
    w = " + ".join(f"(x >= {c!r}::DOUBLE)::INT" for c in R.POISSON)
    return f"""wx AS (SELECT u, d AS draw, {u} AS x FROM (SELECT DISTINCT {unit} AS u FROM {units}), range(-1, {n}) r(d)), wt AS (SELECT u, draw, w FROM (SELECT u, draw, CASE WHEN draw < 0 THEN 1 ELSE {w} END AS w FROM wx) WHERE w > 0)"""


def bounds_sql(rows: str, by: str, section: str) -> str:
    """A SELECT of section, by, series, n, value and bounds from rows of (by, series, draw, n, v)."""
    return f"""SELECT '{section}' AS section, {by}, series, max(n) FILTER (draw < 0)::BIGINT AS n, round(max(v) FILTER (draw < 0) * 1e6)::BIGINT AS value_e6, round(quantile_cont(v, 0.025) FILTER (draw >= 0) * 1e6)::BIGINT AS low_e6, round(quantile_cont(v, 0.975) FILTER (draw >= 0) * 1e6)::BIGINT AS high_e6 FROM ({rows}) GROUP BY {by}, series"""


def flips_sql(rows: str, unit: str, d: str, n: int = FLIPS) -> str:
    """A SELECT of arm and p_e6 of one-sided random signs."""
    s = f"CASE WHEN r.d < 0 OR {PICK.format(f'{chr(39)}flip|{chr(39)} || r.d || {chr(39)}|{chr(39)} || {unit}')} % 2 = 0 THEN {d} ELSE -{d} END"
    return f"""SELECT a.arm, CASE WHEN a.n < 3 THEN NULL WHEN a.any = 0 THEN 1000000 ELSE round((sum((b.s >= a.s)::INT) + 1) / {n + 1}::DOUBLE * 1e6)::BIGINT END AS p_e6 FROM (SELECT arm, sum({d}) AS s, count(*) AS n, sum(abs({d})) AS any FROM {rows} GROUP BY 1) a
JOIN (SELECT arm, r.d AS draw, sum({s}) AS s FROM {rows}, range({n}) r(d) GROUP BY 1, 2) b ON a.arm = b.arm GROUP BY a.arm, a.n, a.any"""


def long_sql(rows: str, by: str, stats: dict[str, tuple[str, str]], extra: str = "") -> str:
    """Rows of (by, series, draw, n, v) for each statistic of a drawn table."""
    return " UNION ALL ".join(f"SELECT {by}, draw, '{k}' AS series, {n} AS n, {v} AS v FROM {rows} {extra}" for k, (n, v) in stats.items())


def q(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)"


_ANSWERED = f"""{ARMS}, a AS (SELECT user_id, user_id // 2 AS unit, (user_id % 3)::VARCHAR AS split, arm, nullif(pred, 4) AS pred, coalesce(nullif(pred, 4) = gold, false)::BIGINT AS correct, (pred <> 4)::BIGINT AS mapped, (value >= 2)::BIGINT AS answered, (pred >= gold)::BIGINT AS named FROM ans),
{weights_sql('a', 'unit')}, pl AS (SELECT arm, draw, sum(w) AS n, sum(w * correct) AS c, sum(w * mapped) AS m, sum(w * answered) AS a, sum(w * named) AS g FROM a JOIN wt ON unit = u GROUP BY 1, 2), ps AS (SELECT arm, split, draw, sum(w) AS n, sum(w * correct) AS c FROM a JOIN wt ON unit = u GROUP BY 1, 2, 3),
k1 AS (SELECT arm, unit, round(sum(correct) / count(*)::DOUBLE * 1e6)::BIGINT AS m FROM a GROUP BY 1, 2), k2 AS (SELECT arm, unit, round(sum(correct) / count(*)::DOUBLE * 1e6)::BIGINT AS m FROM a WHERE answered = 1 GROUP BY 1, 2),
d1 AS (SELECT arm, draw, sum(w * m) AS m, sum(w) AS n FROM k1 JOIN wt ON unit = u GROUP BY 1, 2), d2 AS (SELECT arm, draw, sum(w * m) AS m, sum(w) AS n FROM k2 JOIN wt ON unit = u GROUP BY 1, 2),
pr AS (SELECT x.arm, x.unit, r.correct - x.correct AS d, (x.pred IS DISTINCT FROM r.pred)::BIGINT AS changed FROM a x JOIN a r ON r.user_id = x.user_id AND r.arm = 'view' WHERE x.arm <> 'view'), k3 AS (SELECT arm, unit, round(sum(d) / count(*)::DOUBLE * 1e6)::BIGINT AS m FROM pr GROUP BY 1, 2),
d3 AS (SELECT arm, draw, sum(w * m) AS m, sum(w) AS n FROM k3 JOIN wt ON unit = u GROUP BY 1, 2), d4 AS (SELECT arm, draw, sum(w * changed) AS c, sum(w) AS n FROM pr JOIN wt ON unit = u GROUP BY 1, 2)"""


@query(f"""WITH {_ANSWERED}, o AS ({bounds_sql(long_sql('pl', 'arm', {'accuracy_rows': ('n', q('c', 'n')), 'reached': ('n', q('g', 'n')), 'unmapped': ('n', q('n - m', 'n')), 'no_answer': ('n', q('n - a', 'n'))}), 'arm', 'arm')}
UNION ALL {bounds_sql(long_sql('d1', 'arm', {'accuracy': ('n', q('m', 'n') + ' / 1e6')}), 'arm', 'arm')} UNION ALL {bounds_sql(long_sql('d2', 'arm', {'accuracy_answered': ('n', q('m', 'n') + ' / 1e6')}), 'arm', 'arm')}
UNION ALL {bounds_sql('SELECT arm, draw, split AS series, n, ' + q('c', 'n') + ' AS v FROM ps', 'arm', 'split')} UNION ALL {bounds_sql(long_sql('d3', 'arm', {'loss': ('n', q('m', 'n') + ' / 1e6')}), 'arm', 'delta')}
UNION ALL {bounds_sql(long_sql('d4', 'arm', {'changed': ('n', q('c', 'n'))}), 'arm', 'delta')}), f AS ({flips_sql('k3', 'unit', 'm')}) SELECT o.*, p_e6 FROM o LEFT JOIN f ON o.arm = f.arm AND series = 'loss'""")
def score_bioreason_report(t):
    """Every arm's accuracies and rates, accuracy by split, and its losses against the reference arm, with intervals and p."""
    pred = F.nullif(F.col("pred"), F.lit(4).cast("long"))
    a = answers(t).select(
        F.col("user_id").alias("entity"), F.floor(F.col("user_id") / 2).cast("long").alias("unit"), (F.col("user_id") % 3).alias("split"), "arm", pred.alias("pred"), (pred == F.col("gold")).alias("correct"),
        (F.col("pred") != 4).alias("mapped"), (F.col("value") >= 2).alias("answered"), (F.col("pred") >= F.col("gold")).alias("named"))
    return P.arm_report(a, n_draws=DRAWS).unionByName(P.delta_report(a, "view", n_draws=DRAWS, n_flips=FLIPS))


@query("""WITH x AS (SELECT p_partkey AS k, p_name AS t, p_brand AS v, p_type AS l, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE ['ECONOMY', 'LARGE', 'MEDIUM'][(p_size % 3 + 1)::INT] END AS p FROM part),
j AS (SELECT a.l <> b.l AS s, a.p <> b.p AS c, (a.l = a.p)::INT + (b.l = b.p)::INT AS r FROM x a JOIN x b ON a.t = b.t AND a.k < b.k AND a.v <> b.v)
SELECT n.stratum, count(c) AS pairs, coalesce(sum(c::INT), 0)::BIGINT AS changed, coalesce(sum((r = 2)::INT), 0)::BIGINT AS "both", coalesce(sum((r = 1)::INT), 0)::BIGINT AS "one", coalesce(sum((r = 0)::INT), 0)::BIGINT AS "neither" FROM (VALUES ('sensitivity', true), ('stability', false)) n(stratum, s) LEFT JOIN j USING (s) GROUP BY 1""")
def pair_response_report(t):
    """Pairs of one text with different variants, counted without being made."""
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.get(F.array(F.lit("ECONOMY"), F.lit("LARGE"), F.lit("MEDIUM")), F.col("p_size") % 3))
    return P.pair_report(t("part").withColumn("said", said), "p_name", "p_brand", "p_type", "said")


# Terms' ancestors here: t0 ... t6 have u0 ... u3, each aspect's other terms none. Gold: the terms of a user's even events.
_UP = "SELECT DISTINCT {keys}, CASE WHEN left(term, 1) = 't' THEN 'x' ELSE 'y' END AS aspect, unnest(CASE WHEN left(term, 1) = 't' THEN [term, 'u' || (substr(term, 2)::INT // 2)] ELSE [term] END) AS term FROM {rows}"
_F1 = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
_SETS = f"""{TERMS}, gt AS (SELECT DISTINCT user_id, unnest([('t' || (CAST(floor(value) AS BIGINT) % 7)), 'g' || (event_id % 3)]) AS term FROM events WHERE event_id % 2 = 0),
gs AS (SELECT user_id, list(term) AS terms FROM gt GROUP BY 1), {weights_sql('sets', 'user_id')},
mv AS (SELECT a.arm, a.user_id, (a.terms = r.terms)::BIGINT AS kept, round((1 - len(list_intersect(a.terms, r.terms)) / len(list_distinct(list_concat(a.terms, r.terms)))::DOUBLE) * 1e6)::BIGINT AS moved, ['size:' || least(3, len(r.terms)), 'parity:' || (a.user_id % 2)] AS axes FROM sets a JOIN sets r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view'),
md AS (SELECT arm, draw, sum(w) AS n, sum(w * kept) AS k, sum(w * moved) AS m FROM mv JOIN wt ON user_id = u GROUP BY 1, 2), ms AS (SELECT arm, s AS series, draw, sum(w) AS n, sum(w * moved) AS m FROM (SELECT *, unnest(axes) AS s FROM mv) JOIN wt ON user_id = u GROUP BY 1, 2, 3),
gp AS (SELECT 'click' AS arm, user_id, a.moved - b.moved AS gap FROM mv a JOIN mv b USING (user_id) WHERE a.arm = 'click' AND b.arm = 'error'), gd AS (SELECT arm, draw, sum(w) AS n, sum(w * gap) AS g FROM gp JOIN wt ON user_id = u GROUP BY 1, 2),
jc AS (SELECT s.user_id, s.arm, round(len(list_intersect(s.terms, a.terms)) / len(list_distinct(list_concat(s.terms, a.terms)))::DOUBLE * 1e6)::BIGINT AS a, round(len(list_intersect(s.terms, b.terms)) / len(list_distinct(list_concat(s.terms, b.terms)))::DOUBLE * 1e6)::BIGINT AS b FROM sets s JOIN gs a ON a.user_id = s.user_id JOIN gs b ON b.user_id = s.user_id + 1 WHERE arm = 'purchase'),
sw AS (SELECT arm, draw, sum(w) AS n, sum(w * a) AS a, sum(w * b) AS b, sum(w * (b > a)::INT) AS f FROM jc JOIN wt ON user_id = u GROUP BY 1, 2),
tr AS ({_UP.format(keys='user_id', rows='gt')}), sd AS ({_UP.format(keys='user_id, arm', rows='terms')}), ia AS (SELECT term, (ascii(right(term, 1)) % 5)::BIGINT AS wi FROM (SELECT DISTINCT term FROM tr)),
g AS (SELECT aspect, user_id, count(*) AS g, sum(wi)::BIGINT AS gw FROM tr JOIN ia USING (term) GROUP BY 1, 2),
pt AS (SELECT sd.arm, sd.aspect, sd.user_id, count(*) AS p, sum(coalesce(wi, 0))::BIGINT AS pw, count(tr.term) AS tp, sum(CASE WHEN tr.term IS NOT NULL THEN coalesce(wi, 0) ELSE 0 END)::BIGINT AS tpw FROM sd LEFT JOIN ia USING (term) LEFT JOIN tr ON tr.user_id = sd.user_id AND tr.aspect = sd.aspect AND tr.term = sd.term GROUP BY 1, 2, 3),
ow AS (SELECT s.arm, g.aspect, g.user_id, (coalesce(p, 0) > 0)::INT AS says, (coalesce(pw, 0) > 0)::INT AS says_w, (gw > 0)::INT AS one_w, coalesce(round({q('tp', 'p')} * 1e6), 0)::BIGINT AS pr, coalesce(round({q('tp', 'g')} * 1e6), 0)::BIGINT AS re, coalesce(round({q('tpw', 'pw')} * 1e6), 0)::BIGINT AS pr_w, coalesce(round({q('tpw', 'gw')} * 1e6), 0)::BIGINT AS re_w
 FROM sets s JOIN g ON g.user_id = s.user_id LEFT JOIN pt ON pt.arm = s.arm AND pt.aspect = g.aspect AND pt.user_id = g.user_id),
rf AS (SELECT * FROM ow WHERE arm = 'view'), sx AS (SELECT 'all' AS side, * FROM ow UNION ALL SELECT 'own', ow.* FROM ow SEMI JOIN rf ON rf.aspect = ow.aspect AND rf.user_id = ow.user_id UNION ALL SELECT 'ref', s.arm, rf.* EXCLUDE (arm) FROM sets s JOIN rf ON rf.user_id = s.user_id),
fs AS (SELECT side, arm, aspect, draw, sum(w) AS n, coalesce({q('sum(w * pr)', 'sum(w * says)')}, 0) / 1e6 AS p, {q('sum(w * re)', 'sum(w)')} / 1e6 AS r, coalesce({q('sum(w * pr_w)', 'sum(w * says_w)')}, 0) / 1e6 AS pw, coalesce({q('sum(w * re_w)', 'sum(w * one_w)')}, 0) / 1e6 AS rw FROM sx JOIN wt ON user_id = u GROUP BY ALL),
fa AS (SELECT side, arm, aspect, draw, n, {_F1.format(p='p', r='r')} AS f, {_F1.format(p='pw', r='rw')} AS fw FROM fs), fm AS (SELECT side, arm, draw, avg(f) AS f, avg(fw) AS fw, max(n) AS n FROM fa GROUP BY ALL),
fp AS (SELECT o.arm, o.draw, o.n, o.f AS fo, r.f AS fr, o.fw AS fwo, r.fw AS fwr FROM fm o JOIN fm r ON o.arm = r.arm AND o.draw = r.draw AND r.side = 'ref' WHERE o.side = 'own' AND o.arm <> 'view')"""


@query(f"""WITH {_SETS}, o AS ({bounds_sql(long_sql('md', 'arm', {'retained': ('n', q('k', 'n')), 'distance': ('n', q('m', 'n') + ' / 1e6')}), 'arm', 'sets')} UNION ALL {bounds_sql('SELECT *, ' + q('m', 'n') + ' / 1e6 AS v FROM ms', 'arm', 'strata')}
UNION ALL {bounds_sql(long_sql('gd', 'arm', {'gap': ('n', q('g', 'n') + ' / 1e6')}), 'arm', 'grounding')} UNION ALL {bounds_sql(long_sql('sw', 'arm', {'near_own': ('n', q('a', 'n') + ' / 1e6'), 'near_other': ('n', q('b', 'n') + ' / 1e6'), 'follows_other': ('n', q('f', 'n'))}), 'arm', 'swap')}
UNION ALL {bounds_sql("SELECT arm, 'f1:' || aspect AS series, draw, n, f AS v FROM fa WHERE side = 'all' UNION ALL SELECT arm, 'f1_weighed:' || aspect, draw, n, fw FROM fa WHERE side = 'all'", 'arm', 'f1')} UNION ALL {bounds_sql(long_sql('fm', 'arm', {'f1': ('n', 'f'), 'f1_weighed': ('n', 'fw')}, "WHERE side = 'all'"), 'arm', 'f1')}
UNION ALL {bounds_sql(long_sql('fp', 'arm', {'f1_loss': ('n', 'fr - fo'), 'f1_weighed_loss': ('n', 'fwr - fwo')}), 'arm', 'f1')} UNION ALL {bounds_sql(long_sql('fp', 'arm', {'f1_left': ('n', q('fo', 'fr')), 'f1_weighed_left': ('n', q('fwo', 'fwr'))}, "WHERE arm = 'signup'"), 'arm', 'f1')}),
f AS ({flips_sql('gp', 'user_id', 'gap')}) SELECT o.*, p_e6 FROM o LEFT JOIN f ON o.arm = f.arm AND section = 'grounding'""")
def score_protein_report(t):
    """Term sets by arm: retention, distance and its strata, grounding gap, swap following, F1 plain and weighed by aspect, paired."""
    def closed(rows, keys):
        aspect = F.when(F.col("term").startswith("t"), "x").otherwise("y")
        up = F.when(F.col("term").startswith("t"), F.array("term", F.concat(F.lit("u"), F.floor(F.substring("term", 2, 9).cast("int") / 2).cast("string")))).otherwise(F.array("term"))
        return rows.select(*keys, aspect.alias("aspect"), F.explode(up).alias("term")).distinct()

    sets = term_sets(t).withColumnRenamed("user_id", "entity")
    e = t("events").where("event_id % 2 = 0")
    gold = e.select(F.col("user_id").alias("entity"), F.explode(F.array(F.concat(F.lit("t"), (F.floor("value").cast("long") % 7).cast("string")), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")))).alias("term")).distinct()
    truth = closed(gold, ["entity"]).withColumn("weight", (F.ascii(F.right("term", F.lit(1))) % 5).cast("long"))
    said = closed(sets.select("entity", "arm", F.explode("terms").alias("term")), ["entity", "arm"])
    gs = gold.groupBy("entity").agg(F.collect_list("term").alias("own"))
    swapped = sets.where("arm = 'purchase'").join(gs, "entity").join(gs.select((F.col("entity") - 1).alias("entity"), F.col("own").alias("other")), "entity")
    parts = [
        P.set_report(sets, "view", {"size": F.least(F.lit(3), F.size("terms")), "parity": F.col("entity") % 2}, DRAWS), P.grounding_report(sets, "view", "click", "error", DRAWS, FLIPS),
        P.swap_report(swapped, "own", "other", DRAWS), P.f1_report(truth, said, sets, "view", "signup", DRAWS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _genes(t: Tables):
    """Suppliers' lines as cells' lists: by price in the first condition, in a hash order in the second; small lines are outside."""
    lines = t("lineitem")
    li = lines.select(
        (F.col("l_suppkey") % 3).alias("atlas"), F.col("l_suppkey").alias("cell"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity") > 5).alias("inside"), "l_shipdate", (F.col("l_partkey") % 5 == 0).alias("ribo"), (F.col("l_linestatus") == "O").alias("deg"),
        F.explode(F.array(
            F.struct(F.lit("wt").alias("cond"), (-F.round(F.col("l_extendedprice") * 100)).cast("long").alias("o"), (F.col("l_returnflag") == "A").alias("cited")),
            F.struct(F.lit("scrambled").alias("cond"), pick(F.lit("mix"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("o"), (F.col("l_returnflag") == "R").alias("cited")))).alias("c")).select("*", "c.*").drop("c")
    li = P.dealt(li, 2 * lines.count(), "cell", "cond")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    rank = F.row_number().over(Window.partitionBy("cell", "cond", "inside").orderBy("o", *key))
    cite = F.row_number().over(Window.partitionBy("cell", "cond", "cited").orderBy("l_shipdate", *key))
    return li.select("atlas", "cell", "cond", F.when(F.col("inside"), rank).alias("rank"), F.when(F.col("cited"), cite).alias("cite"), "ribo", "deg")


_SERIES = "unnest(['all', CASE WHEN ribo THEN 'ribo' ELSE 'nonribo' END, CASE WHEN deg THEN 'deg' ELSE 'nondeg' END, (CASE WHEN ribo THEN 'ribo' ELSE 'nonribo' END) || (CASE WHEN deg THEN '_deg' ELSE '_other' END)])"
_LISTS = f"""li AS (SELECT l_suppkey % 3 AS atlas, l_suppkey AS cell, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity > 5 AS inside, l_shipdate, l_partkey % 5 = 0 AS ribo, l_linestatus = 'O' AS deg, cond, CASE cond WHEN 'wt' THEN -round(l_extendedprice * 100)::BIGINT ELSE {PICK.format("'mix|' || l_orderkey || '|' || l_linenumber")} END AS o, l_returnflag = CASE cond WHEN 'wt' THEN 'A' ELSE 'R' END AS cited FROM lineitem, (VALUES ('wt'), ('scrambled')) c(cond)),
gn AS (SELECT atlas, cell, cond, ribo, deg, CASE WHEN inside THEN row_number() OVER (PARTITION BY cell, cond, inside ORDER BY o, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) END AS rank, CASE WHEN cited THEN row_number() OVER (PARTITION BY cell, cond, cited ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) END AS cite FROM li),
{weights_sql('gn', 'cell')}, nn AS (SELECT *, count(rank) OVER (PARTITION BY cell, cond) AS n FROM gn),
sl AS (SELECT atlas, cell, cond, least(9, (rank - 1) * 10 // n) AS decile, ribo, deg, count(*) AS tot, count(cite) AS cit FROM nn WHERE rank IS NOT NULL GROUP BY ALL), fi AS (SELECT atlas, cond, decile, ribo, deg, draw, sum(w * tot) AS tot, sum(w * cit) AS cit FROM sl JOIN wt ON cell = u GROUP BY ALL),
dx AS (SELECT unnest([atlas::VARCHAR, 'pooled']) AS atlas, cond, decile, ribo, deg, draw, tot, cit FROM fi), dy AS (SELECT atlas, cond, decile, {_SERIES} AS series, draw, tot, cit FROM dx), dz AS (SELECT atlas, cond, unnest([decile, -1]) AS decile, series, draw, tot, cit FROM dy), dd AS (SELECT atlas, cond, decile, series, draw, sum(tot) AS tot, sum(cit) AS cit FROM dz GROUP BY ALL),
rr AS (SELECT a.atlas, a.cond, a.decile, a.draw, k AS series, a.tot + b.tot AS n, {q(q('a.cit', 'a.tot'), q('b.cit', 'b.tot'))} AS v FROM (VALUES ('ribo_vs_nonribo', 'ribo', 'nonribo'), ('deg_vs_nondeg', 'deg', 'nondeg'), ('deg_in_nonribo', 'nonribo_deg', 'nonribo_other'), ('deg_in_ribo', 'ribo_deg', 'ribo_other')) c(k, x, y) JOIN dd a ON a.series = x JOIN dd b ON b.series = y AND a.atlas = b.atlas AND a.cond = b.cond AND a.decile = b.decile AND a.draw = b.draw),
po AS (SELECT a.atlas, a.cond, -1 AS decile, a.draw, a.series, a.tot + b.tot AS n, {q(q('a.cit', 'a.tot'), q('b.cit', 'b.tot'))} AS v FROM dd a JOIN dd b ON a.atlas = b.atlas AND a.cond = b.cond AND a.series = b.series AND a.draw = b.draw WHERE a.decile = 0 AND b.decile = 9 AND a.series IN ('all', 'ribo', 'nonribo')),
mi AS (SELECT a.atlas, a.cond, -1 AS decile, a.draw, k AS series, a.tot AS n, coalesce(b.tot, 0) / a.tot::DOUBLE AS v FROM dd a CROSS JOIN (VALUES ('ribo_deg'), ('ribo_other'), ('nonribo_deg'), ('nonribo_other')) c(k) LEFT JOIN dd b ON a.atlas = b.atlas AND a.cond = b.cond AND a.draw = b.draw AND b.decile = -1 AND b.series = k WHERE a.decile = -1 AND a.series = 'all'),
bt AS (SELECT cell, cond, row_number() OVER (PARTITION BY cell, cond ORDER BY rank) - row_number() OVER (PARTITION BY cell, cond ORDER BY cite) AS d FROM gn WHERE rank IS NOT NULL AND cite IS NOT NULL), b2 AS (SELECT cell, cond, count(*) AS m, sum(d * d)::BIGINT AS d2 FROM bt GROUP BY 1, 2),
c1 AS (SELECT atlas, cell, cond, count(rank) AS n, count(cite) AS n_ref, count(cite) FILTER (rank IS NOT NULL) AS ref_in, count(cite) FILTER (ribo) AS ref_ribo, count(cite) FILTER (rank IS NOT NULL AND deg) AS ref_deg, count(cite) FILTER (cite <= 5) AS n_ref5, count(cite) FILTER (cite <= 5 AND ribo) AS ref5_ribo, count(cite) FILTER (cite <= 5 AND deg AND rank IS NOT NULL) AS ref5_deg,
 count(rank) FILTER (deg) AS kd, count(rank) FILTER (ribo) AS kr, sum(rank) FILTER (cite IS NOT NULL) AS ranks FROM gn GROUP BY 1, 2, 3),
c2 AS (SELECT c1.*, coalesce(m, 0) AS m, d2, coalesce(round({q('n_ref * kd', 'n')} * 1e6), 0)::BIGINT AS chance_deg, coalesce(round({q('n_ref5 * kd', 'n')} * 1e6), 0)::BIGINT AS chance_deg5, coalesce(round({q('n_ref * kr', 'n')} * 1e6), 0)::BIGINT AS chance_ribo FROM c1 LEFT JOIN b2 USING (cell, cond)),
c3 AS (SELECT *, (m >= 3)::INT AS ranked, CASE WHEN m >= 3 THEN round((1 - {q('6 * d2', 'm * (m * m - 1)')}) * 1e6)::BIGINT ELSE 0 END AS rho, (m >= 3 AND 6 * d2 < m * (m * m - 1))::INT AS rising, (m > 0)::INT AS placed, CASE WHEN m > 0 THEN round(({q('ranks', 'm')} - 1) / greatest(n - 1, 1) * 1e6)::BIGINT ELSE 0 END AS depth FROM c2),
c4 AS (SELECT unnest([atlas::VARCHAR, 'pooled']) AS atlas, cell, cond, n_ref, ref_in, ref_ribo, ref_deg, n_ref5, ref5_ribo, ref5_deg, chance_deg, chance_deg5, chance_ribo, ranked, rho, rising, placed, depth FROM c3),
ce AS (SELECT atlas, cond, -1 AS decile, draw, sum(w) AS cells, {', '.join(f'sum(w * {c}) AS {c}' for c in 'n_ref ref_in ref_ribo ref_deg n_ref5 ref5_ribo ref5_deg chance_deg chance_deg5 chance_ribo ranked rho rising placed depth'.split())} FROM c4 JOIN wt ON cell = u GROUP BY ALL)"""
_SHARES = {"in_list": q("ref_in", "n_ref"), "ribo_share": q("ref_ribo", "n_ref"), "deg_precision": q("ref_deg", "n_ref"), "deg_precision5": q("ref5_deg", "n_ref5")}
_CELLS = {
    "mean_cited": q("n_ref", "cells"), **_SHARES, "ribo_share5": q("ref5_ribo", "n_ref5"), "ribo_chance": q("chance_ribo", "n_ref") + " / 1e6", "deg_chance": q("chance_deg", "n_ref") + " / 1e6", "deg_chance5": q("chance_deg5", "n_ref5") + " / 1e6",
    "deg_over_chance": q("ref_deg * 1000000", "chance_deg"), "deg_over_chance5": q("ref5_deg * 1000000", "chance_deg5"), "spearman": q("rho", "ranked") + " / 1e6", "spearman_rising": q("rising", "ranked"), "depth": q("depth", "placed") + " / 1e6"}
_BY = "atlas, cond, decile"


@query(f"""WITH {_LISTS}, pa AS (SELECT atlas, decile, draw, 'wt-scrambled' AS cond, max(cells) AS cells, {', '.join(f"max({v}) FILTER (cond = 'wt') - max({v}) FILTER (cond = 'scrambled') AS {k}" for k, v in _SHARES.items())} FROM ce GROUP BY 1, 2, 3)
SELECT * FROM ({bounds_sql('SELECT *, tot AS n, ' + q('cit', 'tot') + ' AS v FROM dd', _BY, 'cited')} UNION ALL {bounds_sql('FROM rr', _BY, 'ratio')} UNION ALL {bounds_sql('FROM po', _BY, 'position')} UNION ALL {bounds_sql('FROM mi', _BY, 'input')}
UNION ALL {bounds_sql(long_sql('ce', _BY, {k: ('cells', v) for k, v in _CELLS.items()}), _BY, 'cells')} UNION ALL {bounds_sql(long_sql('pa', _BY, {k: ('cells', k) for k in _SHARES}), _BY, 'paired')}) WHERE value_e6 IS NOT NULL OR section NOT IN ('ratio', 'position')""")
def rationale_order_report(t):
    """Citations by place and class, their ratios, list shares, chances and rank correlations, by atlas and pooled, with intervals."""
    return P.order_report(_genes(t), "wt", "scrambled", DRAWS)


@query()
def rationale_order_odds(t):
    """Odds of being cited by tenth, class and atlas, with intervals over cells; the fits of draws are outside SQL."""
    return P.citation_odds(P.cited_slots(_genes(t)), ["1", "2"], DRAWS)
