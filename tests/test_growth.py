"""Steps whose work must stay spread and bounded when tables grow, and values that the engines once read differently."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import armwise.queries as base
from armwise.functions import sequence as S
from armwise.functions import text as T
from armwise.operators import ontology as O
from armwise.operators import pairing as P
from armwise.operators import reports as RP
from armwise.operators import resample as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [["g"], []])
def test_draws_are_never_broadcast(spark, by):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = R.bootstrap_mean(rows, by, "v", ["id"], 5)
    assert "ShuffledHashJoin" in plan(got)
    sizes = {0: 167, 1: 167, 2: 166}
    assert {(tuple(r[c] for c in by), r.draw): r.n for r in got.collect()} == ({((g,), d): n for g, n in sizes.items() for d in range(5)} if by else {((), d): 500 for d in range(5)})


def test_no_group_is_placed_by_one_task(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("g"), "id", F.lit(1).alias("v"))
    got = R.bootstrap_mean(rows, ["g"], "v", ["id"], 3)
    assert "Window [row_number" not in plan(got)
    assert {(r.g, r.draw): r.n for r in got.collect()} == {(g, d): n for g, n in ((0, 200), (1, 250)) for d in range(3)}


def test_shared_weights_are_never_broadcast(spark):
    units = spark.range(300).select(F.col("id").alias("u"), (F.col("id") % 5).alias("v"))
    weights = R.unit_weights(units, [], "u", 4)
    sums = R.weighted_sums(units.withColumn("one", F.lit(1)), weights, [], "u", ["one"])
    assert plan(sums).count("ShuffledHashJoin") == 2
    assert sorted(tuple(r) for r in sums.collect()) == [(d, 300) for d in range(4)]


def test_capitals_letter_by_letter(spark):
    said = ["Undenöteer enß", "straße", "", None, "ŉ ǰ ᾀb ﬀ", "Übe"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").orderBy("i").select(T.upper_letters(F.col("x"))).collect()]
    assert got == [None if x is None else duckdb.execute("select upper(?)", [x]).fetchone()[0] for x in said]


@pytest.mark.parametrize("name", ["score_mcq", "txt6_option"])
def test_options_of_letters_with_two_capitals(spark, tmp_path, name):
    rows = [(c, k, "user", x) for c in range(6) for k, x in enumerate(["Undenöteer enß so", "Straß e ß", "groß", None])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(base.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in base.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()) == sorted(want.fetchall())


def test_halves_of_sizes_go_to_the_even_number(spark, tmp_path):
    rows = [(225, 3882, 198500.0), (225, 7, 199500.0), (225, 9, 600400.0), (1, 1, 500.0), (1, 2, 1500.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.o_custkey, r.o_orderkey): (r.n, r.batch) for r in base.QUERIES["win16_length_batches"](spark, str(tmp_path)).collect()}
    assert got == {(225, 9): (600, 0), (225, 7): (200, 0), (225, 3882): (198, 1), (1, 1): (0, 0), (1, 2): (2, 0)}


def test_pairs_of_one_text_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rows = [(f"t{i % 3}", i, i % 4, i % 5) for i in range(60)] + [("t0", 0, 3, 1), (None, 70, 1, 1), (None, 71, 2, 1), ("t1", 72, None, 1), ("t1", 73, 2, None)]
    got = P.same_text_pairs(spark.createDataFrame(rows, "t string, k int, v int, l int"), "t", "k", "v", "l")
    want = [(t, a, b, None if la is None or lb is None else la != lb) for t, a, va, la in rows for u, b, vb, lb in rows if t and t == u and a < b and None not in (va, vb) and va != vb]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_keys_of_equal_members_meet_as_classes(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 5)
    rows = [(i % 2, i, (i * 7 + j * j) % 5) for i in range(50) for j in range(1 + i % 4)] + [(0, 1, 2), (None, 1, 2), (0, None, 2), (0, 60, None)]
    got = P.shared_member_pairs(spark.createDataFrame(rows, "w int, k int, m int"), "w", "k", "m")
    held = {}
    for w, k, m in rows:
        if None not in (w, k, m):
            held.setdefault((w, k), set()).add(m)
    want = [(w, a, b, len(x & y)) for (w, a), x in held.items() for (u, b), y in held.items() if w == u and a < b and x & y]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = plan(got)
    assert text.index("Generate") < text.index("Exchange")  # nothing is shuffled after keys are paired


def met_by(text: str) -> set[str]:
    """The keys of the plan's shuffled hash joins, their numbers taken off."""
    return {re.sub(r"#\d+L?", "", x) for x in re.findall(r"ShuffledHashJoin \[([^\]]*)\]", text)}


def test_classes_meet_block_by_block(spark):
    rows = spark.range(3000).select((F.col("id") % 1).alias("w"), F.col("id").alias("k"), F.lit("m").alias("m"))
    got = P.shared_member_pairs(rows, "w", "k", "m")
    text = plan(got)
    assert met_by(text) == {"w, _class_a, _b_a", "w, _class_b, _b_b"} and "rand(" not in text
    assert P.BLOCK ** 2 <= 1 << 16  # rows that a task makes before it hands any on
    assert tuple(got.agg(F.count("*"), F.sum("a"), F.sum("b"), F.count_distinct("a", "b"), F.sum("shared")).first()) == (
        n := 3000 * 2999 // 2, sum(a * (2999 - a) for a in range(3000)), sum(b * b for b in range(3000)), n, n)


def test_a_frequent_text_meets_block_by_block(spark):
    rows = spark.range(3000).select(F.concat(F.lit("t"), (F.col("id") % 1).cast("string")).alias("t"), F.col("id").alias("k"), (F.col("id") % 2).alias("v"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("l"))
    got = P.same_text_pairs(rows, "t", "k", "v", "l")
    text = plan(got)
    assert met_by(text) == {"t, _b_a", "t, _b_b"} and "rand(" not in text
    assert text.index("Generate") < text.index("Exchange")  # nothing is shuffled after keys are paired
    changed = dict(got.groupBy("should_change").count().collect())
    n = {(v, l): sum(i % 2 == v and i % 3 == l for i in range(3000)) for v in (0, 1) for l in (0, 1)}
    assert changed == {True: n[0, 0] * n[1, 1] + n[0, 1] * n[1, 0], False: n[0, 0] * n[1, 0] + n[0, 1] * n[1, 1], None: 1500 * 1500 - 1000 * 1000}
    assert got.where("a < b").distinct().count() == 1500 * 1500


def test_accretion_makes_no_row_of_entity_and_child(spark):
    edges = [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("z", "a"), ("a", "r"), ("b", "r"), ("w", "b"), ("w", "q")]
    held = {1: "xabr", 2: "yabr", 3: "zar", 4: "br", 5: "r", 6: "wbr", 7: "ab"}
    said = spark.createDataFrame([(e, c) for e, ts in held.items() for c in ts + ts[0]], "entity int, term string")
    got = O.information_accretion(said, spark.createDataFrame(edges, "child string, parent string"))
    of = {}
    for c, p in edges:
        of.setdefault(c, set()).add(p)
    want = [(c, sum(c in ts for ts in held.values()), sum(of[c] <= set(ts) for ts in held.values()) if c in of else 0) for c in "xyzabrw"]
    assert sorted((r.term, r.n, r.n_parents) for r in got.collect()) == sorted(want)
    assert "keys=[entity" in plan(got) and "_k#" not in plan(got)


def test_runs_and_signs_are_dealt_before_they_are_made(spark):
    rows = spark.createDataFrame([(1, "abab"), (1, "ab"), (2, "a"), (3, None)], "k int, s string")
    got = S.kmers(rows, "k", F.col("s"), 2)
    assert plan(got).count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == [(1, "ab", 3), (1, "ba", 1)]
    flips = R.sign_flip(spark.range(9).coalesce(1).select("id", (F.col("id") - 4).alias("d")), "id", "d", 5)
    assert "REPARTITION_BY_NUM" in plan(flips) and flips.first().n == 9


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_vocabulary_is_looked_up_where_texts_lie(spark, monkeypatch, size):
    monkeypatch.setattr(T, "AUTOMATON", size)
    names = [("c1", "b cell", True, 2.0), ("c2", "naive b cell", True, 1.0), ("c3", "cells", False, 3.0), ("c4", "cell", True, 3.0), ("c5", "b cells", True, None), ("c6", "as", True, 5.0)]
    index = spark.createDataFrame(names, "id string, phrase string, primary boolean, ic double")
    said = [(1, "Naive B-cells and b cells, Cells - B  cell"), (1, "cell"), (2, None), (3, "ass naive - b cell"), (4, "-")]
    texts = spark.createDataFrame(said, "k int, t string")
    got = T.vocabulary_terms(texts, "k", F.col("t"), index)
    assert "Exchange" not in plan(got)
    want = [(1, 1, 1, "cell", "c4"), (1, 1, 2, "Naive B-cells", "c2"), (1, 4, 2, "b cells", "c5"), (1, 7, 3, "- B cell", "c1"), (3, 1, 1, "ass", "c6"), (3, 3, 3, "- b cell", "c1")]
    assert sorted(map(tuple, got.collect())) == want
    assert {r.id for r in T.vocabulary_terms(texts, "k", F.col("t"), index, least=2.0).collect()} == {"c1", "c4", "c6"}
    assert T.vocabulary_terms(texts, "k", F.col("t"), index.where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_items_are_looked_for_where_texts_lie(spark, monkeypatch, size):
    monkeypatch.setattr(T, "AUTOMATON", size)
    said = [(1, "So: The quick, brown fox jumps over!"), (2, "bequick brown fox jumps overly"), (3, "quick brown cat"), (4, None), (5, "a zebra-ish"), (5, "a zebra-ish"), (6, "")]
    rows = spark.createDataFrame(said, "k int, t string")
    items = spark.createDataFrame([("Quick brown fox jumps over",), ("zebra",), ("?!",), (None,)], "i string")
    got = T.naming_any(rows, items, F.col("t"), F.col("i"))
    assert got.columns == ["k", "t", "named"] and sorted((r.k, r.named) for r in got.collect()) == [(1, True), (2, True), (3, False), (4, False), (5, True), (5, True), (6, False)]
    if size > 1:
        assert "Exchange" not in plan(got) and plan(got).count("lower(") == 1
    assert not T.naming_any(rows, items.where("false"), F.col("t"), F.col("i")).where("named").count()


def test_labels_made_of_bytes_equal_the_expression(spark):
    said = ["", " A\u00a0b\x1fc\x0bd\x85e ", "\u212aelvin \u0130x", "\u043f\u0440x-y'z/_9 \U0001f600q\n\t", "  !!  "]
    for lower, want in spark.createDataFrame([(x,) for x in said], "t string").select(F.lower("t"), T.normalised_label(F.col("t"))).collect():
        assert b" ".join(lower.encode().translate(T.LABEL_BYTES).split()).decode() == want


def test_odds_hash_a_unit_and_draw_once(spark):
    from hashlib import md5

    rows = [(f"u{i}", i % 2, (i // 2) % 2, 1 + i % 3) for i in range(40)]
    got = R.odds_intervals(spark.createDataFrame(rows, "u string, x int, y int, w long"), [], ["x"], "y", "w", "u", 8)
    assert not [line for line in plan(got).splitlines() if "Filter" in line and "md5" in line]
    seeds = [f"s|{i}" for i in range(400)]
    drawn = spark.createDataFrame([(s,) for s in seeds], "s string").select("s", R._poisson(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in drawn} == {s: sum(int(md5(s.encode()).hexdigest()[:12], 16) / (1 << 48) >= c for c in R.POISSON) for s in seeds}

    def odds(weigh):
        n = {k: sum(w * weigh(u) for u, x, y, w in rows if (x, y) == k) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
        return n[1, 1] * n[0, 0] / (n[1, 0] * n[0, 1])

    draws = sorted(odds(lambda u: sum(int(md5(f"odds|{d}|{u}".encode()).hexdigest()[:12], 16) / (1 << 48) >= c for c in R.POISSON)) for d in range(8))
    row = {r.term: r for r in got.collect()}["x"]
    assert row.odds_ratio == pytest.approx(odds(lambda u: 1)) and draws[0] <= row.ci_low * (1 + 1e-6) and row.ci_high <= draws[-1] * (1 + 1e-6)


def test_lists_are_dealt_by_their_number_and_ranked_by_sorting(spark):
    genes = [(i % 2, i % 3, "wt", r, c, (r or 1) % 2 == 0, (r or 1) % 3 == 0) for i in range(6) for r, c in ((1 + i, 3 - i % 3), (7 + i, None), (13 + i, 4 + i), (None, 10 + i))]
    rows = spark.createDataFrame(genes, "atlas int, cell int, cond string, rank int, cite int, ribo boolean, deg boolean")
    lists = RP.cited_lists(rows)
    assert "filter(" not in plan(lists)  # no list is searched once a member
    assert {r.placed for r in lists.collect()} == {1}
    assert RP.dealt(rows, 10 * RP.TASK, "cell").rdd.getNumPartitions() == 10
    drawn = RP.drawn_sums(rows, ["atlas", "cond"], "cell", ["rank"], 5)
    text = plan(drawn)
    assert text.index("md5") > text.index("explode(CASE") > 0  # draws are hashed before a unit's groups are laid out
    assert {(r.atlas, r["rank"]) for r in drawn.where("draw < 0").collect()} == {(a, sum(g[3] or 0 for g in genes if g[0] == a)) for a in (0, 1)}


def test_largest_spans_are_dealt_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(RP, "TASK", 100)
    text = plan(base.QUERIES["seq18_largest_span"](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text
