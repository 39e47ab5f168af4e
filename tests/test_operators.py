"""Hand-written cases: nulls, ties, empty inputs, and operators that SQL does not express."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.functions import stats as A
from armwise.functions import text as T
from armwise.operators import metrics as M
from armwise.operators import ontology as O
from armwise.operators import pairing as P
from armwise.operators import probes as B
from armwise.operators import resample as R
from armwise.plans import scoring
from armwise.sources import readers, writers


def one(spark, column, **values):
    """The value of a column expression over one row of strings and lists."""
    kinds = {str: "string", list: "array<string>", int: "int"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_label_mapping(spark):
    labels = spark.createDataFrame([("diabetes",), ("type 2 diabetes",)], "label string")
    texts = {"a": "Answer: Type 2 Diabetes.", "b": "diabetes it is", "c": "Answer: gout\nAnswer: diabetes", "d": "", "e": None, "f": "diabetes here. Answer: none"}
    rows = spark.createDataFrame(list(texts.items()), "key string, text string")
    got = {r.key: r.pred for r in T.mapped_labels(rows, labels, "key", F.col("text")).collect()}
    assert got == {"a": "type 2 diabetes", "b": "diabetes", "c": "diabetes", "d": None, "e": None, "f": "diabetes"}


@pytest.mark.parametrize("said, option, kind", [
    ("CD4+ T cells", "CD4+ T cells", "exact"), ("cd4+_t-CELLS.", "CD4+ T cells", "normalised"), ("cd4  t CELLS.", "cd4  t CELLS", "none"), ("<b>B cells</b>\nelse", "B cells", "exact"),
    ("these are B cells, surely", "B cells", "contained"), ("naive B cells or B cells", "naive B cells", "contained_longest"), ("nai", "naive B cells", "prefix"), ("no idea", "no idea", "none"), (None, "", "none"),
])
def test_options(spark, said, option, kind):
    options = ["CD4+ T cells", "B cells", "naive B cells"]
    rows = spark.createDataFrame([(said, options)], "said string, options array<string>")
    got = rows.select(T.parsed_option(F.col("said"), F.col("options")).alias("x")).first().x
    assert (got.option, got.kind) == (option, kind)


@pytest.mark.parametrize("text, want", [
    ("Not present", "no"), ("Yes, it is", "yes"), ("unlikely", "no"), ("", ""), ("It is likely present", "yes"), ("Yeah", "yes"), ("nope.", "no"), ("Motif detected", "yes"), ("it lacks one", "no"),
    ("It contains one", "yes"), ("none", "no"), ("ciónosiemi", ""), ("notable", ""), ("ñno", "no"), (None, ""),
])
def test_yes_no(spark, text, want):
    assert one(spark, T.yes_no(F.col("t")), t=text) == want


def test_choice_and_edit(spark):
    f = T.choice_ab(F.col("t"), F.col("a"), F.col("b"))
    assert one(spark, f, t="Answer: A. No wait, answer: B", a="cat", b="dog") == "B"
    assert one(spark, f, t="surely the dog", a="cat", b="dog") == "B"
    assert one(spark, f, t="cat and dog", a="cat", b="dog") is None
    assert one(spark, f, t="A cell of some kind", a="cat", b="dog") is None
    assert one(spark, f, t="<think>answer: A</think>\n(b).\n", a="x", b="y") == "A"
    assert one(spark, f, t="first\n b) \nmore", a="x", b="y") == "B"
    assert one(spark, f, t="it may be (A). or B: so", a="x", b="y") == "B"
    for text, first, listed in (("A to C, then G>T", "A>C", "G>T"), ("ref A -> var T", "A>T", "A>T"), ("thymine into guanine", "T>G", "T>G"), ("AG>T", None, None), ("A with C", None, None)):
        assert one(spark, T.stated_pair(F.col("t")), t=text) == first and one(spark, T.stated_pair(F.col("t"), earliest=False), t=text) == listed
    assert tuple(one(spark, T.stated_edit(F.col("t")), t="x Edit at 12: ref A -> var G")) == (12, "A", "G")
    assert one(spark, T.stated_pair(F.col("t")), t="a change from adenine to guanine here") == "A>G"
    assert one(spark, T.enumerated(F.col("f")), f=["a", "b", "c"]) == "a, b, and c"
    assert one(spark, T.masked(F.col("t"), F.col("s")), t="TP53 and TP5", s=["TP5", "TP53"]) == "GENE and GENE"
    assert one(spark, T.cited_terms(F.col("t"), F.col("v")), t="Cd3e, ACTB. cd3e", v=["ACTB", "CD3E"]) == ["CD3E", "ACTB"]
    assert one(spark, T.lines_without(F.col("t"), "Gene:"), t="a\ngene: x\nb") == "a\nb"


def test_blocks_of_terms(spark):
    rows = spark.createDataFrame([(1, "Process:\nGO:0000001, GO:0000002\nFunction:\nGO:0000003")], "k int, t string")
    assert {tuple(r) for r in T.block_terms(rows, "k", "t").collect()} == {(1, "process", "GO:0000001"), (1, "process", "GO:0000002"), (1, "function", "GO:0000003")}


def test_sets(spark):
    j = A.jaccard(F.col("a"), F.col("b"))
    assert one(spark, j, a=[], b=[]) == 1.0
    assert one(spark, j, a=["x"], b=[]) == 0.0
    assert one(spark, j, a=["x", "x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, A.same_set(F.col("a"), F.col("b")), a=["x", "y", "x"], b=["y", "x"])


@pytest.mark.parametrize("a, b, span, kind", [("ACGT", "ACGT", (4, 0, "", ""), "none"), ("ACGT", "AGGT", (1, 2, "C", "G"), "substitution"), ("ACGT", "ACCGT", (2, 2, "", "C"), "insertion"), ("ACCGT", "ACGT", (2, 2, "C", ""), "deletion")])
def test_edits(spark, a, b, span, kind):
    got = one(spark, S.edit_span(F.col("a"), F.col("b")), a=a, b=b)
    assert tuple(got) == span
    assert one(spark, S.edit_class(F.col("a"), F.col("b")), a=span[2], b=span[3]) == kind


def test_shuffles_keep_counts(spark):
    rows = spark.createDataFrame([(1, "ACGTTGCAACGGTA"), (2, "AA"), (3, None)], "k int, s string")
    got = {r.k: r.shuffled for r in S.dinucleotide_shuffled(rows, "k", "s").collect()}
    pairs = lambda s: Counter(zip(s, s[1:]))
    assert pairs(got[1]) == pairs("ACGTTGCAACGGTA") and got[2] == "AA" and got[3] is None
    assert sorted(one(spark, S.shuffled(F.col("s"), F.lit("x")), s="banana")) == sorted("banana")
    assert one(spark, S.replaced_items(F.col("a"), F.col("g"), F.col("n")), a=["a", "b", "c", "d"], g=["b", "d"], n=["x"]) == ["a", "x", "c"]


def test_diamond(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "child string, parent string")
    closed = O.closure(edges)
    assert {(r.term, r.ancestor): r.distance for r in closed.collect()}["d", "a"] == 2
    assert closed.count() == 4 + 4 + 1
    pairs = spark.createDataFrame([("b", "c")], "a string, b string")
    assert tuple(O.hop_distance(pairs, closed).first()) == ("b", "c", 2, "a")
    ia = {r.term: r for r in O.information_accretion(O.propagated(spark.createDataFrame([(1, "d"), (2, "b"), (3, "c"), (4, "a")], "entity int, term string"), closed, ["entity"]), edges).collect()}
    assert ia["a"].ia == 0 and ia["d"].n_parents == 1 and ia["d"].ia == 0.0 and ia["b"].ia == pytest.approx(1.0)


def test_auroc_and_ap_with_ties(spark):
    rows = spark.createDataFrame([("g", 1, True), ("g", 1, False), ("g", 2, True), ("g", 0, False), ("h", 1, True)], "g string, s int, p boolean")
    assert {r.g: r.auroc for r in M.auroc(rows, ["g"], "s", "p").collect()} == {"g": pytest.approx(0.875)}
    assert {r.g: r.average_precision for r in M.average_precision(rows, ["g"], "s", "p").collect()} == {"g": pytest.approx(0.5 + 0.5 * 2 / 3), "h": 1.0}


def test_empty_margin_and_null_answers(spark):
    rows = spark.createDataFrame([("a", True, True)], "arm string, s boolean, d boolean")
    r = M.response_table(rows, ["arm"], "s", "d").first()
    assert r.sensitivity == 1.0 and r.specificity is None and r.youden is None
    moved = spark.createDataFrame([("a", None, None, "x"), ("a", None, "x", "x")], "arm string, r string, n string, g string")
    t = M.transitions(moved, ["arm"], "r", "n", "g").first()
    assert (t.same_wrong, t.wrong_to_right, t.changed) == (1, 1, 1)


def test_resampling(spark):
    same = spark.createDataFrame([("g", i, 1) for i in range(5)], "g string, i int, v long")
    ci = R.interval(R.bootstrap_mean(same, ["g"], "v", ["i"], 50), ["g"], "mean", 50).first()
    assert (ci.ci_low, ci.ci_high) == (1.0, 1.0)
    assert R.interval(R.bootstrap_mean(same.where("i < 0"), ["g"], "v", ["i"], 50), ["g"], "mean", 50).count() == 0
    assert R.sign_flip(same.where("i < 2"), "i", "v", 100).first().p is None
    assert R.sign_flip(same.withColumn("v", F.lit(0).cast("long")), "i", "v", 100).first().p == 1.0
    w = R.poisson_weights(same, "i", 400)
    assert abs(w.agg(F.avg("weight")).first()[0] - 1) < 0.1
    cells = spark.createDataFrame([("g", 0.0, 1, 10.0), ("g", 0.0, 0, 30.0), ("g", 1.0, 1, 30.0), ("g", 1.0, 0, 10.0)], "g string, x double, y int, w double")
    odds = {r.term: r.odds_ratio for r in R.logistic_odds(cells, ["g"], ["x"], "y", "w").collect()}
    assert odds["x"] == pytest.approx(9.0, rel=1e-5)


def test_greedy_pairs_are_one_to_one(spark):
    t = spark.createDataFrame([("n", i, float(i), "a") for i in range(4)], "w string, k int, v double, tier string")
    c = spark.createDataFrame([("n", 10 + i, float(i) + 0.1, "a" if i < 3 else "b") for i in range(4)], "w string, k int, v double, tier string")
    got = P.greedy_nearest(t, c, "w", "k", "v", ["tier"]).collect()
    assert len({r.control for r in got}) == 4 == len(got)
    assert min(r.distance for r in got) == pytest.approx(0.1)
    d = P.deranged(t, "k", ["w"]).collect()
    assert all(r.k != r.donor for r in d) and len({r.donor for r in d}) == 4


def test_pooling_and_probe(spark):
    rows = spark.createDataFrame([(1, i, [float(i), -float(i)]) for i in range(5)], "k int, place int, e array<double>")
    assert B.pooled(rows, "k", "place", "e").first().pooled == [2.0, -2.0, 3.0, -1.0]
    data = spark.createDataFrame([(i, i % 10, i % 2, [float(i % 2) + 0.01 * (i % 7), 1.0 * (i % 3)]) for i in range(60)], "i int, g int, y int, e array<double>")
    out = B.out_of_fold(data, "e", "y", "g", 3, keep=["i"])
    assert out.where("label = prediction").count() == 60
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    bad.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(good), "a int").collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(bad), "a int")
    for n in ("records.jsonl", "records.jsonl.0", "records.jsonl.1", "records.jsonl.bak"):
        (tmp_path / n).write_text('{"a": 1}\n')
    assert readers.read_shards(spark, str(tmp_path), "a int").count() == 3


def test_ontology_files(spark, tmp_path):
    obo = "format: 1\n\n[Term]\nid: X:1\nname: root\nnamespace: p\n\n[Term]\nid: X:2\nname: leaf\nnamespace: p\nalt_id: X:9\nis_a: X:1 ! root\nis_a: X:8 ! gone\nsynonym: \"tip\" EXACT []\n\n[Term]\nid: X:8\nname: old\nis_obsolete: true\n"
    (tmp_path / "x.obo").write_text(obo)
    terms = readers.obo_terms(spark, str(tmp_path / "x.obo"))
    assert {tuple(r) for r in readers.obo_edges(terms).collect()} == {("X:2", "X:1", "is_a")}
    assert {tuple(r) for r in readers.name_index(terms).collect()} == {("root", "X:1"), ("leaf", "X:2"), ("tip", "X:2")}
    line = "U\tP1\tn\t{q}\tGO:1\tr\t{e}\tw\tP\tx\ty\tprotein\ttaxon:9606\t{d}\tz"
    (tmp_path / "x.gaf").write_text("!c\n" + "\n".join(line.format(q=q, e=e, d=d) for q, e, d in (("", "IDA", "20200101"), ("", "IDA", "20190101"), ("NOT|x", "IDA", "20180101"), ("", "IEA", "20170101"))))
    assert [tuple(r) for r in readers.read_gaf(spark, str(tmp_path / "x.gaf"), ["IDA"], {"P": "process"}).collect()] == [("P1", "GO:1", "process", "20190101")]
    (tmp_path / "ia.tsv").write_text("GO:1\t0.5\nGO:2\tx\nbad\n")
    assert [tuple(r) for r in readers.read_weights(spark, str(tmp_path / "ia.tsv")).collect()] == [("GO:1", 0.5)]
    (tmp_path / "tree.txt").write_text("A\n--B\n----C\n--D\nE\n")
    tree = O.indent_tree(readers.read_indented(spark, str(tmp_path / "tree.txt")), "line_no", "depth", "name", "file")
    assert {tuple(r) for r in tree.collect()} == {("A", None), ("B", "A"), ("C", "B"), ("D", "A"), ("E", None)}


def test_vocabulary_and_overlap(spark):
    terms = [("T1", "b cell", ["B lymphocyte", "shared name"]), ("T2", "naive B cell", []), ("T3", "T cell", ["shared name"]), ("T4", "atlas thing", ["atlas"])]
    index = T.vocabulary_index(spark.createDataFrame(terms, "id string, name string, synonyms array<string>"))
    rows = spark.createDataFrame([(1, "Naive B-cells and T cells, an atlas of B lymphocytes; shared name"), (2, None), (3, "cells b cell")], "k int, t string")
    got = {tuple(r) for r in T.vocabulary_terms(rows, "k", F.col("t"), index).collect()}
    assert got == {(1, 1, 2, "Naive B-cells", "T2"), (1, 4, 2, "T cells", "T3"), (1, 9, 2, "B lymphocytes", "T1"), (3, 2, 2, "b cell", "T1")}
    known = index.withColumn("ic", F.when(F.col("id") == "T3", 1.0).otherwise(3.0))
    assert {r.id for r in T.vocabulary_terms(rows, "k", F.col("t"), known, least=2.0).collect()} == {"T1", "T2"}
    both = spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "", "a")], "k int, g string, r string")
    assert {r.k: round(r.rouge_l, 6) for r in T.rouge_l(both, "k", "g", "r").collect()} == {1: 0.75, 2: 0.0}
    n1 = {r.n: (r.clipped, r.grams) for r in T.bleu_counts(both.where("k = 1"), "k", "g", "r", 2).collect()}
    assert n1 == {1: (3, 4), 2: (1, 3)}


def test_scoring_and_writers(spark, tmp_path):
    rec = spark.createDataFrame([("e1", "wt", "Answer: gout", "gout; x", 1), ("e1", "wt", "Answer: flu", "gout; x", 2), ("e2", "wt", None, "flu", 1)], "example_id string, condition string, raw string, gold string, seq int")
    got = scoring.score_labels(rec, spark.createDataFrame([("gout",), ("flu",)], "label string")).first()
    assert (got.n, got.unmapped, got.n_correct) == (2, 1, 0)
    m = writers.metric_long(rec.groupBy("condition").count(), "f", "p", "condition", F.lit("x"), "count")
    writers.write_csv(writers.all_metrics([m, m]), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    assert "| condition |" in writers.markdown(rec.select("condition"))


def test_stream(spark, tmp_path):
    from armwise.streaming import records as st

    src = tmp_path / "in"
    src.mkdir()
    base = {"record_id": "1", "example_id": "e", "condition": "wt", "answer": "x", "ts": "2024-01-01T00:00:00"}
    (src / "a.json").write_text(json.dumps(base) + "\n" + json.dumps(base) + "\n")
    (src / "b.json").write_text(json.dumps({**base, "record_id": "2", "condition": "swap", "answer": "y", "ts": "2024-01-01T00:10:00"}) + "\n")
    rows = st.once(st.stream(spark, str(src), "record_id string, example_id string, condition string, answer string, ts timestamp"))
    q = st.paired(rows, "example_id", "condition", "wt", "answer").writeStream.format("memory").queryName("paired_arms").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[:4] for r in spark.sql("select * from paired_arms").collect()] == [("e", "swap", "x", "y")]


def test_wilson(spark):
    low, high = A.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert math.isclose(r[0].l, 0.2365895, abs_tol=1e-6) and math.isclose(r[0].h, 0.7634105, abs_tol=1e-6) and r[1].l is None


def test_any_item_is_found_in_any_text(spark):
    from armwise.plans import catalog

    rows = spark.createDataFrame([(1, "So: The quick, brown fox jumps over!"), (2, "bequick brown fox jumps overly"), (3, "quick brown cat"), (4, None), (5, "a zebra-ish")], "k int, text string")
    items = spark.createDataFrame([("Quick brown fox jumps over",), ("zebra",), ("?!",), (None,)], "item string")
    got = {r.k: r.named for r in T.naming_any(rows, items, F.col("text"), F.col("item")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert catalog.QUERIES["txt4_benchmark_named"](spark, "/root/testdata/sf0.01").where("named").count() == 26  # FIXTURES section 3
