"""Interval sweeps, quantiles, label automata, subsequences and odds intervals against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.functions import text as T
from armwise.operators import resample as R


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_segments_and_covered_places(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    spans = [(rng.choice(["a", "b", "c"]), s, s + rng.randrange(-1, 12), rng.randrange(3)) for s in (rng.randrange(-20, 60) for _ in range(60))]
    df = spark.createDataFrame(spans, "k string, s int, e int, v int")
    best = {}
    for k, s, e, v in spans:
        for p in range(s, e + 1):
            best[k, p] = min(v, best.get((k, p), 9))
    got, pieces = {}, S.salient_segments(df, "k", "s", "e", F.col("v")).collect()
    for r in pieces:
        for p in range(r.start, r.end + 1):
            assert (r.k, p) not in got
            got[r.k, p] = r.evidence
    assert got == best
    if block > 100:
        assert all((a.k, a.end + 1, a.evidence) != (b.k, b.start, b.evidence) or b.start % block == 0 for a in pieces for b in pieces)
    assert {r.k: r.covered for r in S.covered_places(df, "k", "s", "e").collect()} == {k: sum(x == k for x, _ in best) for k in {k for k, _ in best}}


def test_long_spans_are_not_places(spark):
    df = spark.createDataFrame([("a", 0, 5_000_000, 1), ("a", 4_000_000, 9_000_000, 0)], "k string, s int, e int, v int")
    rows = S.salient_segments(df, "k", "s", "e", F.col("v")).collect()
    assert sum(r.end - r.start + 1 for r in rows) == 9_000_001 == S.covered_places(df, "k", "s", "e").first().covered
    assert len(rows) < 300 and sum(r.end - r.start + 1 for r in rows if r.evidence == 0) == 5_000_001


@pytest.mark.parametrize("ordered", [100_000, 40])
def test_quantile_is_exact(spark, monkeypatch, ordered):
    monkeypatch.setattr(R, "ORDERED", ordered)
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 3000), rng.integers(0, 5, 500).astype(float), np.exp(rng.normal(0, 20, 1500)), np.array([3.0]), np.r_[np.zeros(900), rng.random(300)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.901, 1.0):
            assert math.isclose(R.exact_quantile(df, "v", q), df.agg(F.percentile("v", q)).first()[0], rel_tol=1e-12, abs_tol=1e-12)
    assert R.exact_quantile(df.where("false"), "v", 0.5) is None and R.lowest_share(df.where("false"), "v", 0.5).count() == 0


def plain_label(text, labels):
    def norm(x):
        return " ".join("".join(c if c.isascii() and (c.isalnum() or c in "_-'/") or c.isspace() else " " for c in (x or "").lower()).split())

    full = norm(text)
    answer = norm((text or "").split("assistant")[-1].split("Answer:")[-1].split("<|im_end|>")[0])
    for t in (answer, full):
        hit = [(-len(norm(x)), x) for x in labels if norm(x) and norm(x) in t]
        if hit:
            return min(hit)[1]
    return None


@pytest.mark.parametrize("held", [8 << 20, 200_000])
def test_labels_at_fifty_thousand_with_repeated_keys(spark, monkeypatch, held):
    monkeypatch.setattr(T, "AUTOMATON", held)
    rng = random.Random(3)
    labels = [f"gene {i} syndrome" for i in range(49_990)] + ["gout", "Flu", "flu", "FLU!", "the gout", "", "?", "gene 7"]
    texts = [f"It may be Gene {rng.randrange(49_990)} syndrome, or gout. Answer: {rng.choice(['flu', 'none', 'gene 7 x', 'the GOUT'])}" for _ in range(60)] + [None, "", "say gout", "say flu"]
    rows = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "k int, t string")
    got = T.mapped_labels(rows, spark.createDataFrame([(x,) for x in labels], "label string"), "k", F.col("t")).collect()
    assert sorted((r.k, r.pred or "") for r in got) == sorted((i % 20, plain_label(t, labels) or "") for i, t in enumerate(texts))
    none = T.mapped_labels(rows, spark.createDataFrame([], "label string"), "k", F.col("t")).collect()
    assert len(none) == len(texts) and all(r.pred is None for r in none)


def test_no_plan_joins_by_nested_loops(spark):
    rows = spark.createDataFrame([(1, "some text with gout")], "k int, t string")
    for df in (T.mapped_labels(rows, spark.createDataFrame([("gout",)], "label string"), "k", F.col("t")), T.naming_any(rows, spark.createDataFrame([("gout",)], "i string"), F.col("t"), F.col("i"))):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_common_subsequences_by_bits():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(max(row[j + 1], new[j], row[j] + (v == w)))
            row = new
        assert T._common(x, y) == row[-1]


def test_bleu_has_its_brevity_penalty(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e f g"), (2, "x a b c d", "x a b c d"), (3, "", "q")], "k int, g string, r string")
    got = T.corpus_bleu(df, "k", "g", "r").first()
    assert (got.guess_words, got.gold_words) == (10, 13) and math.isclose(got.brevity, math.exp(1 - 13 / 10)) and math.isclose(got.bleu, got.brevity)
    assert T.corpus_bleu(df.where("k = 3"), "k", "g", "r").first().bleu == 0


def test_odds_intervals_equal_refits_draw_by_draw(spark):
    rng = np.random.default_rng(6)
    rows = []
    for u in range(60):
        for dec in range(4):
            for d in range(2):
                n = int(rng.integers(5, 20))
                k = int(rng.binomial(n, 1 / (1 + math.exp(-(-1 + 0.3 * dec + 0.8 * d)))))
                rows += [(f"u{u}", dec, d, 1, k), (f"u{u}", dec, d, 0, n - k)]
    df = spark.createDataFrame(rows, "u string, dec int, d int, y int, w long")
    got = {r.term: r for r in R.odds_intervals(df, [], ["dec", "d"], "y", "w", "u", 25).collect()}
    weights = {(r.draw, r.u): r.weight for r in R.poisson_weights(df.select("u").distinct(), "u", 25, "odds").collect()}

    def fit(of):
        x = np.array([(1, r[1], r[2]) for r in rows], float)
        y, w, b = np.array([r[3] for r in rows]), np.array([r[4] * of(r[0]) for r in rows], float), np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
        return np.exp(b)

    own = fit(lambda u: 1)
    draws = np.array([fit(lambda u, d=d: weights[d, u]) for d in range(25)])
    for i, term in enumerate(["intercept", "dec", "d"]):
        assert math.isclose(got[term].odds_ratio, own[i], rel_tol=1e-6)
        assert np.allclose([got[term].ci_low, got[term].ci_high], np.percentile(draws[:, i], [2.5, 97.5]), rtol=1e-6)
