"""Reports against plain versions: pairs counted without pairs, draws, random signs, lists, empty and awkward tables."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from armwise.operators import reports as P
from armwise.operators.resample import POISSON


def weight(draw: int, unit, salt: str = "report") -> int:
    u = int(hashlib.md5("|".join([salt, str(draw), *([] if unit is None else [str(unit)])]).encode()).hexdigest()[:12], 16) / (1 << 48)
    return 1 if draw < 0 else sum(u >= c for c in POISSON)


def test_pairs_are_counted_as_if_made(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([*"uvw", None]), rng.choice([*"xyz", None]), rng.choice([*"xyz", None])) for _ in range(160)]
    want = {s: [0] * 5 for s in ("sensitivity", "stability")}
    for a, b in itertools.combinations([r for r in rows if None not in r], 2):
        if a[0] == b[0] and a[1] != b[1]:
            w = want["sensitivity" if a[2] != b[2] else "stability"]
            right = (a[2] == a[3]) + (b[2] == b[3])
            for i, x in enumerate((True, a[3] != b[3], right == 2, right == 1, right == 0)):
                w[i] += x
    got = P.pair_report(spark.createDataFrame(rows, "t string, v string, l string, p string"), "t", "v", "l", "p").collect()
    assert {r.stratum: list(r[1:]) for r in got} == want
    empty = P.pair_report(spark.createDataFrame([], "t string, v string, l string, p string"), "t", "v", "l", "p").collect()
    assert [list(r[1:]) for r in empty] == [[0] * 5] * 2


def test_draws_equal_hashed_weights(spark):
    rows = [(g, u, v) for g, u, v in zip("aabbbaab", [1, 2, 1, 2, 3, None, 1, 3], [5, None, 7, 1, 2, 4, 10, 3])]
    got = P.drawn_sums(spark.createDataFrame(rows, "g string, u long, v long"), ["g"], "u", ["v"], 30).collect()
    want, any_weight = defaultdict(int), set()
    for d in range(-1, 30):
        for g, u, v in rows:
            if weight(d, u):
                any_weight.add((g, d))
                want[g, d] += weight(d, u) * (v or 0)
    assert {(r.g, r.draw): r.v for r in got} == {k: want[k] for k in any_weight}


def test_signs_by_group(spark):
    rows = [("a", i, x) for i, x in enumerate([5, 1, -2, 4])] + [("b", i, 0) for i in range(4)] + [("c", 0, 3), ("c", 1, 9)]
    got = {r.g: r.p_e6 for r in P.sign_flips(spark.createDataFrame(rows, "g string, u long, x long"), ["g"], "u", "x", 50).collect()}
    plus = lambda d, u: int(hashlib.md5(f"flip|{d}|{u}".encode()).hexdigest()[:12], 16) % 2 == 0
    ge = sum(sum(x if plus(d, u) else -x for g, u, x in rows if g == "a") >= 8 for d in range(50))
    assert got == {"a": round((ge + 1) / 51 * 1e6), "b": 1_000_000, "c": None}


def test_lists_and_rank_correlation(spark):
    # ranks 1..5 cited in the order of 2, 1, 4; one cited gene is outside the list
    genes = [(0, 7, "wt", 1, 2, True, False), (0, 7, "wt", 2, 1, False, True), (0, 7, "wt", 3, None, None, None), (0, 7, "wt", 4, 4, False, True), (0, 7, "wt", 5, None, True, True), (0, 7, "wt", None, 3, True, True)]
    schema = "atlas long, cell long, cond string, rank long, cite long, ribo boolean, deg boolean"
    r = P.cited_lists(spark.createDataFrame(genes, schema)).collect()[0]
    assert (r.n_ref, r.ref_in, r.ref_ribo, r.ref_deg, r.n_ref5, r.ref5_deg) == (4, 3, 2, 2, 4, 2)
    assert r.rho == 500_000 and r.rising == 1 and r.ranked == 1  # squared place differences 1 + 1 + 0
    assert r.chance_deg == 4 * 3 * 200_000 and r.chance_ribo == 4 * 2 * 200_000
    assert r.depth == pytest.approx((7 / 3 - 1) / 4 * 1e6, abs=1)
    slots = P.cited_slots(spark.createDataFrame(genes, schema))
    assert slots.agg(F.sum("tot"), F.sum("cit")).collect()[0][:] == (5, 3)
    none = spark.createDataFrame([], schema)
    assert P.order_report(none, "wt", "scrambled", 5).count() == 0


def test_losses_of_missing_answers_and_repeated_clusters(spark):
    rows = [(e, e // 2, "0", arm, p, p == "x", p is not None, True, False) for e in range(6) for arm, p in (("wt", "x"), ("cut", None if e == 0 else "x" if e % 2 else "y"))]
    df = spark.createDataFrame(rows, "entity long, unit long, split string, arm string, pred string, correct boolean, mapped boolean, answered boolean, named boolean")
    got = {(r.arm, r.series): (r.n, r.value_e6) for r in P.delta_report(df, "wt", n_draws=10, n_flips=10).collect()}
    assert got == {("cut", "loss"): (3, 500_000), ("cut", "changed"): (6, 500_000)}
    arms = {(r.section, r.arm, r.series): (r.n, r.value_e6) for r in P.arm_report(df, n_draws=10).collect()}
    assert arms["arm", "cut", "accuracy"] == (3, 500_000) and arms["arm", "cut", "unmapped"] == (6, 166_667) and arms["split", "wt", "0"] == (6, 1_000_000)
    assert P.arm_report(df.limit(0), n_draws=5).count() == 0 and P.delta_report(df.limit(0), "wt", n_draws=5, n_flips=5).count() == 0


def test_paired_f1_over_an_arms_own_entities(spark):
    truth = spark.createDataFrame([(e, "x", t, 1) for e in (1, 2) for t in ("a", "b")], "entity long, aspect string, term string, weight long")
    said = spark.createDataFrame([("wt", 1, "x", "a"), ("wt", 1, "x", "b"), ("wt", 2, "x", "c"), ("cut", 1, "x", "a")], "arm string, entity long, aspect string, term string")
    covered = spark.createDataFrame([("wt", 1), ("wt", 2), ("cut", 1)], "arm string, entity long")
    got = {(r.arm, r.series): (r.n, r.value_e6) for r in P.f1_report(truth, said, covered, "wt", "cut", 5).collect()}
    assert got["wt", "f1"] == (2, 500_000)  # precision (1 + 0) / 2, recall (1 + 0) / 2
    assert got["cut", "f1"] == (1, 666_667)  # precision 1, recall 1/2
    assert got["cut", "f1_loss"] == (1, 333_333) and got["cut", "f1_left"] == (1, 666_667)  # against the reference's entity 1 alone
