"""Matching in an order against the plain walk."""

import random
from bisect import bisect_left

import pytest

from armwise.operators import matching as X


def plain(targets, pool, levels=((),)):
    """targets: (order, key, group, value, tiers); pool: (key, group, value, tiers). What each key takes, one after the other."""
    used, out = set(), {}
    for _, key, g, v, tiers in sorted(targets):
        out[key] = None
        for cols in levels:
            axis = sorted((x, k) for k, h, x, s in pool if h == g and x is not None and [s[c] for c in cols] == [tiers[c] for c in cols])
            at = bisect_left([x for x, _ in axis], v) if v is not None else 0
            lo, hi, best = at - 1, at, None
            while v is not None and best is None and (lo >= 0 or hi < len(axis)):
                below = v - axis[lo][0] if lo >= 0 else float("inf")
                above = axis[hi][0] - v if hi < len(axis) else float("inf")
                if below <= above:
                    best, lo = (None if axis[lo][1] in used else axis[lo][1]), lo - 1
                else:
                    best, hi = (None if axis[hi][1] in used else axis[hi][1]), hi + 1
            if best is not None:
                used.add(best)
                out[key] = best
                break
    return out


def run(spark, targets, pool, levels=((),), size=None):
    names = ["s0", "s1"]
    t = spark.createDataFrame([(o, k, g, v, *s) for o, k, g, v, s in targets], "o int, k long, g string, v double, s0 string, s1 string")
    c = spark.createDataFrame([(k, g, v, *s) for k, g, v, s in pool], "k long, g string, v double, s0 string, s1 string")
    rows = X.in_order(t, c, ["g"], "k", "v", ["o"], [[names[i] for i in cols] for cols in levels], size).collect()
    assert len(rows) == len(targets)
    value = {k: v for k, _, v, _ in pool}
    own = {k: v for _, k, _, v, _ in targets}
    assert all(r.distance == abs(value[r.control] - own[r.k]) for r in rows if r.control is not None)
    return {r.k: r.control for r in rows}


def made(seed, n, m, spread, hot=0.4):
    rng = random.Random(seed)

    def group():
        return "hot" if rng.random() < hot else rng.choice(["a", "b", None])

    def one(k):
        return k, group(), None if rng.random() < 0.03 else float(rng.randrange(spread)) / 2, [rng.choice(["x", "y", None]), rng.choice(["p", "q"])]

    return [(rng.randrange(n), *one(k)) for k in range(n)], [one(1000 + k) for k in range(m)]


@pytest.mark.parametrize(("seed", "n", "m", "spread", "size"), [(1, 120, 200, 60, 7), (2, 200, 120, 400, 11), (3, 150, 150, 3, 10), (4, 60, 300, 1000, 1000)])
def test_equals_the_sequential_walk(spark, seed, n, m, spread, size):
    targets, pool = made(seed, n, m, spread)
    assert run(spark, targets, pool, size=size) == plain(targets, pool)


def test_levels_equal_the_sequential_walk(spark):
    targets, pool = made(5, 120, 150, 50)
    levels = ((0, 1), (0,), (1,), ())
    assert run(spark, targets, pool, levels, size=13) == plain(targets, pool, levels)


def test_settling_in_any_order_of_arrival_is_the_same():
    rng = random.Random(9)
    values = sorted(float(rng.randrange(40)) for _ in range(60))
    targets = [["g", float(rng.randrange(-5, 45)), i, [], 0, 0, 0, 0.0, 0, 0.0, 0, None] for i in range(80)]
    axis = X.Axis([("g", values[0])], [("g", values[-1])], [X.FAR])
    want = [list(t) for t in targets]
    X.settle(0, want, ["g"] * 60, values, [[]] * 60, axis, [[]])
    got = [list(t) for t in targets]
    for some in (got[::3], got[1::3], got[2::3]):
        settled = [t for t in got if t[11] is not None]
        X.settle(0, settled + [t for t in some if t not in settled], ["g"] * 60, values, [[]] * 60, axis, [[]])
        while any(t[11] is None and t[10] >= 0 for t in some):
            X.settle(0, [t for t in got if t[11] is not None] + [t for t in some if t[11] is None and t[10] >= 0], ["g"] * 60, values, [[]] * 60, axis, [[]])
    assert sorted((t[2], t[11]) for t in got if t[11] is not None) == sorted((t[2], t[11]) for t in want if t[11] is not None)


def test_a_group_is_found_in_its_range_without_reading_all_controls():
    class Seen(list):
        reads = 0

        def __getitem__(self, i):
            self.reads += 1
            return super().__getitem__(i)

        def __iter__(self):
            self.reads += len(self)
            return super().__iter__()

    groups, values = Seen(["a"] * 500 + ["b"] * 300 + ["c"] * 200), [float(i) for i in [*range(500), *range(300), *range(200)]]
    axis = X.Axis([("a", 0.0)], [("c", 199.0)], [X.FAR])
    targets = [[g, v, i, [], 0, 0, 0, 0.0, 0, 0.0, 0, None] for i, (g, v) in enumerate([("a", 499.0), ("b", 0.0), ("c", 300.0), ("b", 0.2), ("a", 600.0), ("d", 1.0)])]
    X.settle(0, targets, groups, values, [], axis, [[]])
    assert [t[11] for t in targets] == [499, 500, 999, 501, 498, None]
    assert groups.reads < 100


def test_only_ranges_that_are_asked_are_settled_again(spark, monkeypatch):
    written, keep = [], X._kept

    def kept(df, name):
        out = keep(df, name)
        if name not in ("controls", "targets"):
            written.append(out.count())
        return out

    monkeypatch.setattr(X, "_kept", kept)
    pool = [(1000 + k, "g", float(k), ["x", "p"]) for k in range(400)]
    targets = [(k, k, "g", float(200 + k), ["x", "p"]) for k in range(200)] + [(k % 7, 500 + k, "g", 0.0, ["x", "p"]) for k in range(30)]
    assert run(spark, targets, pool, size=10) == plain(targets, pool)
    assert len(written) > 6 and sum(written) < 4 * len(targets)


def test_empty_sides(spark):
    targets, pool = made(6, 5, 5, 9)
    assert set(run(spark, targets, pool[:0] + [(1, "a", None, ["x", "p"])]).values()) == {None}
    t = spark.createDataFrame([], "o int, k long, g string, v double")
    assert X.in_order(t, spark.createDataFrame([(1, "a", 1.0)], "k long, g string, v double"), ["g"], "k", "v", ["o"]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_assignment_equals_trying_all(seed):
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), int(rng.integers(6, 8))
    cost = rng.integers(0, 6, (n, m)).astype(float) if seed % 2 else rng.random((n, m))
    to = X.cheapest(cost)
    assert len(set(to)) == n
    assert abs(cost[range(n), to].sum() - min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_cheapest_assignment_in_one_dimension_is_by_rank():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.random(150), rng.random(150)
    cost = np.abs(a[:, None] - b[None, :])
    assert abs(cost[range(150), X.cheapest(cost)].sum() - np.abs(np.sort(a) - np.sort(b)).sum()) < 1e-9


def test_assigned_rows_come_back_once_with_least_cost(spark):
    from itertools import permutations

    rng = random.Random(4)
    left = [(i, g, rng.random(), rng.choice([10, 11])) for g in ("a", "b", None) for i in range(4 if g == "a" else 3)] + [(50, "c", 1.0, 1), (51, "a", None, 3)]
    right = [(100 + i, g, rng.random(), rng.choice([10, 11, 12])) for g in ("a", "b", None) for i in range(6 if g == "b" else 3)]
    names = "k long, g string, gc double, n int"
    rows = X.assigned(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ["g"], "k", {"gc": 1.0, "n": 1000.0}).collect()
    assert sorted((r.k, r.side) for r in rows) == sorted([(r[0], "left") for r in left] + [(r[0], "right") for r in right])
    for g in ("a", "b", None):
        a, b = [r for r in left if r[1] == g and r[2] is not None], [r for r in right if r[1] == g]
        few, many = (a, b) if len(a) <= len(b) else (b, a)
        best = min(sum(abs(x[2] - y[2]) + 1000 * abs(x[3] - y[3]) for x, y in zip(few, p)) for p in permutations(many, len(few)))
        got = [r for r in rows if r.g == g and r.side == "left" and r.partner is not None]
        assert len(got) == len(few) and abs(sum(r.cost for r in got) - best) < 1e-9
    capped = X.assigned(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ["g"], "k", {"gc": 1.0}, most=2).collect()
    assert len(capped) == len(left) + len(right) and sum(r.partner is not None for r in capped) == 12


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_classes_cost_as_much_as_all_pairs(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n, fields, spread = int(rng.integers(1, 25)), int(rng.integers(1, 4)), [2, 6, 1000][seed % 3]
    a, b = rng.integers(0, spread, (n, fields)).astype(float), rng.integers(0, spread, (n + seed, fields)).astype(float)
    b[:, 0] += spread / 2 * (seed % 2)  # rows outnumber columns on one side
    weights = rng.choice([1.0, 0.5, 0.0, 1000.0] + [-1.0] * (seed % 4 == 0), fields)
    cost = (np.abs(a[:, None] - b[None]) * weights).sum(2)
    (x, supply), (y, room) = (np.unique(s, axis=0, return_counts=True) for s in (a, b))
    flow = X.cheapest_classes(x, supply, y, room, weights)
    spent, used = np.zeros(len(x), int), np.zeros(len(y), int)
    for k, j, q in flow:
        spent[k] += q
        used[j] += q
    assert (spent == supply).all() and (used <= room).all()
    assert sum(q * (np.abs(x[k] - y[j]) @ weights) for k, j, q in flow) == pytest.approx(cost[range(n), X.cheapest(cost)].sum())


def test_sides_of_any_size_are_assigned_whole(spark):
    rng = random.Random(7)
    made = [[(k, f"g{k % 2}", float(rng.randrange(900)), k % 3) for k in range(start, start + n)] for start, n in ((0, 2400), (5000, 3000))]
    bad = [(9000, "g0", float("nan"), 1), (9001, "g0", float("inf"), 1), (9002, "g0", None, 1)]
    left, right = (spark.createDataFrame(rows, "k long, g string, c double, n int") for rows in (made[0] + bad, made[1]))
    rows = X.assigned(left, right, ["g"], "k", {"c": 1.0, "n": 1000.0}).collect()
    of = {(r.side, r.k): r for r in rows}
    assert len(rows) == len(of) == 5403 and all(of["left", k].partner is None for k, *_ in bad)
    held = {k: (g, c, n) for rows in made for k, g, c, n in rows}
    for k, g, c, n in made[0]:
        r = of["left", k]
        other = held[r.partner]
        assert other[0] == g and of["right", r.partner].partner == k and r.cost == abs(c - other[1]) + 1000 * abs(n - other[2])
