"""One-to-one matching in an order: each target takes the nearest control that no target before it has taken.

The order makes the result unique, and targets need not come in that order to reach it: a control that several targets want
goes to the first of them, and the others look on from where they stand, as in deferred acceptance with one order for all
controls. So the sorted axis of controls is cut into ranges, rounds settle all targets that stand at a range in one task, and
those that find nothing near enough inside go on to the next range on the nearer side. A range whose controls are all held by
targets before one is passed over.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armwise.sources.writers import scratch

#: About how many controls a range has at most and, where there are enough, at least; targets that a range takes in a round beside those it holds, times its controls.
RANGE, LEAST, INTAKE = 100_000, 2_000, 2
FAR = float("inf")
#: Columns of a target under way, with their types.
STATE = {
    "g": ("string", pa.string()), "v": ("double", pa.float64()), "tid": ("long", pa.int64()), "tiers": ("array<string>", pa.list_(pa.string())), "level": ("int", pa.int32()), "home": ("int", pa.int32()),
    "lo": ("int", pa.int32()), "lob": ("double", pa.float64()), "hi": ("int", pa.int32()), "hib": ("double", pa.float64()), "at": ("int", pa.int32()), "pos": ("int", pa.int32()),
}


@dataclass
class Axis:
    """The ranges' first and last places, how many controls each has, and up to which target a full one is held (else far)."""

    first: list[tuple[str, float]]
    last: list[tuple[str, float]]
    held: list[float]

    def below(self, g: str, v: float, part: int) -> tuple[int, float]:
        """The range below part on this group's axis and how near its controls can be."""
        q = part - 1
        return (q, v - self.last[q][1]) if q >= 0 and self.last[q][0] == g else (-1, FAR)

    def above(self, g: str, v: float, part: int) -> tuple[int, float]:
        q = part + 1
        return (q, self.first[q][1] - v) if q < len(self.first) and self.first[q][0] == g else (-1, FAR)


class Walk:
    """The free places of one list of controls, with pointers past those that are taken."""

    def __init__(self, places: Sequence[int], values: list[float]):
        self.places, self.values = places, values
        self.down, self.up = list(range(len(places))), list(range(len(places) + 1))

    def _find(self, pointer: list[int], k: int, step: int, used: bytearray) -> int:
        trail, places, n = [], self.places, len(self.places)
        while 0 <= k < n:
            if pointer[k] != k:
                trail.append(k)
                k = pointer[k]
            elif used[places[k]]:
                pointer[k] = k + step
                trail.append(k)
                k += step
            else:
                break
        for x in trail:
            pointer[x] = k
        return k

    def nearest(self, v: float, used: bytearray) -> tuple[int, int]:
        """The nearest free places below v and from v on; -1 where there is none."""
        b = bisect_left(self.values, v)
        a, places = b - 1, self.places
        if a >= 0 and used[places[a]]:
            a = self._find(self.down, a, -1, used)
        if b < len(places) and used[places[b]]:
            b = self._find(self.up, b, 1, used)
        return (places[a] if a >= 0 else -1), (places[b] if b < len(places) else -1)


def settle(part: int, targets: list[list], groups: list[str], values: list[float], tiers: list[Sequence[str]], axis: Axis, levels: list[list[int]]) -> None:
    """Targets (rows of STATE, changed in place) in their order over the controls of one range: pos is set where one takes a
    control, at where it goes on to another range, and at is -1 where nothing is left for it. Targets that hold a control and
    come before all that are new keep it."""
    used = bytearray(len(values))
    members: dict[int, dict[tuple, Sequence[int]]] = {}
    walks: dict[tuple, Walk] = {}

    def walk(kind: tuple) -> Walk:
        level = kind[0]
        if not levels[level]:  # a group's controls lie side by side
            a, b = bisect_left(groups, kind[1]), bisect_right(groups, kind[1])
            walks[kind] = Walk(range(a, b), values[a:b])
            return walks[kind]
        if level not in members:
            found = members[level] = {}
            for i, g in enumerate(groups):
                found.setdefault((level, g, *[tiers[i][c] for c in levels[level]]), []).append(i)
        places = members[level].get(kind, [])
        walks[kind] = Walk(places, [values[i] for i in places])
        return walks[kind]

    new = min((t[2] for t in targets if t[11] is None), default=FAR)
    for t in targets:
        if t[2] < new:
            used[t[11]] = 1
    for t in sorted([t for t in targets if t[2] >= new], key=itemgetter(2)):
        g, v = t[0], t[1]
        while True:
            cols = levels[t[4]]
            kind = (t[4], g, *[t[3][c] for c in cols]) if cols else (t[4], g)
            a, b = (walks.get(kind) or walk(kind)).nearest(v, used)
            low = high = -1
            if t[6] == part:
                low = a
                t[6], t[7] = (part, v - values[a]) if a >= 0 else axis.below(g, v, part)
            if t[8] == part:
                high = b
                t[8], t[9] = (part, values[b] - v) if b >= 0 else axis.above(g, v, part)
            if t[7] == t[9] == FAR:
                if not _widened(t, len(levels)):
                    break
                if t[10] != part:
                    break
                continue
            takes, to = (low, t[6]) if t[7] <= t[9] else (high, t[8])
            t[10], t[11] = to, None
            if takes >= 0:
                used[takes], t[11] = 1, takes
            break


def _widened(t: list, levels: int) -> bool:
    """Whether a target has another level to look at; it starts again from home."""
    t[11] = None
    if t[4] + 1 == levels:
        t[10] = -1
        return False
    t[4], t[6], t[7], t[8], t[9], t[10] = t[4] + 1, t[5], 0.0, t[5], 0.0, t[5]
    return True


def advance(t: list, axis: Axis, levels: int) -> None:
    """An open target past ranges that targets before it hold as a whole."""
    g, v, tid = t[0], t[1], t[2]
    while t[10] >= 0:
        moved = False
        if t[6] >= 0 and axis.held[t[6]] < tid:
            t[6], t[7] = axis.below(g, v, t[6])
            moved = True
        if t[8] >= 0 and axis.held[t[8]] < tid:
            t[8], t[9] = axis.above(g, v, t[8])
            moved = True
        if t[7] == t[9] == FAR:
            _widened(t, levels)
            continue
        t[10] = t[6] if t[7] <= t[9] else t[8]
        if not moved:
            return


def _strings(column: pa.ChunkedArray) -> list[str]:
    """A column's strings, equal ones as one object."""
    coded = pa.chunked_array(column).combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    return [names[i] for i in coded.indices.to_numpy().tolist()]


def _rows(t: pa.Table) -> list[list]:
    """Rows of STATE; without tiers among the columns, each has none."""
    cols = {c: _strings(t[c]) if c == "g" else t[c].to_pylist() if c == "tiers" else t[c].fill_null(-1).to_numpy().tolist() for c in t.column_names}
    cols["pos"] = [None if p < 0 else p for p in cols["pos"]]
    cols.setdefault("tiers", [()] * len(t))
    return [list(r) for r in zip(*[cols[c] for c in STATE])]


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    cols = dict(zip(STATE, zip(*rows))) if rows else {}
    return pa.table([pa.array(cols.get(f.name, []), f.type) for f in schema], schema=schema)


def in_order(targets: DataFrame, pool: DataFrame, within: Sequence[str], key: str, value: str, order: Sequence[str], levels: Sequence[Sequence[str]] = ((),), size: int | None = None) -> DataFrame:
    """within, key, control, distance and level for every target, in its group the nearest control by value that is left.

    Targets take their turns by the order columns (ascending, then key). Of two controls as near the lower one is taken, and of
    equal controls the one whose place in the order of (value, key) is nearest. levels: columns that must agree, one list after
    the other: a level is looked at where those before it have nothing left. size: about how many controls a range has.
    A round settles the ranges that targets ask for and writes these alone; what others hold stays where their last round wrote it.
    Defined cases: a target without a value, or for which nothing is left, has a null control; controls without a value are
    never taken; null groups are a group, null tiers agree with each other; repeated rows are targets or controls each; empty
    sides give no pairs.
    """
    spark = targets.sparkSession
    tiers = list(dict.fromkeys(c for cols in levels for c in cols))
    at_level = [[tiers.index(c) for c in cols] for cols in levels]
    group = F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(within)])) if within else F.lit("")
    tier = F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in tiers]).cast("array<string>")
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))

    asis, made = ([F.col("tiers")], [tier.alias("tiers")]) if tiers else ([], [])
    pool_rows = pool.select(group.alias("g"), number.alias("v"), F.col(key).alias("control"), *made).where("v is not null")
    own = F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(within)], F.col(key).alias("key"))
    turns = [f"o{i}" for i in range(len(order))]
    target_rows = targets.select(group.alias("g"), number.alias("v"), own.alias("own"), *[F.col(c).alias(o) for c, o in zip(order, turns, strict=True)], *made)
    total = pool_rows.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = size or min(RANGE, max(LEAST, -(-total // parts)))
    # Partitions by (group, value, key) are the ranges, and places in them the row numbers; a target's number is its place in the order, with gaps.
    controls = _laid(pool_rows, total, size, ["g", "v", "control"])
    controls = _kept(controls.select("g", "v", "control", *asis, F.spark_partition_id().alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).cast("int").alias("place")), "controls")
    named = _laid(target_rows, target_rows.count(), max(size, LEAST), [*turns, "own.key"])
    named = _kept(named.select("g", "v", "own", *asis, F.col("_at").alias("tid")), "targets")
    mine = [*[F.col(f"own.w{i}").alias(c) for i, c in enumerate(within)], F.col("own.key").alias(key)]
    counted = F.broadcast(controls.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    edges = controls.select("part", "place", "g", "v").join(counted, "part").where("place = 0 or place = n - 1").orderBy("part", "place").collect()  # two rows a range at most
    first, ends = [r for r in edges if r.place == 0], [r for r in edges if r.place == r.n - 1]
    if not [r.part for r in first] == [r.part for r in ends] == list(range(len(ends))):
        raise ValueError("controls changed while they were read")
    axis = Axis([(r.g, r.v) for r in first], [(r.g, r.v) for r in ends], [FAR] * len(ends))
    columns = [c for c in STATE if tiers or c != "tiers"]
    schema = pa.schema([(c, STATE[c][1]) for c in columns])
    ddl = ", ".join(f"{c} {STATE[c][0]}" for c in columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(axis.last)
        for b in batches:
            t = pa.Table.from_batches([b])
            g, v = _strings(t["g"]), t["v"].to_numpy().tolist()
            home = np.fromiter((bisect_left(axis.last, gv) for gv in zip(g, v)), np.int32, len(g))
            lo, lob, hi, hib = home.copy(), np.zeros(len(g)), home.copy(), np.zeros(len(g))
            for i in np.flatnonzero(home == n):
                lo[i], lob[i] = axis.below(g[i], v[i], n)
                hi[i], hib[i] = -1, FAR
            home = np.minimum(home, n - 1)
            new = {"level": np.zeros(len(g), np.int32), "home": home, "lo": lo, "lob": lob, "hi": hi, "hib": hib, "at": home, "pos": pa.nulls(len(g), pa.int32())}
            yield from pa.table([pa.array(new[c]) if c in new else t[c] for c in columns], schema=schema).to_batches()

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _rows(pa.Table.from_batches([b]))
            for t in rows:
                advance(t, axis, len(at_level))
            yield from _table(rows, schema).to_batches()

    def settled(mine: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("place")
        rows = _rows(mine.select(columns))
        settle(there["part"][0].as_py(), rows, _strings(there["g"]), there["v"].to_numpy().tolist(), there["tiers"].to_pylist() if tiers else [], axis, at_level)
        return _table(rows, schema)

    def holding(among: set[int]) -> DataFrame | None:
        """Targets that hold a control of these ranges, from the last round of each."""
        held = None
        for i, done in enumerate(rounds):
            some = sorted(p for p in among if last_round[p] == i)
            if some:
                one = done.where("pos is not null").where(_in("at", some, len(ends)))
                held = one if held is None else held.unionByName(one)
        return held

    rounds: list[DataFrame] = []
    last_round: dict[int, int] = {}
    going = _kept(named.where("v is not null").select("g", "v", "tid", *asis).mapInArrow(placed, ddl), "going") if ends else None
    while going is not None:
        asked = going.where("at >= 0")
        counts = {r["at"]: r["count"] for r in asked.groupBy("at").count().collect()}  # at most a row a range
        if not counts:
            break
        now, waiting, intake = asked, None, INTAKE * size
        if max(counts.values()) > intake:
            salted = asked.withColumn("_s", F.pmod(F.xxhash64("tid"), F.lit(1 + sum(counts.values()) // max(1, intake))))
            few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("at", "_s").orderBy("tid"))).where(F.col("_r") <= intake)
            first = few.withColumn("_r", F.row_number().over(Window.partitionBy("at").orderBy("tid")))
            now = _kept(first.where(F.col("_r") <= intake).select(*columns), "now")
            waiting = asked.join(now.select("tid"), "tid", "left_anti").select(*columns)
        held = holding(counts.keys() & last_round.keys())
        both = now if held is None else now.unionByName(held)
        there = controls.select("part", "place", "g", "v", *asis).where(_in("part", sorted(counts), len(ends)))
        done = _kept(both.groupBy("at").cogroup(there.groupBy("part")).applyInArrow(settled, ddl), "settled")
        last_round |= dict.fromkeys(counts, len(rounds))
        rounds.append(done)
        most = {r["at"]: r for r in done.where("pos is not null").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("tid").alias("most")).collect()}
        axis = Axis(axis.first, axis.last, [(most[i].most if i in most and most[i].n == ends[i].n else FAR) if i in counts else x for i, x in enumerate(axis.held)])
        moved = done.where("pos is null and at >= 0")
        going = _kept((moved if waiting is None else moved.unionByName(waiting)).mapInArrow(advanced, ddl), "going")
    state = holding(set(last_round))
    if state is None:
        return named.select(*mine, F.lit(None).cast(pool.schema[key].dataType).alias("control"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("level"))
    took = state.select("tid", "level", F.col("at").alias("part"), F.col("pos").alias("place")).join(controls.select("part", "place", "control", F.col("v").alias("_v")), ["part", "place"])
    return named.join(took, "tid", "left").select(*mine, "control", F.abs(F.col("_v") - F.col("v")).alias("distance"), "level")


def _laid(rows: DataFrame, n: int, size: int, order: Sequence[str]) -> DataFrame:
    """Rows in partitions of about size by one order over all, sorted, with _at ascending in that order and counting from the start of a partition."""
    return rows.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def _in(column: str, parts: list[int], of: int) -> str:
    return "true" if len(parts) == of else f"{column} in ({', '.join(map(str, parts))})"


def cheapest(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix with no more rows than columns its column in an assignment of least total cost.

    Rows join one by one along shortest augmenting paths in reduced costs; a step over all columns is one array operation.
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    of = np.full(m, -1)
    for i in range(n):
        least, through = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, j, far = i, -1, 0.0
        while True:
            reach = far + cost[row] - u[row] - v
            nearer = ~done & (reach < least)
            least[nearer], through[nearer] = reach[nearer], j
            j = int(np.where(done, np.inf, least).argmin())
            far = least[j]
            done[j] = True
            if of[j] < 0:
                break
            row = of[j]
        settled = np.flatnonzero(done & (of >= 0))
        u[of[settled]] += far - least[settled]
        v[settled] -= far - least[settled]
        u[i] += far
        while j >= 0:
            before = through[j]
            of[j] = of[before] if before >= 0 else i
            j = before
    out = np.empty(n, int)
    out[of[of >= 0]] = np.flatnonzero(of >= 0)
    return out


def cheapest_classes(x: np.ndarray, supply: np.ndarray, y: np.ndarray, room: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(row class, column class, how many) of least total cost, where all rows find room; classes are distinct points of a pair's fields.

    Rows join one by one along shortest augmenting paths, as in cheapest(), but costs are made where they are looked at: columns
    with room have potential 0 and others at most 0, so no path is shorter by a column that costs more than the nearest one with
    room. Columns lie sorted by the field of most values, and a row looks at those within that reach. Memory grows with the
    classes; time is near their number where sides are mixed, and cubic at worst, where rows far outnumber columns in a region.
    """
    m = len(y)
    varied = [len(np.unique(y[:, f])) if w > 0 else 0 for f, w in enumerate(weights)]
    axis = int(np.argmax(varied))
    laid = np.argsort(y[:, axis], kind="stable")
    y, free = y[laid], room[laid].astype(int)
    along = max(float(weights[axis]), 0.0)
    pos, px = (y[:, axis] * along).tolist(), (x[:, axis] * along).tolist()
    slack = sum(-w * (max(x[:, f].max(), y[:, f].max()) - min(x[:, f].min(), y[:, f].min())) for f, w in enumerate(weights) if w < 0)
    u, v, least, through = np.zeros(len(x)), np.zeros(m), np.full(m, np.inf), np.full(m, -1)
    flow: list[dict[int, int]] = [{} for _ in range(m)]

    def nearest(i: int) -> tuple[float, int]:
        """A column with room, the nearest unless the window ends before that is sure, and its cost."""
        at, wide = bisect_left(pos, px[i]), 16
        while True:
            lo, hi = max(0, at - wide), min(m, at + wide)
            some = lo + np.flatnonzero(free[lo:hi])
            edge = min(px[i] - pos[lo] if lo else FAR, pos[hi - 1] - px[i] if hi < m else FAR) - slack
            if len(some):
                c = np.abs(y[some] - x[i]) @ weights
                a = int(c.argmin())
                if c[a] <= edge or edge == FAR:
                    return float(c[a]), int(some[a])
            wide *= 2

    for i in range(len(x)):
        left = int(supply[i])
        while left:
            cost, sink = nearest(i)
            best, last = cost - u[i], i
            rows, came, queue, settled, touched = {i: 0.0}, {i: -1}, [], [], []
            todo = [i]
            while True:
                for k in todo:
                    far = rows[k]
                    reach = (best - far + u[k] + slack) * (1 + 1e-12)
                    lo, hi = bisect_left(pos, px[k] - reach), bisect_right(pos, px[k] + reach)
                    d = np.maximum(far if k != i else -FAR, far + np.abs(y[lo:hi] - x[k]) @ weights - u[k] - v[lo:hi])
                    near = np.flatnonzero(d < np.minimum(least[lo:hi], best))
                    d, near = d[near], near + lo
                    some = free[near] > 0
                    if some.any():
                        a = int(np.where(some, d, np.inf).argmin())
                        best, sink, last = float(d[a]), int(near[a]), k
                    on = ~some & (d < best)
                    d, near = d[on], near[on]
                    least[near], through[near] = d, k
                    touched.append(near)
                    for entry in zip(d.tolist(), near.tolist()):
                        heappush(queue, entry)
                todo = []
                while queue and not todo:
                    far, j = heappop(queue)
                    if far >= best:
                        queue = []
                    elif far == least[j]:
                        settled.append((j, far))
                        least[j] = -np.inf
                        todo = [k for k in flow[j] if k not in rows]
                        for k in todo:
                            rows[k], came[k] = far, j
                if not todo:
                    break
            for k, far in rows.items():
                u[k] += best - far
            for j, far in settled:
                v[j] -= best - far
            for some in touched:
                least[some] = np.inf
            path, k = [(last, sink)], last
            while came[k] >= 0:
                path.append((int(through[came[k]]), came[k]))
                k = path[-1][0]
            # each row of the path but the first gives up as many of the column that led to it
            given = [(k, came[k]) for k, _ in path if came[k] >= 0]
            n = min(left, int(free[sink]), *[flow[j][k] for k, j in given])
            for k, j in path:
                flow[j][k] = flow[j].get(k, 0) + n
            for k, j in given:
                flow[j][k] -= n
                if not flow[j][k]:
                    del flow[j][k]
            free[sink] -= n
            left -= n
    return sorted((k, int(laid[j]), n) for j, of in enumerate(flow) for k, n in of.items())


def assigned(left: DataFrame, right: DataFrame, within: Sequence[str], key: str, costs: dict[str, float], most: int | None = None, salt: str = "select") -> DataFrame:
    """within, key, side, partner and cost: in each group the one-to-one pairs of left and right of least total cost.

    A pair costs the sum of weight * |difference| over the columns that costs names. Every row comes back: partner is null for
    the rows that the smaller side leaves over. A group is one task's work, with memory for its rows and none for its pairs;
    rows of equal costs count as a class. most: an experiment that wants balanced samples takes that many rows of a side, the
    first in hash order, and leaves the others without partner. Keys are unique in a group and side; rows with a null, NaN or
    infinite cost column have no partner.
    """
    from armwise.functions.sequence import pick

    kind = left.schema[key].dataType.simpleString()
    group = F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(within)])) if within else F.lit("")
    fields = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(costs)]
    weights = np.array(list(costs.values()))
    both = None
    for side, rows in (("left", left), ("right", right)):
        one = rows.select(group.alias("g"), F.lit(side).alias("side"), F.col(key).alias("key"), *fields, pick(F.lit(salt), F.lit(side), F.col(key).cast("string")).alias("h"), F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(within)], F.lit(0).alias("_")).alias("w"))
        both = one if both is None else both.unionByName(one)
    both = _kept(both, "sides")
    pieces = both.where(" AND ".join(f"abs(c{i}) < double('infinity')" for i in range(len(costs))))
    if most is not None:
        pieces = pieces.withColumn("p", F.pmod(F.xxhash64("key"), F.lit(64)))  # a side of a group is cut before it is sorted as one
        for by in (["g", "side", "p"], ["g", "side"]):
            pieces = pieces.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "key"))).where(F.col("r") <= most)

    def classes(d: pd.DataFrame) -> tuple[np.ndarray, list[list[int]]]:
        """Distinct points in the order of their first rows, and each one's rows."""
        held: dict[tuple, list[int]] = {}
        for i, point in enumerate(d[[f"c{i}" for i in range(len(costs))]].itertuples(index=False, name=None)):
            held.setdefault(point, []).append(i)
        return np.array(list(held), float), list(held.values())

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values(["h", "key"]) for s in ("left", "right"))
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("g", "side", "key", "partner", "cost")})
        swap = len(a) > len(b)
        few, many = (b, a) if swap else (a, b)
        (x, own), (y, there) = classes(few), classes(many)
        to, spent = np.empty(len(few), int), np.empty(len(few))
        for k, j, n in cheapest_classes(x, np.array([len(r) for r in own]), y, np.array([len(r) for r in there]), weights):
            mine, theirs = own[k][:n], there[j][:n]
            own[k], there[j] = own[k][n:], there[j][n:]
            to[mine], spent[mine] = theirs, np.abs(x[k] - y[j]) @ weights
        one, other = few["key"].to_numpy(), many["key"].to_numpy()[to]
        names = ("right", "left") if swap else ("left", "right")
        return pd.DataFrame({"g": pdf["g"].iloc[0], "side": [names[0]] * len(one) + [names[1]] * len(one), "key": [*one, *other], "partner": [*other, *one], "cost": [*spent, *spent]})

    met = pieces.select("g", "side", "key", "h", *[f"c{i}" for i in range(len(costs))]).groupBy("g").applyInPandas(pairs, f"g string, side string, key {kind}, partner {kind}, cost double")
    out = both.join(met, ["g", "side", "key"], "left")
    return out.select(*[F.col(f"w.w{i}").alias(c) for i, c in enumerate(within)], F.col("key").alias(key), "side", "partner", "cost")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
