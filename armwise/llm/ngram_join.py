"""N-gram Jaccard join by grouped prefixes.

Tokens of a document are its distinct 5-word shingles as 64-bit hashes, ordered from rare to frequent. Two sets that overlap
enough share a token of their prefixes, and a token of one document alone leads nowhere, so only prefix tokens of two
documents or more count. Documents of equal sets (two 64-bit sums over the set and its size) are one class. Classes that are
connected over shared prefix tokens come together in blocks of bounded size. There, classes of one size and prefix form a
group; groups that share a prefix token are filtered by size, and the members of the pairs that are left are verified where
they are not connected already.

Hashes travel packed: a map task writes, for each range of hashes, one row of sorted arrays as differences, so that counting
every token of the corpus shuffles some eight bytes a token, and the counts return only for tokens that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import arrowtext as at
from armwise.llm.common import written
from armwise.llm.graph import BROADCAST_ROWS, chunks, forest, stars

#: Tokens and documents of one packed chunk; documents of one verified block; members of a label that send two on to meet others.
CHUNK_TOKENS, CHUNK_DOCS, BLOCK, MANY = 1_000_000, 60_000, 2_000, 8
_PACKED = "bucket int, chunk long, kind int, a binary, b binary, c binary"


def _row(bucket: int, chunk: int, kind: int, *parts: bytes) -> tuple:
    return (bucket, chunk, kind, *parts, *[None] * (3 - len(parts)))


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte of rank, so that the empty high bytes of small ones lie together and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _whole(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(ordered: np.ndarray) -> bytes:
    """Sorted tokens as differences."""
    return _planes(np.diff(ordered, prepend=at.U(0)))


def _tokens(data: bytes) -> np.ndarray:
    return np.cumsum(_whole(data, "<u8"), dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "kind", "a", "b", "c"])


def _pack(sets: list[np.ndarray], keys: list[int | None], chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's tokens, a row a bucket of the hash range, and one row of what is known of its documents."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
    prints = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            prints[i] = s.sum(), at.mix(s).sum()
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    bounds = np.searchsorted(flat, np.array([(k << 64) // buckets for k in range(buckets)], np.uint64))
    bounds = np.append(bounds, len(flat))
    rows = []
    for k in range(buckets):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            rows.append(_row(k, chunk, 0, _steps(flat[a:b]), _planes(doc[a:b])))
    ids = np.array([(0, 1) if k is None else (k, 0) for k in keys], "<i8").reshape(-1, 2)
    rows.append(_row(chunk % buckets, chunk, 1, ids.tobytes(), n.astype("<i8").tobytes(), prints.astype("<u8").tobytes()))
    yield _batch(rows)


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple]:
    """Consecutive rows of one value of column by, as tuples."""
    rows = (r for b in at.released(batches) for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return groupby(rows, key=lambda r: r[by])


def token_table(docs: DataFrame, key: str, text: str, words: int, share: tuple[int, int]) -> DataFrame:
    """A row a document: node (unique), key, n, two fingerprints of its set, k (prefix tokens that repeat), and where k > 0 tokens,
    those of its tokens that occur in two documents or more, rarest first."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    num, den = share

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        sets: list[np.ndarray] = []
        keys: list[int | None] = []
        held = 0
        for b in at.released(batches):
            ids = b.column(0).to_pylist()
            for s in at.slices(b.column(1)):
                w = at.find_words(s)
                h = at.hash_spans(s.data, w.starts, w.ends)
                for r, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    sets.append(at.shingles(h[x:y], words))
                    keys.append(ids[s.lo + r])
                    held += len(sets[-1])
                    if held >= CHUNK_TOKENS or len(sets) >= CHUNK_DOCS:
                        yield from _pack(sets, keys, chunk, buckets)
                        chunk, sets, keys, held = chunk + 1, [], [], 0
        if sets:
            yield from _pack(sets, keys, chunk, buckets)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches, 0):
            chunks, tokens, docs_of, meta = [], [], [], []
            for r in rows:
                if r[2]:
                    meta.append(r)
                    continue
                tokens.append(_tokens(r[3]))
                docs_of.append(_whole(r[4], "<u2"))
                chunks.append(r[1])
            if meta:
                yield _batch(meta)
            if not tokens:
                continue
            place = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            token, doc = np.concatenate(tokens), np.concatenate(docs_of)
            order = np.argsort(token, kind="stable")
            token = token[order]
            new = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            df = np.diff(np.append(new, len(token)))
            many = np.repeat(df > 1, df)
            order, token, df = order[many], token[many], np.repeat(df, df)[many]
            place, doc = place[order], doc[order]
            back = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[back], np.arange(len(chunks) + 1))
            out = []
            for i, chunk in enumerate(chunks):
                own = back[bounds[i] : bounds[i + 1]]
                if len(own):
                    out.append(_row(bucket, chunk, 0, _steps(token[own]), _planes(df[own].astype("<u4")), _planes(doc[own])))
            if out:
                yield _batch(out)

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _grouped(batches, 1):
            tokens, dfs, docs_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint16)]
            ids = n = prints = None
            for r in rows:
                if r[2]:
                    ids, n, prints = np.frombuffer(r[3], "<i8").reshape(-1, 2), np.frombuffer(r[4], "<i8"), np.frombuffer(r[5], "<i8").reshape(-1, 2)
                else:
                    tokens.append(_tokens(r[3]))
                    dfs.append(_whole(r[4], "<u4"))
                    docs_of.append(_whole(r[5], "<u2"))
            token, df, doc = np.concatenate(tokens), np.concatenate(dfs), np.concatenate(docs_of)
            order = np.lexsort((token, df, doc))
            token, doc = token[order], doc[order]
            first = np.searchsorted(doc, np.arange(len(n) + 1))
            shared = np.diff(first)
            prefix = n - (num * n + den - 1) // den + 1
            k = np.where(n > 0, np.maximum(0, prefix - (n - shared)), 0)
            k = np.minimum(k, shared)
            data = [token[a:b].astype("<u8").tobytes() if x else None for a, b, x in zip(first[:-1], first[1:], k, strict=True)]
            node = (np.int64(chunk) << 16) + np.arange(len(n))
            keys = pa.array([None if null else v for v, null in ids.tolist()], pa.int64())
            for lo in range(0, len(n), 2000):
                cut = slice(lo, lo + 2000)
                columns = [pa.array(node[cut]), keys[cut], pa.array(n[cut]), pa.array(prints[cut, 0]), pa.array(prints[cut, 1]), pa.array(k[cut].astype(np.int32)), pa.array(data[cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "key", "n", "f1", "f2", "k", "tokens"])

    packed = docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(shingled, _PACKED)
    counted = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, _PACKED)
    ordered = counted.repartition(parts, "chunk").sortWithinPartitions("chunk")
    return written(ordered.mapInArrow(prefixed, "node long, key long, n long, f1 long, f2 long, k int, tokens binary"), "shingles")


def _verified(members: list[tuple], share: tuple[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Edges that connect the linked members (node, n, k, tokens, label, side) of a block, and two members of each large label with their smallest tokens.

    Where members have two sides, only those of different sides meet. A group is the members of one size and prefix; lists hold
    groups by prefix token. Members outside the most frequent label meet all others, which leaves out no pair of two labels. A
    member whose lists hold nothing but its own component is passed over. Else the groups on its lists are filtered by size,
    and the overlaps with their members that are outside its component are counted.
    """
    num, den = share
    members = sorted(members, key=lambda m: (m[1], m[0]))
    sets = [np.frombuffer(m[3], "<u8") for m in members]
    label = np.unique([m[4] for m in members], return_inverse=True)[1]
    before = label.copy()
    main = int(np.bincount(label).argmax())
    side = np.array([m[5] for m in members], np.int64)
    cross = bool((side != side[0]).any())
    n = np.array([m[1] for m in members], np.int64)
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    heads: dict[tuple, int] = {}
    group = np.array([heads.setdefault((m[1], place[first[i] : first[i] + m[2]].tobytes()), len(heads)) for i, m in enumerate(members)])
    size = np.zeros(len(heads), np.int64)
    size[group] = n
    prefixes = [np.frombuffer(prefix, place.dtype).tolist() for _, prefix in heads]
    lists: dict[int, list[int]] = {}
    for g, prefix in enumerate(prefixes):
        for t in prefix:
            lists.setdefault(t, []).append(g)
    on_list = {t: np.flatnonzero(np.isin(group, gs)) if len(gs) * 4 < len(members) else np.flatnonzero(_flags(gs, len(heads))[group]) for t, gs in lists.items()}
    settled: dict[int, int] = {}  # lists within one component, which only grow together

    def open_list(t: int, x: int) -> bool:
        if t in settled:
            return label[settled[t]] != label[x]
        own = label[on_list[t]]
        if (own == own[0]).all():
            settled[t] = int(on_list[t][0])
        return bool((own != label[x]).any())

    mark = np.zeros(int(place.max()) + 1, np.int64)
    for x in range(len(members)):
        if before[x] == main:
            continue
        wide = [t for t in prefixes[group[x]] if open_list(t, x)]
        if not wide:
            continue
        near = np.zeros(len(heads), bool)
        for t in wide:
            near[lists[t]] = True
        near &= num * np.maximum(size, n[x]) <= den * np.minimum(size, n[x])
        met = near[group] & (label != label[x])
        others = np.flatnonzero(met & (side != side[x]) if cross else met)
        if not len(others):
            continue
        own = place[first[x] : first[x + 1]]
        mark[own] = 1
        if len(others) * 4 > len(members):
            both = np.add.reduceat(mark[place], first[:-1])[others]
        else:
            both = np.array([mark[place[first[y] : first[y + 1]]].sum() for y in others.tolist()])
        mark[own] = 0
        for r in np.unique(label[others[den * both >= num * (n[x] + n[others] - both)]]).tolist():
            label[label == r] = label[x]
    nodes = np.array([m[0] for m in members], np.int64)
    edges = []
    for r in np.unique(label[label != before]).tolist():  # stars around the smallest node, an edge a former label
        one = np.flatnonzero(label == r)
        one = one[np.unique(before[one], return_index=True)[1]]
        edges += [(u, int(nodes[one].min())) for u in nodes[one].tolist() if u != nodes[one].min()]
    large = []
    for r in np.flatnonzero(np.bincount(label) >= MANY).tolist():
        own = np.flatnonzero(label == r)
        large += [(int(nodes[i]), int(sets[i].view(np.int64).min())) for i in (own[nodes[own].argmin()], own[nodes[own].argmax()])]
    return edges, large


def _flags(at_: list[int], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at_] = True
    return out


def _verify(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v, kind from blocks, rows of (block, node, n, k, tokens, label, side, more): edges (0), and for blocks with more, members of large labels u and their smallest tokens v (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _grouped(batches, 0):
            members = list(members)
            edges, large = _verified([m[1:7] for m in members], share)
            found = [(u, v, 0) for u, v in edges] + [(u, v, 1) for u, v in large if members[0][7]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["u", "v", "kind"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("block", "node", "n", "k", "tokens", "label", "side", "more").repartition(parts, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "u long, v long, kind int")


def _wide(k: np.ndarray, data: pa.Array, *others: np.ndarray) -> list[np.ndarray]:
    """The first k tokens of each row, and the other columns, a row a token."""
    tokens = [np.frombuffer(x.as_py(), "<i8", n) for x, n in zip(data, k.tolist(), strict=True)]
    return [np.concatenate(tokens) if tokens else np.zeros(0, np.int64), *[np.repeat(x, k) for x in others]]


def _met(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token with its smallest node, and stars of the nodes that share tokens."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.append(True, token[1:] != token[:-1])[: len(token)]
    least = node[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(token) else node
    return token[first], node[first], *stars(node, least)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From node, k, tokens: prefix tokens with one node a chunk (token, node, true), and edges between nodes that share them (u, v, false)."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            token, node, u, v = _met(*_wide(part.column(1).to_numpy(), part.column(2), part.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(token, u)), pa.array(np.append(node, v)), pa.array(np.arange(len(token) + len(u)) < len(token))], ["a", "b", "is_token"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the nodes of rows (token, node) sorted by token."""
    for token, node in chunks(batches, whole=True):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(token, node)[2:]], ["u", "v"])


def _links(classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Edges that connect linked classes. classes: node, n, k, tokens; all of them have repeated prefix tokens."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = written(classes.select("node", "k", "tokens").mapInArrow(_listed, "a long, b long, is_token boolean"), "lists")
    tokens = lists.where("is_token").select("a", "b").repartition(parts, "a").sortWithinPartitions("a")
    near = tokens.mapInArrow(_meeting, "u long, v long").unionByName(lists.where("not is_token").select(F.col("a").alias("u"), F.col("b").alias("v")))
    near = forest(near, "candidates")
    sizes = written(near.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("members")), "sizes")
    placed = near.unionByName(sizes.select(F.col("component").alias("node"), "component"))
    large = sizes.where(F.col("members") > BLOCK)
    n = large.count()
    placed = placed.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "component", "left").withColumn("parts", F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("long"))
    rows = classes.join(placed, "node").withColumn("block", F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("parts"))))
    rows = rows.withColumns({"label": F.col("node"), "side": F.lit(0).cast("long"), "more": F.col("parts") > 1})
    edges = written(_verify(rows, share), "links")
    return _across(edges, written(rows.where("more").select("node", "n", "k", "tokens", "component"), "large"), share) if n else edges.select("u", "v")


def _across(found: DataFrame, large: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Edges of found and those between members of large, components beyond one block, that lie in different blocks.

    First some members of each block's large labels meet in lists by their smallest token, which similar sets share, over and
    over while lists are longer than a block. Then all members of different labels that share a prefix token meet.
    """
    edges, more = found.where("kind = 0").select("u", "v"), found.where("kind = 1")
    cut = True
    while cut:
        lists = more.select(F.col("v").alias("list"), F.col("u").alias("node")).distinct()
        sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        some = lists.join(sizes, "list").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("long"))
        some = some.select("node", (F.col("parts") > 1).alias("more"), F.xxhash64("list", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
        rows = some.join(large, "node").withColumns({"label": F.col("node"), "side": F.lit(0).cast("long")})
        found = written(_verify(rows, share), "links")
        edges, more = edges.unionByName(found.where("kind = 0").select("u", "v")), found.where("kind = 1")
        cut = more.limit(1).count() > 0
    now = large.join(forest(edges, "labels").select("node", F.col("component").alias("label")), "node", "left")
    lists = written(_open_lists(now.withColumn("label", F.coalesce("label", "node"))), "open")
    rows = _pairs(lists).join(large.select("node", "n", "k", "tokens"), "node").withColumn("more", F.lit(False))
    return edges.unionByName(written(_verify(rows, share).select("u", "v"), "links"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From k, tokens, label: prefix tokens with the smallest and largest label of some rows."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            token, label = _wide(part.column(0).to_numpy(), part.column(1), part.column(2).to_numpy())
            order = np.lexsort((label, token))
            token, label = token[order], label[order]
            new = np.append(True, token[1:] != token[:-1])[: len(token)]
            yield pa.RecordBatch.from_arrays([pa.array(token[new]), pa.array(label[new]), pa.array(label[np.append(new[1:], True)[: len(new)]])], ["token", "lo", "hi"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From node, k, tokens, label, component: a row a prefix token."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            columns = _wide(part.column(1).to_numpy(), part.column(2), *[part.column(i).to_numpy() for i in (0, 3, 4)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "label", "component"])


def _open_lists(now: DataFrame) -> DataFrame:
    """Lists (list, node, label) that bring together every two rows of now that share a prefix token and differ in label.

    A prefix token whose rows all have one label is in none. A component's lists go by token, or are one of all its rows on
    open tokens where that makes fewer rows to verify, which holds for few members of long prefixes.
    """
    spans = now.select("k", "tokens", "label").mapInArrow(_spans, "token long, lo long, hi long")
    wide = spans.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    wide = now.select("node", "k", "tokens", "label", "component").mapInArrow(_exploded, "token long, node long, label long, component long").join(wide, "token", "left_semi")
    wide = written(wide, "wide")
    each = wide.groupBy("component", "node", "label").agg(F.count(F.lit(1)).alias("lists"))
    cost = each.groupBy("component").agg(F.count(F.lit(1)).alias("all"), F.sum("lists").alias("rows"))
    cost = cost.select("component", (F.col("rows") <= F.col("all") * F.ceil(F.col("all") / BLOCK)).alias("apart"))
    by_token = wide.join(cost.where("apart"), "component").select(F.xxhash64(F.lit("token"), "token").alias("list"), "node", "label")
    return by_token.unionByName(each.join(cost.where("not apart"), "component").select(F.xxhash64("component").alias("list"), "node", "label"))


def _pairs(lists: DataFrame) -> DataFrame:
    """Blocks (block, node, label, side) in which every two members of a list (list, node, label) that differ in label meet.

    A list that fits in a block is one. Else its most frequent label and the rest are each cut into parts, and each part of the
    rest meets every part; parts of the most frequent label do not meet.
    """
    each = lists.groupBy("list", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = each.groupBy("list").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("every"), F.max("c").alias("most")).where("every > most")
    met = lists.join(sizes, "list")
    rest = F.ceil((F.col("every") - F.col("most")) / BLOCK).cast("long")
    every = rest + F.ceil(F.col("most") / BLOCK).cast("long")
    is_main, h = F.col("label") == F.col("main"), F.xxhash64("list", "node")
    met = met.withColumn("side", F.when(F.col("every") <= BLOCK, 0).when(is_main, rest + F.pmod(h, every - rest)).otherwise(F.pmod(h, rest)).cast("long"))
    last = F.when(F.col("every") <= BLOCK, 0).when(is_main, rest - 1).otherwise(every - 1).cast("long")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return met.select("node", "label", "side", F.xxhash64("list", F.least("side", "other"), F.greatest("side", "other")).alias("block"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (75, 100)) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable over links) for every row of docs.

    Two rows link when their sets' Jaccard similarity is at least share, exactly, as a ratio of integers.
    Defined cases: a text of fewer words than `words` is one shingle; null and empty texts have none and are their own
    components; a null key stays null and is no smallest key unless the component has no other; repeated rows and equal keys
    are rows like others; texts of any length are whole sets; an empty table gives an empty one; other columns are not read.
    """
    table = token_table(docs, key, text, words, share)
    same = ["f1", "f2", "n"]
    sets = table.where("n > 0").groupBy(*same).agg(F.min("node").alias("node"), F.min("key").alias("least"), F.min_by("k", "node").alias("k"), F.min_by("tokens", "node").alias("tokens"))
    sets = written(sets, "classes")
    label = forest(_links(sets.where("k > 0").select("node", "n", "k", "tokens"), share), "components")
    named = sets.select(*same, "node", "least").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(best, "component").select(*same, "component_id")
    rows = table.select("key", *same)
    done = rows.where("n > 0").join(named, same).select("key", "n", "component_id")
    done = done.unionByName(rows.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each component, that of the smallest key; rows with a null key stay.

    The keys that go are broadcast while they are few (8 bytes each), and else joined by shuffle. Rows that repeat a key that
    stays are reduced to one.
    """
    marks = written(join(docs, key, text).groupBy(F.col(key).alias("_k")).agg(F.min("component_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "kept")
    out = marks.where("_k <> _least").select("_k")
    twice = marks.where("_k = _least and _n > 1").select("_k")

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys

    rest = docs.join(side(out), docs[key] == out["_k"], "left_anti")
    if not twice.limit(1).count():
        return rest
    once = rest.join(side(twice), rest[key] == twice["_k"], "left_semi").dropDuplicates([key])
    return rest.join(side(twice), rest[key] == twice["_k"], "left_anti").unionByName(once)


def join_sql() -> str:
    """DuckDB SQL for join over the view documents."""
    return r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
