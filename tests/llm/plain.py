"""Plain versions of what the operators compute, and small awkward tables."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"

#: Columns whose names the operators use inside.
CLASHING = {"key": "k", "node": "n", "tokens": "t", "component": "c", "row": "r", "_key": "u", "_salt": "s", "rank": "x", "size": "z", "part": "p", "label": "l", "shard": "h"}


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    ws = WORD.findall(lower(text))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def components(ids: Iterable[int], links: Iterable[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def joined(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in texts.items()}
    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    links = set()
    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                links.add((j, i))
    least = components(sets, links)
    return {i: (len(sets[i]), least[i]) for i in sets}


def crc(key: int | None) -> int:
    return zlib.crc32(str(key).encode() if key is not None else b"")


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    _, place, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    ones = label[order] == 1
    return float((rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum()))


def targets(sizes: dict[str | None, int], share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> dict[str | None, float]:
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    free, out = set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in free}
            break
        out |= {s: Fraction(most * sizes[s]) for s in full}
        free -= full
    return {s: float(x) for s, x in out.items()}


def awkward(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs into the deep green forest of old trees"
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), None, "a"), (3, None, "en", None), (4, "", None, None), (5, " \t\r\n\x0b\x0c ", "en", "b"),
        (6, "one", "en", "b"), (7, "one", "en", "b"), (8, "one two three four", "en", "b"), (None, base, "en", "c"), (9, long, "en", "c"), (10, long, "de", "c"),
        (11, "naïve café ▁ mark \U0001f600 ﬁ é \x00   end", "fr", "c"), (None, None, None, None),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None, *CLASHING.values()) for r in rows], columns)


def empty(df):
    return df.where("false")
