"""Toxicity by a noisy channel: obfuscated words are restored by Viterbi decoding of character lattices under a character
language model of the corpus, and the restored text is scored by words and word stems learned from labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import arrowtext as at
from armwise.llm.calibration import calibrate
from armwise.llm.common import remainder, written
from armwise.llm.memo import slices

#: Characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*'~/"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A longer run of '*' is a rule or a mark, and parts letters; in a shorter one each may stand for any letter. Each run is judged by itself.
STARS = 3
#: Bytes of text whose words are looked at together, unless one text is longer.
SLICE = 2 << 20
#: Log-probabilities of the channel: a letter written as another sign, a separator put in, a letter repeated, a space put between single letters or meant.
STANDS, PARTS, REPEATS, JOINED, MEANT = np.log([0.3, 0.5, 0.2, 0.9, 0.1]).tolist()
#: Labelled documents that a fit takes at most, and contexts that weigh as much as the prior.
LABELLED, PRIOR = 200_000, 10.0
STEMS = (4, 5, 6)

# The language model's alphabet: 0 a word's bound, 1-26 letters, 27-58 bytes above ASCII by their low bits, 59 the rest.
N = 60
_CODE = np.full(256, 59, np.uint8)
_CODE[[9, 10, 11, 12, 13, 32]] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27 + (np.arange(128, 256) & 31)
_ALPHA = (_CODE > 0) & (_CODE < 59)
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True


def trigrams(column: pa.Array) -> np.ndarray:
    """Counts of three codes in a row over whole texts, each with two bounds before it and one after."""
    total = np.zeros(N**3, np.int64)
    for s in at.slices(column):
        c = np.zeros(len(s.data) + 3 * len(s.starts), np.int64)
        shift = np.repeat(3 * np.arange(len(s.starts)) + 2, s.ends - s.starts)
        inside = np.zeros(len(s.data) + 1, np.int64)
        np.add.at(inside, s.starts, 1)
        np.add.at(inside, s.ends, -1)
        own = np.flatnonzero(np.cumsum(inside)[:-1])
        c[own + shift] = _CODE[s.data[own]]
        block = 3 * np.arange(len(s.starts))  # of c, a row: none of its windows reaches into the next row
        opened = np.zeros(len(c) + 1, np.int64)
        np.add.at(opened, s.starts + block, 1)
        np.add.at(opened, s.ends + block + 1, -1)
        first = np.flatnonzero(np.cumsum(opened))
        total += np.bincount(c[first] * (N * N) + c[first + 1] * N + c[first + 2], minlength=N**3)
    return total


def language_model(counts: np.ndarray, k: float = 5.0) -> np.ndarray:
    """log P(c | a, b), each order smoothed towards the next shorter one."""
    n3 = counts.reshape(N, N, N).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + N)
    p2 = (n2 + k * p1) / (n2.sum(1, keepdims=True) + k)
    return np.log((n3 + k * p2) / (n3.sum(2, keepdims=True) + k))


def _ended(state: tuple[int, int], stars: int, lm: np.ndarray) -> tuple[float, list[str]]:
    """What some last stars add to the score of a state, and the letters that they stand for: a star parts letters or is one of them, over a table of all states, and then the word ends."""
    table = np.full((N, N), -np.inf)
    table[state] = 0.0
    steps = []
    for _ in range(stars):
        rows = np.flatnonzero((table > -np.inf).any(1))
        reached = table[rows][:, :, None] + lm[rows][:, :, 1:27] + STANDS
        best, which = reached.max(0), rows[reached.argmax(0)]
        table = table + PARTS
        letter = best > table[:, 1:27]
        table[:, 1:27] = np.where(letter, best, table[:, 1:27])
        steps.append((letter, which))
    table += lm[:, :, 0]
    a, b = (int(i) for i in np.unravel_index(table.argmax(), table.shape))
    gain, said = float(table[a, b]), []
    for letter, which in reversed(steps):
        if 1 <= b <= 26 and letter[a, b - 1]:
            said.append(LETTERS[b - 1])
            a, b = int(which[a, b - 1]), a
    return gain, said[::-1]


def _options(ch: str) -> list[tuple[str, float]]:
    """What a sign of a token can be written for, with the channel's cost; blanks part single letters."""
    if ch == " ":
        return [("", JOINED), (" ", MEANT)]
    steps = [(ch, 0.0)] if ch.isalpha() else [("", PARTS)] if ch in SEPARATORS else []
    return steps + [(x, STANDS) for x in LEET.get(ch, "")] or [(ch, 0.0)]


@dataclass(frozen=True)
class Lattice:
    """Signs of some tokens as steps: each has the options from `first` on, so many, and one more where a letter can be a repeat."""

    first: np.ndarray
    number: np.ndarray
    repeats: np.ndarray
    said: list[str]
    codes: np.ndarray
    size: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, chars: np.ndarray, same: np.ndarray, star: np.ndarray) -> Lattice:
        """same: equal to the sign before it in its token; star: of a run of stars that stand for letters."""
        signs, kind = np.unique(np.append(chars, ord("*")), return_inverse=True)
        kind = np.where(star, len(signs), kind[:-1])
        each = [_options(chr(c)) for c in signs.tolist()] + [[("", PARTS), *((x, STANDS) for x in LETTERS)], [("", REPEATS)]]
        flat = [x for options in each for x in options]
        sizes = np.array([len(x) for x in each])
        at_ = np.cumsum(sizes) - sizes
        data = [x.encode("utf-8", "replace") for x, _ in flat]
        codes = np.zeros((len(flat), 4), np.int64)
        for i, x in enumerate(data):
            codes[i, : len(x)] = _CODE[np.frombuffer(x, np.uint8)]
        repeats = same & ~star & (chars != ord(" "))
        return cls(at_[kind], sizes[kind], repeats, [x for x, _ in flat], codes, np.array([len(x) for x in data]), np.array([c for _, c in flat]))


def restore_many(tokens: list[str], lm: np.ndarray, ends: dict | None = None) -> list[str]:
    """The likeliest writing of each token, by one Viterbi decoding of all their lattices, sign by sign.

    States are a token's last two codes. Of equal ones the first reached is kept, in the order of the states before and of
    the options; so a token is decoded alike whatever comes with it. ends remembers, by state, what last stars stand for.
    """
    ends = {} if ends is None else ends
    length = np.array([len(t) for t in tokens], np.int64)
    chars = np.frombuffer("".join(tokens).encode("utf-32-le", "replace"), np.uint32)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(tokens)), length)
    fresh = np.ones(len(chars), bool)
    fresh[1:] = (chars[1:] != chars[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(fresh) - 1
    star = (chars == ord("*")) & (np.bincount(run)[run] <= STARS if len(run) else fresh)
    last = np.zeros(len(tokens), np.int64)  # last stars, which `ends` says the meaning of
    tail = np.flatnonzero(length)
    end = start[tail] + length[tail] - 1
    last[tail] = np.where(star[end], np.bincount(run)[run[end]], 0) if len(tail) else 0
    length = length - last
    lat = Lattice.of(chars, ~fresh, star)
    again = len(lat.said) - 1
    token, a, b = np.arange(len(tokens)), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    score, node = np.zeros(len(tokens)), np.full(len(tokens), -1)
    parents: list[np.ndarray] = []
    chosen: list[np.ndarray] = []
    done: list[tuple[np.ndarray, ...]] = []
    made, alone = 0, True  # alone: every token has one state
    for t in range(int(length.max(initial=0)) + 1):
        over = length[token] <= t
        if over.any():
            done.append((token[over], a[over], b[over], score[over], node[over]))
            token, a, b, score, node = (x[~over] for x in (token, a, b, score, node))
        if not len(token):
            break
        sign = start[token] + t
        n = lat.number[sign] + lat.repeats[sign]
        if alone and int(n.max()) == 1:  # nothing to choose
            option = lat.first[sign]
            score = score + lat.cost[option]
            size = lat.size[option]
            a, b = a.copy(), b.copy()
            for j in range(int(size.max())):
                more = np.flatnonzero(size > j)
                code = lat.codes[option[more], j]
                score[more] += lm[a[more], b[more], code]
                a[more], b[more] = b[more], code
            parents.append(node)
            chosen.append(option)
            node = np.arange(made, made + len(node))
            made += len(node)
            continue
        at_ = np.repeat(np.arange(len(token)), n)
        k = np.arange(len(at_)) - np.repeat(np.cumsum(n) - n, n)
        option = np.where(k < lat.number[sign][at_], lat.first[sign][at_] + k, again)
        x, y, s = a[at_], b[at_], score[at_] + lat.cost[option]
        size = lat.size[option]
        for j in range(int(size.max())):
            more = np.flatnonzero(size > j)
            code = lat.codes[option[more], j]
            s[more] += lm[x[more], y[more], code]
            x[more], y[more] = y[more], code
        key = (token[at_] * N + x) * N + y
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        ranked = key[order]
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        if len(begin) == len(order):
            keep = np.arange(len(order))
        else:
            in_order = s[order]
            best = np.maximum.reduceat(in_order, begin)[np.cumsum(new) - 1]
            keep = np.minimum.reduceat(np.where(in_order == best, order, len(order)), begin)[np.argsort(order[begin], kind="stable")]
        parents.append(node[at_[keep]])
        chosen.append(option[keep])
        token, a, b, score = token[at_[keep]], x[keep], y[keep], s[keep]
        node = np.arange(made, made + len(keep))
        made += len(keep)
        alone = not (token[1:] == token[:-1]).any()
    token, a, b, score, node = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (token, a, b, score, node)
    order = np.argsort(token, kind="stable")
    token, a, b, score, node = token[order], a[order], b[order], score[order], node[order]
    total = score + lm[a, b, 0]
    for i in np.flatnonzero(last[token]).tolist():
        state = (int(a[i]), int(b[i]), int(last[token[i]]))
        if state not in ends:
            ends[state] = _ended(state[:2], state[2], lm)
        total[i] = score[i] + ends[state][0]
    begin = np.flatnonzero(np.diff(token, prepend=-1))
    best = np.repeat(np.maximum.reduceat(total, begin), np.diff(np.append(begin, len(token)))) if len(token) else total
    place = np.minimum.reduceat(np.where(total == best, np.arange(len(token)), len(token)), begin) if len(token) else begin
    parent, option = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (parents, chosen))
    out: list[str] = []
    up, said = parent.tolist(), option.tolist()
    for i in place.tolist():
        parts, k = [], int(node[i])
        while k >= 0:
            parts.append(lat.said[said[k]])
            k = up[k]
        tail_ = ends[int(a[i]), int(b[i]), int(last[token[i]])][1] if last[token[i]] else []
        out.append("".join(reversed(parts)) + "".join(tail_))
    return out


def restore(token: str, lm: np.ndarray, ends: dict | None = None) -> str:
    return restore_many([token], lm, ends)[0]


class Restorer:
    """Restores tokens, and remembers them."""

    def __init__(self, lm: np.ndarray) -> None:
        self.lm = lm
        self.known: dict[str, str] = {}
        self.ends: dict = {}

    def __call__(self, tokens: list[str]) -> list[str]:
        if len(self.known) > 200_000:
            self.known.clear()
        new = list(dict.fromkeys(t for t in tokens if t not in self.known))
        self.known.update(zip(new, restore_many(new, self.lm, self.ends), strict=True))
        return [self.known[t] for t in tokens]


def suspects(data: np.ndarray, w: at.Words, lm: np.ndarray) -> np.ndarray:
    """Of each word with a letter, whether it may be obfuscated: a sign for a letter anywhere, a star, a separator inside, a letter three times, or a doubled letter.

    Whether one of two equal letters is dropped depends on their neighbours alone; a word whose only doubled letters are of the
    kind that decoding keeps means what it says, and is no suspect.
    """
    n = len(data)
    pad = np.zeros(n + 4, np.uint8)
    pad[:n] = at._LOWER[data]
    alpha, leet, sep = _ALPHA[pad], _LEET[pad], _SEP[pad]
    blank = at._IS_BLANK[pad]
    blank[n:] = True
    odd = leet[:n] | (pad[:n] == ord("*"))
    odd |= (pad[:n] == 0xE2) & (pad[1 : n + 1] == 0x82) & (pad[2 : n + 2] == 0xAC)  # the euro sign
    odd |= sep[:n] & np.append(False, ~blank[: n - 1])[:n] & ~blank[1 : n + 1]
    twice = np.flatnonzero(alpha[:n] & (pad[:n] == pad[1 : n + 1]) & (pad[:n] < 128))
    opens, closes = np.zeros(n + 4, bool), np.zeros(n + 4, bool)
    opens[w.starts], closes[w.ends - 1] = True, True
    twice = twice[~closes[twice]]
    letter = _CODE[pad[twice]]
    before, after = np.where(opens[twice], 0, _CODE[pad[twice - 1]]), np.where(closes[twice + 1], 0, _CODE[pad[twice + 2]])
    dropped = lm[before, letter, after] + REPEATS >= lm[before, letter, letter] + lm[letter, letter, after]
    odd[twice[dropped | (~closes[twice + 1] & (pad[twice] == pad[twice + 2]))]] = True
    odd |= (pad[:n] >= 0xC0) & (pad[:n] == pad[2 : n + 2]) & (pad[1 : n + 1] == pad[3 : n + 3])
    some = at.counts_between(odd, w.starts, w.ends) > 0
    return some & (at.counts_between(alpha[:n], w.starts, w.ends) > 0)


def runs(data: np.ndarray, w: at.Words, rows: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Runs (from, to) of three words or more of one row, each of at most so many characters, with a letter or a sign for one."""
    chars = at.counts_between((data & 0xC0) != 0x80, w.starts, w.ends)
    fit = (chars <= longest) & (at.counts_between(_ALPHA[data] | _LEET[data], w.starts, w.ends) > 0)
    new = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
    before = np.append(False, fit[:-1])[: len(fit)]
    opens = np.flatnonzero(fit & (new | ~before))
    after, last = np.append(fit[1:], False)[: len(fit)], np.append(new[1:], True)[: len(fit)]
    closes = np.flatnonzero(fit & (last | ~after)) + 1
    return [(int(a), int(b)) for a, b in zip(opens, closes, strict=True) if b - a >= 3]


@dataclass
class Evidence:
    """For each word of a slice's restored text: its row, its features (whole word and stems, 0 where none) and its left neighbour."""

    rows: np.ndarray
    features: np.ndarray
    left: np.ndarray


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words without the signs around them, and of their first bytes; 0 for words without letters or too short."""
    n = len(data)
    place = np.arange(n, dtype=np.int64)
    alpha = _ALPHA[data]
    before = np.maximum.accumulate(np.where(alpha, place, -1)) if n else place
    after = np.minimum.accumulate(np.where(alpha, place, n)[::-1])[::-1] if n else place
    a = after[starts]
    e = before[ends - 1] + 1
    has = (a < ends) & (e > a)
    a, e = np.where(has, a, starts), np.where(has, e, ends)
    out = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    out[:, 0] = np.where(has, at.hash_spans(data, a, e), 0)
    for k, stem in enumerate(STEMS):
        long = has & (e - a > stem)
        out[long, k + 1] = at.mix(at.hash_spans(data, a[long], a[long] + stem) + at.U(k + 1))
    return out


def extras(column: pa.Array, restorer: Restorer) -> list[str]:
    """Of each text, what its suspect words and runs of short words are restored to, where that is not what they say."""
    out: list[list[str]] = [[] for _ in range(len(column))]
    for s in at.slices(column):
        w = at.find_words(s)
        rows = np.repeat(np.arange(s.lo, s.hi), np.diff(w.first))
        odd = np.flatnonzero(suspects(s.data, w, restorer.lm))
        _, first, place = np.unique(at.hash_spans(s.data, w.starts[odd], w.ends[odd]), return_index=True, return_inverse=True)
        said = [s.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "replace").lower() for i in odd[first].tolist()]
        meant = restorer(said)
        other = np.fromiter((a != b for a, b in zip(said, meant, strict=True)), bool, len(said))[place]
        for r, k in zip(rows[odd][other].tolist(), place[other].tolist(), strict=True):
            out[r].append(meant[k])
        short = list(dict.fromkeys(runs(s.data, w, rows, 1) + runs(s.data, w, rows, 2)))
        texts = [b" ".join(s.data[w.starts[i] : w.ends[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace").lower() for a, b in short]
        for (a, _), text, meaning in zip(short, texts, restorer(texts), strict=True):
            if text != meaning:
                out[int(rows[a])].append(meaning)
    return [" ".join(x) for x in out]


def evidence(column: pa.Array, extra: pa.Array) -> Evidence:
    """The words of some texts, and, without neighbours, of what was restored of them."""
    rows, features, left = [np.zeros(0, np.int64)], [np.zeros((0, 1 + len(STEMS)), np.uint64)], [np.zeros(0, np.uint64)]
    for texts, whole in ((column, True), (extra, False)):
        for s in at.slices(texts):
            w = at.find_words(s)
            f = _word_features(s.data, w.starts, w.ends)
            before = np.append(np.zeros(1, np.uint64), f[:-1, 0])[: len(f)] if whole else np.zeros(len(f), np.uint64)
            before[w.first[:-1][w.first[:-1] < len(f)]] = 0
            rows.append(np.repeat(np.arange(s.lo, s.hi), np.diff(w.first)))
            features.append(f)
            left.append(before)
    return Evidence(np.concatenate(rows), np.concatenate(features), np.concatenate(left))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _tally(table: DataFrame, toxic: bool, only: np.ndarray | None) -> DataFrame:
    """In how many documents of a class each feature occurs; the class's rows alone, and of the features only those given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in at.released(batches):
            for part in slices(b, 0, SLICE):
                weight = part.column(2).to_numpy(zero_copy_only=False)
                e = evidence(part.column(0), part.column(1))
                f = e.features.ravel()
                rows = np.repeat(e.rows, e.features.shape[1])
                keep = f != 0
                if only is not None:
                    keep &= _among(f, only)
                f, rows = f[keep], rows[keep]
                order = np.argsort(at.mix(f + rows.astype(np.uint64) * at.U(at._STEP)))
                f, rows = f[order], rows[order]
                first = np.append(True, (f[1:] != f[:-1]) | (rows[1:] != rows[:-1]))[: len(f)]
                keys, place = np.unique(f[first], return_inverse=True)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(np.bincount(place, weight[rows[first]], len(keys)).astype(np.int64))], ["f", "n"])

    weight = F.col("n1" if toxic else "n0")
    return table.where(weight > 0).select("text", "extra", weight.cast("long")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are among some ordered numbers; most that are not are told by their low bits."""
    out = np.zeros(len(x), bool)
    if not len(ordered):
        return out
    low = at.U((1 << 20) - 1)
    flags = np.zeros(1 << 20, bool)
    flags[(ordered & low).astype(np.int64)] = True
    maybe = np.flatnonzero(flags[(x & low).astype(np.int64)])
    some = x[maybe]
    out[maybe] = ordered[np.minimum(np.searchsorted(ordered, some), len(ordered) - 1)] == some
    return out


def _contexts(table: DataFrame, only: np.ndarray) -> DataFrame:
    """Of each given feature, the distinct left neighbours in toxic and in other documents: copies of a text add none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in at.released(batches):
            for part in slices(b, 0, SLICE):
                n1, n0 = part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                e = evidence(part.column(0), part.column(1))
                f = e.features.ravel()
                keep = _among(f, only)
                rows = np.repeat(e.rows, e.features.shape[1])[keep]
                left = np.repeat(e.left, e.features.shape[1])[keep]
                yield pa.RecordBatch.from_arrays([_signed(f[keep]), _signed(left), pa.array(n1[rows] > 0), pa.array(n0[rows] > 0)], ["f", "context", "t", "o"])

    seen = table.select("text", "extra", "n1", "n0").mapInArrow(run, "f long, context long, t boolean, o boolean")
    seen = seen.groupBy("f", "context").agg(F.max("t").alias("t"), F.max("o").alias("o"))
    return seen.groupBy("f").agg(F.sum(F.col("t").cast("long")).alias("c1"), F.sum(F.col("o").cast("long")).alias("c0"))


@dataclass(frozen=True)
class Model:
    lm: np.ndarray
    features: np.ndarray
    shares: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def share(self, column: pa.Array, extra: pa.Array) -> np.ndarray:
        """The largest share of toxic contexts among each text's features; a tenth of the base rate where it has none."""
        found = np.full(len(column), self.base / 10)
        e = evidence(column, extra)
        f = e.features.ravel()
        hit = _among(f, self.features)
        np.maximum.at(found, np.repeat(e.rows, e.features.shape[1])[hit], self.shares[np.searchsorted(self.features, f[hit])])
        return found

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def corpus_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The character language model of all documents: at most 216,000 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for b in at.released(batches):
            total += trigrams(b.column(0))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    counts = np.zeros(N**3, np.int64)
    for r in docs.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    return language_model(counts)


def fit(docs: DataFrame, votes: DataFrame, lm: np.ndarray, key: str, text: str) -> Model:
    """votes: key, n1, n0. Features that occur in three toxic documents or more, that lean to them, weighed by their contexts.

    All of them count; what comes to the driver is bounded by the LABELLED documents that they stand in.
    """
    total = votes.count()
    sample = votes if total <= LABELLED else votes.orderBy(F.xxhash64(key), key).limit(LABELLED)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(lm)
        for b in at.released(batches):
            for part in slices(b, 0, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(extras(part.column(0), r), pa.string()), part.column(1), part.column(2)], ["text", "extra", "n1", "n0"])

    table = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select("text", F.col("n1").cast("long"), F.col("n0").cast("long"))
    table = written(table.mapInArrow(restored, "text string, extra string, n1 long, n0 long"), "labelled")
    n1, n0 = (x or 0 for x in table.agg(F.sum((F.col("n1") > 0).cast("long")), F.sum((F.col("n0") > 0).cast("long"))).first())
    base = n1 / max(1, n1 + n0)
    none = Model(lm, np.zeros(0, np.uint64), np.zeros(0), base if n1 + n0 else 0.5)
    if not n1:
        return none
    toxic = written(_tally(table, True, None).where("n >= 3"), "toxic")
    first = np.sort(toxic.select("f").toPandas().f.to_numpy(np.int64).view(np.uint64))
    others = _tally(table, False, first).withColumnRenamed("n", "n0")
    share = (F.col("n") + PRIOR * base) / (F.col("n") + F.coalesce("n0", F.lit(0)) + PRIOR)
    lean = toxic.join(others, "f", "left").where(share > max(2 * base, 0.25)).select("f").toPandas()
    if not len(lean):
        return none
    c = _contexts(table, np.sort(lean.f.to_numpy(np.int64).view(np.uint64))).toPandas()
    f = c.f.to_numpy(np.int64).view(np.uint64)
    share = ((c.c1 + PRIOR * base) / (c.c1 + c.c0 + PRIOR)).to_numpy(float)
    order = np.argsort(f)
    model = Model(lm, f[order], share[order], base)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in at.released(batches):
            for part in slices(b, 0, SLICE):
                x = np.round(_logit(model.share(part.column(0), part.column(1))), 2)
                yield pa.RecordBatch.from_arrays([pa.array(x), part.column(2), part.column(3)], ["x", "n1", "n0"])

    held = table.select("text", "extra", "n1", "n0").mapInArrow(shares, "x double, n1 long, n0 long")
    held = held.groupBy("x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()  # logits to two places: at most 1,900 rows
    return replace(model, **dict(zip(("slope", "shift"), calibrate(*held.to_numpy(float).T), strict=True)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", by: int = 5, out: int = 0, least: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted for every row of docs.

    A score is the largest share of toxic contexts among a text's features, calibrated on the labelled documents by a
    logistic curve. A fit takes at most LABELLED labelled documents, those of the lowest hash; scores cover all.
    Defined cases: null and empty texts have no features; a null key is never labelled; equal keys share their labels and
    repeated rows repeat; conflicting labels count for both; without labels every score is 0.05; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    lm = corpus_model(docs, text)
    votes = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(key, by) != out))
    votes = votes.groupBy(key).agg(F.sum(F.col(label)).alias("n1"), F.sum(1 - F.col(label)).alias("n0"))
    model = fit(docs, votes, lm, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model.lm)
        for b in at.released(batches):
            for part in slices(b, 2, SLICE):
                texts = part.column(2)
                score = model.score(model.share(texts, pa.array(extras(texts, r), pa.string())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= least).astype(np.int32))], [key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), (remainder(key, by) == out).alias("held_out"), F.col(text))
    return rows.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")
