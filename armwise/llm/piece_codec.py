"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed by its protobuf wire format; normaliser, metaspace marker, scores and byte fallback are rebuilt as a
tokenizers pipeline. Both model types are served: unigram scores go to a Unigram model; for a BPE model the scores order the
merges, which is what they mean there. Texts are encoded by their segments, the stretches between places that no piece can
span; a worker keeps the ids of segments it has seen, and each new one is held against the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm.arrowtext import released
from armwise.llm.memo import slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments whose ids a worker remembers; bytes of text that are cut into segments at once, unless one text is longer.
REMEMBERED, SLICE = 400_000, 1 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True
    charsmap: bytes = b""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire)
        n = varint() if n is None else n
        yield tag >> 3, data[at : at + n]
        at += n


def parse(data: bytes) -> Model:
    """The parts of a ModelProto that encoding needs: pieces (1), trainer (2) and normaliser (3) specifications."""
    m = Model()
    for n, v in _fields(data):
        if n == 1:
            f = dict(_fields(v))
            m.pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0, f.get(3, NORMAL)))
        elif n == 2:
            f = dict(_fields(v))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif n == 3:
            f = dict(_fields(v))
            m.charsmap, m.dummy_prefix, m.one_space, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def build(m: Model, normalise: bool = True):
    """The tokenizers pipeline of a model; without normalise, for segments that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unknown = next((i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN), 0)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback)
    else:
        merges = []
        for p, score, kind in m.pieces:
            if kind in (NORMAL, USER):
                merges += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        model = models.BPE(ids, [x[3:] for x in sorted(merges)], unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    if normalise:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.one_space:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if m.escape else " "))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return t


class Codec:
    """Encodes and decodes whole texts for one model file."""

    def __init__(self, path: str, threads: int = 2) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true" if threads > 1 else "false", str(threads)
        with open(path, "rb") as f:
            self.model = m = parse(f.read())
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [p for p, _, k in m.pieces if k in (NORMAL, USER)]
        self.cuts_at_mark = m.escape and m.dummy_prefix and not m.charsmap and not m.one_space and not any(MARK in p.lstrip(MARK) for p in texts)
        self.cuts_at_line = m.byte_fallback and not any("\n" in p for p in texts)
        self.library = build(m, normalise=not self.cuts_at_mark)
        line = "\n" if self.cuts_at_line else ""
        self.segments = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else "")).findall
        self.place = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        self.scores = {p: s for p, s, k in m.pieces if k in (NORMAL, USER)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(m.pieces) if k == BYTE}
        self.unknown = next((i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN), 0)
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"" for p, _, k in m.pieces]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.size = 0
        self.unlike: set[int] = set()

    def _other(self, new: list[str]) -> list[list[int]]:
        """What sentencepiece makes of segments: the dummy prefix is theirs if they start with a marker and go on, else they follow a line end."""
        own = [s[0] == MARK and len(s) > 1 for s in new]
        texts = [s[1:].replace(MARK, " ") if x else "\n" + s.replace(MARK, " ") for s, x in zip(new, own, strict=True)]
        skip = len(self.other.encode("\n"))
        return [ids if x else ids[skip:] for x, ids in zip(own, self.other.encode(texts, num_threads=1), strict=True)]

    def _leftmost(self, segment: str) -> tuple[list[int], bool]:
        """The ids of a segment by merges of the best score, of equal ones the leftmost, and whether such a tie came up between different merges."""
        parts, tied = list(segment), False
        while True:
            scores = [(self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = max(scores, default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            i = -best[1]
            tied |= any(s == best[0] and parts[-j] + parts[1 - j] == parts[i] + parts[i + 1] and parts[-j] != parts[i] for s, j in scores) or sum(s == best[0] for s, _ in scores) > 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids: list[int] = []
        for p in parts:
            ids += [self.place[p]] if p in self.place else [self.byte_ids[x] for x in p.encode()] if self.model.byte_fallback else [self.unknown]
        return ids, tied

    def _learn(self, new: list[str]) -> None:
        got: list[list[int]] = []
        for lo in range(0, len(new), 16384):  # an encoding holds far more than its ids
            got += [e.ids for e in self.library.encode_batch_fast(new[lo : lo + 16384], add_special_tokens=False)]
        n = len(self.known)
        for i, (a, b) in enumerate(zip(got, self._other(new), strict=True)):
            if a == b:
                continue
            got[i], tied = self._leftmost(new[i])
            if not tied:
                raise ValueError(f"the rebuilt model gives {a} for {new[i]!r}, sentencepiece {b}")
            if got[i] != b:
                self.unlike.add(n + i)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for ids in got for x in ids), np.int32, int(lengths.sum()))
        while n + len(new) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.first[n + 1 : n + 1 + len(new)] = self.size + np.cumsum(lengths)
        self.size += len(flat)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """The ids of each text, and whether sentencepiece gives the same."""
        if not self.cuts_at_mark:
            got, want = self.library.encode_batch_fast(texts, add_special_tokens=False), self.other.encode(texts, num_threads=1)
            return [(np.array(a.ids, np.int32), a.ids == b) for a, b in zip(got, want, strict=True)]
        parts = [self.segments(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(s for p in parts for s in p if s not in known))
        if len(known) + len(new) > REMEMBERED:
            self.forget()
            known = self.known
            new = list(dict.fromkeys(s for p in parts for s in p))
        if new:
            self._learn(new)
        out = []
        for p in parts:
            at = np.fromiter(map(known.__getitem__, p), np.int64, len(p))
            a, n = self.first[at], self.first[at + 1] - self.first[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(p) else 0
            same = not self.unlike or self.unlike.isdisjoint(at.tolist())
            out.append((self.ids[np.arange(total) + np.repeat(a - ends + n, n)], same))
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=1)
def codec(path: str, threads: int = 2) -> Codec:
    return Codec(path, threads)


def encode(docs: DataFrame, model: str, threads: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), parity with sentencepiece, round_trip.

    The library orders merges by pieces; where merges of one score tie (long runs of one sign), ids come from the same scores
    merged leftmost first. A segment that differs from sentencepiece's without such a tie raises; parity tells of the rest.
    round_trip: the ids decode to the text (a text's own U+2581 decodes to a space).
    Defined cases: null and empty texts have no ids and pass both checks; texts of any length are one row; repeated rows
    repeat; an empty table gives an empty one; other columns are not read. threads: of the library, for each task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for b in released(batches):
            for part in slices(b, 1, SLICE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = c.encode(texts)
                ids = [x for x, _ in got]
                offsets = np.append(0, np.cumsum([len(x) for x in ids]))
                back = [c.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                        pa.array([s for _, s in got]),
                        pa.array(back),
                    ],
                    [key, "ids", "n_tokens", "ids_crc32", "parity", "round_trip"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text of an array of ids; a null array gives a null text, ids out of range raise."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")
