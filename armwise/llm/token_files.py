"""Token-id files: canonical length-limited Huffman coding from global counts, decoded by table in independent blocks.

A block is the big-endian bit stream of some whole documents; its header holds, a document, key and token count, and the bit
offset of every STRIDE-th token. All stretches between checkpoints of a batch of blocks are decoded in lockstep.
Blocks are rows of Parquet tables, so that Spark's committer writes them and any file system that Spark reads can hold them.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwise.llm.arrowtext import released
from armwise.llm.common import scratch, written
from armwise.llm.memo import Memo, slices, spread

#: Longest code in bits, and so the decoding table's size; tokens between checkpoints; tokens after which a block is full.
LIMIT, STRIDE, FULL = 20, 256, 1 << 14
MAGIC = b"HUF1"


class WordEncoder:
    """Ids of whole texts by the library, which gets each distinct word of a slice (what stands between ASCII blanks) once.

    Right for tokenizers whose pre-tokenizer drops white space, so that no piece spans it: words then encode apart as they do
    together. Words of Latin-1 letters alone are one piece each where the file's steps are NFC, white space and lower case, then
    a pattern that keeps runs of letters, then bytes as letters: they go to the library's model. The others go through the
    library's whole pipeline, many as one text, parted by a control sign of one id that none of them holds.
    Ids must fit in 16 bits.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [pre]
        if not (steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")):
            raise ValueError("this tokenizer's pieces may span white space")
        self.library = Tokenizer.from_file(path)
        self.signs = {c: ids[0] for c in map(chr, range(1, 9)) if len(ids := self._ids([f" {c} "])[0]) == 1}
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        runs = norm == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and "|[\\p{L}]+|" in steps[0]["pattern"].get("Regex", "")
        self.letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch if runs and not spec["model"].get("dropout") else lambda word: None
        self.bytes = str.maketrans(dict(enumerate(_byte_letters())))
        self.words = Memo(self._made)

    def _ids(self, texts: list[str], at_once: int = 4096) -> list[list[int]]:
        """The ids of texts, a few at once: an encoding holds far more than its ids."""
        return [e.ids for i in range(0, len(texts), at_once) for e in self.library.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        own = np.fromiter((w.isalpha() and self.letters(w) is not None for w in words), bool, len(words))
        alone, rest = np.flatnonzero(own), np.flatnonzero(~own)
        tokenize = self.library.model.tokenize
        low = "\n".join([words[i] for i in alone.tolist()]).lower().encode().decode("latin-1").translate(self.bytes | {10: 10}).split("\n") if len(alone) else []
        pieces = [[t.id for t in tokenize(w)] for w in low]
        n1 = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat1 = np.fromiter(chain.from_iterable(pieces), np.int32, int(n1.sum()))
        flat2, n2 = self._whole([words[i] for i in rest.tolist()])
        lengths = np.empty(len(words), np.int64)
        lengths[alone], lengths[rest] = n1, n2
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(len(flat1) + len(flat2), np.int32)
        flat[spread(starts[alone], n1)], flat[spread(starts[rest], n2)] = flat1, flat2
        if len(flat) and flat.max() > 65535:
            raise ValueError("ids above 65535")
        return flat, lengths

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _made, through the library's whole pipeline."""
        every = "".join(words)
        sign = next((c for c in self.signs if c not in every), None)
        if sign is None:
            ids = self._ids(words)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        else:
            ends = f" {sign} "
            ids = np.fromiter(chain.from_iterable(self._ids([ends.join(words[i : i + 2000]) + ends for i in range(0, len(words), 2000)], 4)), np.int32)
            at = np.flatnonzero(ids == self.signs[sign])
            flat, lengths = ids[ids != self.signs[sign]], np.diff(at, prepend=-1) - 1
        return flat, lengths

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, as 16-bit numbers, and where each text's ids end."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        ids, n = self.words(words.flatten())
        ends = np.append(0, np.cumsum(n))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        per = np.diff(ends)
        out = np.full(len(ids) + len(per), end_id, "<u2")
        stops = np.cumsum(per + 1)
        own = np.ones(len(out), bool)
        own[stops - 1] = False
        out[own] = ids
        return out, stops


def _byte_letters() -> list[str]:
    """Byte-level tokenizers write printable bytes as themselves and the others, in order, as letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the lengths of an optimal prefix code of at most limit bits; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    leaves: list[np.ndarray] = []
    coins = w
    flags = np.ones(len(w), bool)
    for _ in range(limit):
        leaves.append(np.cumsum(flags))
        even = len(coins) // 2 * 2
        packs = coins[0:even:2] + coins[1:even:2]
        both = np.concatenate([w, packs])
        at = np.argsort(both, kind="stable")
        coins, flags = both[at], at < len(w)
    m = 2 * len(w) - 2
    for level in reversed(leaves):
        taken = int(level[m - 1]) if m else 0
        lengths[order[:taken]] += 1
        m = 2 * (m - taken)
    return lengths


@dataclass(frozen=True)
class Codebook:
    lengths: np.ndarray
    codes: np.ndarray
    symbols: np.ndarray
    widths: np.ndarray


@lru_cache(maxsize=2)
def codebook(lengths: bytes, limit: int = LIMIT) -> Codebook:
    """Canonical codes, by length then id, and the table that gives the id and width of every window of limit bits."""
    n = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    spans = np.int64(1) << (limit - n[used].astype(np.int64))
    starts = np.cumsum(spans) - spans
    codes = np.zeros(len(n), np.uint64)
    codes[used] = (starts >> (limit - n[used].astype(np.int64))).astype(np.uint64)
    symbols, widths = np.zeros(1 << limit, np.uint16), np.ones(1 << limit, np.uint8)
    fill = int(spans.sum())
    symbols[:fill], widths[:fill] = np.repeat(used, spans), np.repeat(n[used], spans)
    return Codebook(n.astype(np.int64), codes, symbols, widths)


def pack(keys: list[int | None], counts: list[int], ids: np.ndarray, book: Codebook) -> bytes:
    """A block of whole documents."""
    n = book.lengths[ids]
    if len(n) and not n.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ids) else 0
    high = book.codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
    at = starts >> 5
    words = np.bincount(at, (high >> np.uint64(32)).astype(np.float64), bits // 32 + 3)
    words += np.bincount(at + 1, (high & np.uint64(0xFFFFFFFF)).astype(np.float64), bits // 32 + 3)
    marks = starts[::STRIDE].astype("<u8")
    nulls = np.array([k is None for k in keys], np.uint8)
    head = struct.pack("<4sIII", MAGIC, len(keys), len(ids), len(marks))
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes(), marks.tobytes(), words.astype(">u4").tobytes()])


def unpack(blocks: list[bytes], book: Codebook, limit: int = LIMIT) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Keys, token counts and ids of each block."""
    heads, words, cursors, base = [], [], [], 0
    for b in blocks:
        magic, docs, tokens, marks = struct.unpack_from("<4sIII", b)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = 16
        keys = np.frombuffer(b, "<i8", docs, at).tolist()
        nulls = np.frombuffer(b, np.uint8, docs, at + 8 * docs)
        counts = np.frombuffer(b, "<u4", docs, at + 9 * docs)
        offsets = np.frombuffer(b, "<u8", marks, at + 13 * docs).astype(np.int64)
        w = np.frombuffer(b, ">u4", offset=at + 13 * docs + 8 * marks).astype(np.uint64)
        heads.append(([None if x else k for k, x in zip(keys, nulls, strict=True)], counts, tokens, marks))
        cursors.append(offsets + 32 * base)
        words.append(w)
        base += len(w)
    stream = np.concatenate([*words, np.zeros(2, np.uint64)]) if words else np.zeros(2, np.uint64)
    pairs = (stream[:-1] << np.uint64(32)) | stream[1:]
    p = np.concatenate(cursors) if cursors else np.zeros(0, np.int64)
    out = np.empty((STRIDE, len(p)), np.uint16)
    mask = np.uint64((1 << limit) - 1)
    last = len(pairs) - 1
    for t in range(STRIDE):
        window = (pairs[np.minimum(p >> 5, last)] >> (64 - limit - (p & 31)).astype(np.uint64)) & mask
        out[t] = book.symbols[window]
        p = p + book.widths[window]
    rows = out.T
    at = 0
    for keys, counts, tokens, marks in heads:
        yield keys, counts, rows[at : at + marks].reshape(-1)[:tokens]
        at += marks


def encode(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the ids of the whole text with the end id, as little-endian 16-bit integers."""
    return _encoded(docs, tokenizer, end_id, key, text).where("n is null").drop("n")


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """key and ids of each text, and, where n is not null, how often the id key occurs in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer)
        total = np.zeros(1 << 16, np.int64)
        names = ["key", "ids", "n"]
        for b in released(batches):
            for part in slices(b, 1):
                ids, ends = e.encode(part.column(1), end_id)
                total += np.bincount(ids, minlength=1 << 16)
                offsets = np.append(0, 2 * ends).astype("<i4")
                binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), binary, pa.nulls(len(ends), pa.int64())], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(total[at])], names)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, ids binary, n long")


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Writes under path: blocks, in ascending order of key (nulls first), and codebook, the length of each id's code."""
    spark = docs.sparkSession
    rows = written(_encoded(docs, tokenizer, end_id, key, text), "ids")
    tokens = rows.where("n is null").drop("n")
    counts = np.zeros(1 << 16, np.int64)
    for r in rows.where("n is not null").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        counts[r.key] = r.n
    lengths = code_lengths(counts).tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = codebook(lengths)
        keys: list = []
        ids: list = []
        full, first, part = 0, 0, 0

        def row() -> pa.RecordBatch:
            data = pack(keys, [len(x) for x in ids], np.concatenate(ids), book)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([full], pa.int64()), pa.array([data], pa.binary())], ["part", "first", "tokens", "block"])

        for b in batches:
            for k, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                part = n
                keys.append(k)
                ids.append(np.frombuffer(x.as_py(), "<u2"))
                full += len(ids[-1])
                if full >= FULL:
                    yield row()
                    keys, ids, first, full = [], [], first + full, 0
        if keys:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("_salt")]
    laid = tokens.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = laid.select("key", "ids", F.spark_partition_id().alias("part"))
    laid.mapInArrow(blocks, "part int, first long, tokens long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths), LIMIT)], "lengths binary, bits int").coalesce(1).write.parquet(f"{path}/codebook")


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids, decoded from the files."""
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)
    stored = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition of the files
    offsets = stored.groupBy("part").agg(F.sum("tokens").alias("_n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_offset"))
    joined = stored.join(F.broadcast(offsets), stored.part == offsets._part).select((F.col("first") + F.col("_offset")).alias("start"), "block")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = codebook(lengths)
        for b in released(batches):
            for lo in range(0, b.num_rows, 32):
                part = b.slice(lo, 32)
                out: dict[str, list] = {"key": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for start, (keys, counts, ids) in zip(part.column(0).to_pylist(), unpack(part.column(1).to_pylist(), book), strict=True):
                    whole = ids.astype("<u4")
                    ends = np.cumsum(counts.astype(np.int64))
                    for k, n, e in zip(keys, counts.tolist(), ends.tolist(), strict=True):
                        own = whole[e - n : e]
                        out["key"].append(k)
                        out["start"].append(start + e - n)
                        out["n_tokens"].append(n)
                        out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            out["ids"].append(own.astype(np.int32))
                columns = [pa.array(out[c], pa.int64()) for c in ("key", "start", "n_tokens", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else [])], [c for c in out if c != "ids" or with_ids])

    return joined.mapInArrow(decode, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as token files (in the shared folder where no path is given) and reads them back.

    Defined cases: a null or empty text has the end id alone; null keys come first; equal keys and repeated rows each have an
    entry; a text of any length is one document of one block; an empty table gives an empty one; other columns are not read.
    """
    path = path or scratch(docs.sparkSession, "tokens")
    write_files(docs, tokenizer, path, end_id, key, text)
    return read_files(docs.sparkSession, path).withColumnRenamed("key", key)
