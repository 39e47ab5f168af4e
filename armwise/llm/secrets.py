"""Secret scans through nested encodings by a worklist of layers.

A text is the first layer. Each layer is scanned for secrets and unwrapped: percent-encoding, Unicode escapes and character
references give a layer with their characters in place; base64 stretches, and what they or percent-encoded bytes compress, give
layers of their own. New layers join the worklist until none is new; a layer whose characters were seen at the same place ends
its branch. Every layer knows the range of the text that each of its characters came from, so that what is found anywhere is a
span of the text.

No secret spans a line feed, so that a layer holds one line, or one stretch, and lines without an encoding are not copied.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm.arrowtext import released

#: Kinds in order, each with its pattern and the group that must have so many characters.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: Escapes of one character. An escape of an escape's own first character is taken off with it, however often it was escaped.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\(?:u005[cC])*(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&(?:amp;|#38;|#[xX]26;)*#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"
)
#: Base64: stretches, wrapped over lines or not; three quads in a row that decode to ASCII; how compressed data begins.
STRETCH = re.compile(r"[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/]{40,80}(?:\r?\n[A-Za-z0-9+/]{1,80})+")
WRAPPED = re.compile(r"[A-Za-z0-9+/]{40,80}(?:\r?\n[A-Za-z0-9+/]{1,80})+")
PLAIN = re.compile(r"(?=(?:[A-Za-f][A-HQ-Xg-nw-z0-3][ABEFIJMNQRUVYZcdghklopstwx014589][A-Za-z0-9+/_-]){3})")
PACKED = re.compile(r"H4sI|eJ[w-z]|eN[o-r]|eA[E-H]|eF[4-7]|Qlpo|/Td6|KLUv")
#: Percent-encoded bytes that begin as compressed data does: gzip, zlib, bzip2, xz, zstandard.
RAW = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:B|%42)(?:Z|%5[Aa])(?:h|%68)|%[Ff][Dd]7zXZ|%28%[Bb]5%2[Ff]%[Ff][Dd]|\(%[Bb]5(?:/|%2[Ff])%[Ff][Dd])(?:%[0-9A-Fa-f]{2}|[!-$&-~])*")
#: So many layers of escapes, one around the other, are taken off and scanned one by one; those below come off at once.
SINGLE = 8
#: A compressed layer is read in pieces of so many characters, each with the end of the one before.
PIECE, OVERLAP = 1 << 22, 1 << 17

#: What a line or a text must have, by a linear engine over whole arrays, to be looked at more closely.
_SECRET = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_CODED = (
    r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&(?:amp;)*#[0-9xX]|(?:[A-Za-f][A-HQ-Xg-nw-z0-3][ABEFIJMNQRUVYZcdghklopstwx014589][A-Za-z0-9+/_-]){3}"
    r"|H4sI|e(?:J[w-z]|N[o-r]|A[E-H]|F[4-7])[A-Za-z0-9+/_-]{13}|Qlpo|/Td6|KLUv"
)
_MAYBE_CODED = re.compile(_CODED)


@dataclass(frozen=True)
class Layer:
    """Characters, and for each the range of the text (end exclusive) that it came from; path names the encodings taken off."""

    text: str
    lo: np.ndarray
    hi: np.ndarray
    path: tuple[str, ...] = ()

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.lo[a:b].min()), int(self.hi[a:b].max())


def found(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the secrets that text shows as it stands."""
    for kind, (pattern, group, least) in KINDS.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _spliced(layer: Layer, parts: list[tuple[int, int, str, list[int], list[int]]], name: str) -> Layer | None:
    """The layer with parts (start, end, new characters, each one's first and last-exclusive place in the layer) put in."""
    if not parts:
        return None
    text, lo, hi, at = [], [], [], 0
    for start, end, new, first, last in parts:
        text += [layer.text[at:start], new]
        lo += [layer.lo[at:start], layer.lo[first]]
        hi += [layer.hi[at:start], layer.hi[np.array(last, int) - 1]]
        at = end
    text.append(layer.text[at:])
    lo.append(layer.lo[at:])
    hi.append(layer.hi[at:])
    return Layer("".join(text), np.concatenate(lo), np.concatenate(hi), (*layer.path, name))


def _percent(layer: Layer) -> Layer | None:
    """Percent-encoded UTF-8 as characters; a byte that is no part of one stands for itself."""
    parts = []
    for m in PERCENT.finditer(layer.text):
        places = [(m.start() + x.start(), m.start() + x.end(), int(x[1], 16)) for x in re.finditer(r"%(?:25)*([0-9A-Fa-f]{2})", m[0])]
        data = bytes(p[2] for p in places)
        new, first, last, i = [], [], [], 0
        while i < len(data):
            size = 1 if data[i] < 0xC2 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4 if data[i] < 0xF5 else 1
            try:
                char = data[i : i + size].decode()
            except UnicodeDecodeError:
                size, char = 1, chr(data[i])
            size = min(size, len(data) - i)
            new.append(char)
            first.append(places[i][0])
            last.append(places[i + size - 1][1])
            i += size
        parts.append((m.start(), m.end(), "".join(new), first, last))
    return _spliced(layer, parts, "url")


def _escapes(layer: Layer) -> Layer | None:
    """Unicode escapes and numeric character references as characters; those that name none stay."""
    parts = []
    for m in ESCAPE.finditer(layer.text):
        code = int(next(g for g in m.groups()[:5] if g), 16) if any(m.groups()[:5]) else int(m[6])
        if code < 0x110000:
            parts.append((m.start(), m.end(), chr(code), [m.start()], [m.end()]))
    return _spliced(layer, parts, "unicode")


def _settled(layer: Layer) -> Layer | None:
    """All escapes off, in one pass: a character that an escape gave is read again with what came before it."""
    out: list[tuple[str, int, int]] = []
    changed = False
    for i, c in enumerate(layer.text):
        new = (c, i, i + 1)
        while new:
            out.append(new)
            new = None
            c = out[-1][0]
            if c in "0123456789abcdefABCDEF};":
                tail = "".join(x[0] for x in out[-12:])
                m = re.search(r"%([0-9A-Fa-f]{2})$|" + ESCAPE.pattern.replace(r"|&", r"$|&") + "$", tail)
                if m:
                    code = int(next(g for g in m.groups()[:6] if g), 16) if any(m.groups()[:6]) else int(m[7])
                    if code < 0x110000:
                        new = (chr(code), out[-len(m[0])][1], out[-1][2])
                        del out[-len(m[0]) :]
                        changed = True
    if not changed:
        return None
    first, last = np.array([x[1] for x in out]), np.array([x[2] for x in out]) - 1
    return Layer("".join(x[0] for x in out), layer.lo[first], layer.hi[last], (*layer.path, "escapes"))


def _stream(data: bytes) -> Iterator[bytes]:
    """What data unpacks to, in blocks, as far as it can be read; nothing if it isn't compressed."""
    makers: list[Callable] = []
    if data[:2] == b"\x1f\x8b":
        makers = [lambda: zlib.decompressobj(31)]
    elif data[:1] == b"\x78":
        makers = [lambda: zlib.decompressobj(15)]
    elif data[:3] == b"BZh":
        makers = [bz2.BZ2Decompressor]
    elif data[:6] == b"\xfd7zXZ\x00":
        makers = [lzma.LZMADecompressor]
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        try:
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as reader:
                while block := reader.read(1 << 20):
                    yield block
        except zstandard.ZstdError:
            pass
        return
    for make in makers:
        d = make()
        rest = data
        try:
            while not d.eof:
                block = d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
                if block:
                    yield block
                elif not rest and getattr(d, "needs_input", True):
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return


def _unpacked(data: bytes, lo: int, hi: int, path: tuple[str, ...]) -> Iterator[Layer]:
    """The layers of compressed data, all of whose characters came from one range, in pieces."""
    held = ""

    def piece(text: str) -> Layer:
        return Layer(text, np.full(len(text), lo), np.full(len(text), hi), (*path, "compressed"))

    for block in _stream(data):
        held += block.decode("latin-1")
        if len(held) >= PIECE:
            yield piece(held)
            held = held[-OVERLAP:]
    if held:
        yield piece(held)


def _base64(layer: Layer) -> Iterator[Layer]:
    """A layer for each stretch and alignment at which it decodes to ASCII or to compressed data; bytes stand as characters."""
    for m in STRETCH.finditer(layer.text):
        yield from _decoded(layer, m[0], np.arange(m.start(), m.end()))


def _wrapped(layer: Layer) -> Iterator[Layer]:
    """The same for stretches that are wrapped over lines."""
    for m in WRAPPED.finditer(layer.text):
        places = np.array([m.start() + i for i, c in enumerate(m[0]) if c not in "\r\n"])
        yield from _decoded(layer, re.sub(r"[\r\n]", "", m[0]), places)


def _decoded(layer: Layer, stretch: str, places: np.ndarray) -> Iterator[Layer]:
    path = (*layer.path, "base64")
    seen: set[int] = set()
    for m in PLAIN.finditer(stretch):
        seen.add(m.start() % 4)
        if len(seen) == 4:
            break
    plain = stretch.translate({45: 43, 95: 47})

    def opened(start: int) -> bytes:
        body = plain[start:]
        return base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "==="[: -len(body) % 4 % 3]) if len(body) > 1 else b""

    for start in sorted(seen):
        data = opened(start)
        byte = np.arange(len(data))
        first = places[start + 4 * (byte // 3) + byte % 3]
        last = places[start + 4 * (byte // 3) + byte % 3 + 1]
        yield Layer(data.decode("latin-1"), layer.lo[first], layer.hi[last], path)
    for m in PACKED.finditer(plain):
        data = opened(m.start())
        lo, hi = layer.span(int(places[m.start()]), int(places[-1]) + 1)
        yield from _unpacked(data, lo, hi, path)


def _raw(layer: Layer) -> Iterator[Layer]:
    for m in RAW.finditer(layer.text):
        yield from _unpacked(unquote_to_bytes(m[0]), *layer.span(m.start(), m.end()), (*layer.path, "url"))


def _lines(layer: Layer) -> Iterator[Layer]:
    """The layer's lines that may hold an encoding."""
    at = 0
    for line in layer.text.split("\n"):
        if _MAYBE_CODED.search(line):
            yield Layer(line, layer.lo[at : at + len(line)], layer.hi[at : at + len(line)], layer.path)
        at += len(line) + 1


def unwrapped(text: str) -> Iterator[Layer]:
    """Every layer below text, one at a time, depth first."""
    seen: set[tuple[bytes, int, int]] = set()
    place = np.arange(len(text) + 1)
    work: list[Iterator[Layer]] = [iter([Layer(text, place[:-1], place[1:])])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        if layer.path:
            yield layer

        def inner(layer: Layer = layer) -> Iterator[Layer]:
            yield from _wrapped(layer)
            for line in _lines(layer):
                deep = line.path[-SINGLE:]
                steps = (_settled,) if len(deep) == SINGLE and set(deep) <= {"url", "unicode"} else (_percent, _escapes)
                yield from (x for x in (f(line) for f in steps) if x)
                yield from _base64(line)
                yield from _raw(line)

        work.append(inner())


def spans(text: str) -> dict[tuple[int, str, int], tuple[bool, str]]:
    """(start, kind, end): whether text shows it as it stands, and the encodings around it (the first found), joined by >."""
    out = {(a, kind, b): (True, "") for kind, a, b in found(text)}
    for layer in unwrapped(text):
        for kind, a, b in found(layer.text):
            a, b = layer.span(a, b)
            out.setdefault((a, kind, b), (False, ">".join(layer.path)))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and secrets, an array of kind, start, end (code points, end exclusive), base and path, for every row of docs.

    base: the text shows it as it stands; else path names the encodings around it. Sorted by start, kind and end.
    Screens over whole Arrow arrays, by a linear engine, leave the texts that have neither a secret nor an encoding.
    Defined cases: null and empty texts have no secrets; keys are passed on, null, equal or not, a row for every row; broken
    escapes, broken base64 and data that ends early are read as far as they go; a compressed layer of any size is read in
    pieces that overlap by 131,072 characters; secrets in one compressed stretch are one span a kind, the stretch; other columns
    are not read; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("path", pa.string())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            texts = b.column(1)
            look = pc.fill_null(pc.match_substring_regex(texts, f"{_SECRET}|{_CODED}"), False).to_pylist()
            rows = []
            for i, worth in enumerate(look):
                some = spans(texts[i].as_py()) if worth else {}
                order = sorted(some, key=lambda s: (s[0], _ORDER[s[1]], s[2]))
                rows.append([{"kind": k, "start": a, "end": e, "base": some[a, k, e][0], "path": some[a, k, e][1]} for a, k, e in order])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], ["key", "secrets"])

    found_in = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scanned, f"key {kind}, secrets array<struct<kind: string, start: int, end: int, base: boolean, path: string>>")
    return found_in.withColumnRenamed("key", key)


def _listed(secrets: Column) -> Column:
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of scan(): key, n_assign, n_access and n_hex of the secrets shown as they stand, base_sha256 of those, and spans of all."""
    base = F.filter("secrets", lambda s: s["base"])

    def shown(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [shown(kind) for kind in KINDS]
    return scan(docs, key, text).select(key, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every secret's range, and all that overlaps it, replaced by mark; the other columns stay as they are."""

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            at, parts = 0, []
            for a, _, b in sorted(spans(t)) if t else []:
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append(None if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text, F.arrow_udf(clean, "string")(F.col(text)))
