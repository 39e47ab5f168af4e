"""Web archives: WARC files through Spark's text writer, and an index merged from locally sorted capture runs.

Records are text: a header, a blank line and the payload, parted by the writer's line separator CRLF CRLF, which is what
ends a WARC record. Reading goes by Content-Length. Every archive file gives one run of captures sorted by (URL key, time,
id); runs are dealt out by range and each range's runs are merged by a loser tree into globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwise.llm.common import looked_up, scratch, text_of, written

CRLF = "\r\n"
#: At most so many rows are broadcast: groups of equal payloads, 80 bytes each.
BROADCAST_ROWS = 200_000
#: Captures of one range of the merge, which one task holds.
RANGE = 200_000
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: each five hex digits are four letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_B32), (F.shiftright(v, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def decided(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, payload_bytes, and refers_to for revisits.

    Of equal payloads of at least `least` bytes the record with the largest id is the response. Only groups of two or more
    matter; they are broadcast while they are few, and else shuffled with hot digests set apart.
    """
    t = text_of(html)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), t.alias("html"), F.sha1(t.cast("binary")).alias("digest"), F.octet_length(t).cast("long").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = written(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(groups), "digest", "left")
    else:
        single = rows.join(groups.select("digest"), "digest", "left_anti").withColumns({"_first": F.lit(None).cast("long"), "_n": F.lit(1).cast("long")})
        met = looked_up(rows, groups, "digest", "_n").unionByName(single)
    again = (F.col("_first") != F.col("page_id")) & (F.col("payload_bytes") >= least)
    return met.withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first", "_n")


def records(rows: DataFrame, date: str) -> DataFrame:
    """One string a record: version, named fields, a blank line, and for responses the payload."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")

    def record_id(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id("page_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(revisit, record_id("refers_to"))),
        field("WARC-Payload-Length", F.col("payload_bytes")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    """Files of at most file_bytes of payload, a single larger record apart: records of a size class of 64 KB, 1 MB or more share files, so many as fit."""
    least = -1
    for most in (64 << 10, 1 << 20, None):
        size = F.col("payload_bytes")
        some = rows.where((size > least) & (size <= most) if most else size > least)
        if least < 0 or some.limit(1).count():
            per_file = max(1, file_bytes // most) if most else 1
            records(some, date).write.mode("errorifexists" if least < 0 else "append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        least = most


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and payload of each record, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        yield at, fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def url_key(url: str | None) -> str:
    """The host's labels in reverse, lower-cased, then the path: captures of one host and page lie together."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path


_FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("file_offset", pa.int64())]
_DDL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, file_offset long"
_IN_RUN = [*_FIELDS, ("run_slot", pa.int64())]


def _number(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def _order(row: Sequence) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive file, checked against their digests, as a run sorted by URL key, time and id."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for at, f, payload in parse(zlib.decompress(content.as_py(), wbits=31)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}, byte {at}: the payload does not match its digest")
                    rows.append((url_key(f.get("WARC-Target-URI")), f["WARC-Date"], _number(f["WARC-Record-ID"]), int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], _number(f.get("WARC-Refers-To")), name.rpartition("/")[2], at))
                rows.sort(key=_order)
                columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], pa.array(range(len(rows)), pa.int64())], [n for n, _ in _IN_RUN])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    return files.mapInArrow(captures, f"{_DDL}, run_slot long")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so that a step replays one leaf-to-root path."""

    def __init__(self, runs: Sequence[Iterator], order: Callable) -> None:
        self.k, self.runs, self.order = len(runs), list(runs), order
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.order(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x < y or x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self._pull(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the order of (URL key, time, id), numbered from 0 in capture_slot.

    Runs are cut by range over the whole sort key, so that no host or page makes a large task, into ranges of about RANGE
    captures at most; a task holds the run pieces of its own range.
    """
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    whole = [F.col(c).asc_nulls_first() for c in ("url_key", "captured", "page_id", "file", "file_offset")]
    dealt = runs.repartitionByRange(n, *whole).sortWithinPartitions("file", "run_slot").withColumn("_part", F.spark_partition_id())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list] = {}
        part = 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(_FIELDS))]
            part = b.column(b.num_columns - 1)[0].as_py() if b.num_rows else part
            for row in zip(*cols, strict=True):
                pieces.setdefault(row[7], []).append(row)
        out: list = []
        slot = 0
        for row in LoserTree([iter(p) for p in pieces.values()], _order):
            out.append(row)
            if len(out) == 8192:
                yield _captures(out, part, slot)
                slot += len(out)
                out = []
        if out:
            yield _captures(out, part, slot)

    laid = written(dealt.mapInArrow(merged, f"{_DDL}, _part int, _slot long"), "captures")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_offset"))
    return laid.join(F.broadcast(offsets), "_part").withColumn("capture_slot", F.col("_slot") + F.col("_offset")).drop("_part", "_slot", "_offset")


def _captures(rows: list, part: int, slot: int) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(slot, slot + len(rows)), pa.int64())], [*[n for n, _ in _FIELDS], "_part", "_slot"])


def archive(pages: DataFrame, path: str | None = None, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages as WARC files under path (the shared folder where none is given) and returns the merged capture index.

    Defined cases: a null payload is an empty one; a null URL has no WARC-Target-URI and the empty key; line ends in a URL are
    percent-encoded; a null id is written as such, is always a response and refers to nothing; rows that repeat the largest id
    of their group are all responses; an empty table gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(decided(pages, least), path, date)
    return merge_runs(written(read_runs(spark, path), "runs"))


def archive_sql() -> str:
    """DuckDB SQL for the rows of the query op10 over the view pages."""
    letters = " || ".join(f"substr('{_B32}', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31) + 1)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END AS rest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper,
             coalesce(array_to_string(list_reverse(string_split(lower(split_part(rest, '/', 1)), '.')), ',') || ')'
             || substr(rest, length(split_part(rest, '/', 1)) + 1), '') AS url_key FROM p)
SELECT page_id, payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, url_key,
       (row_number() OVER (ORDER BY url_key, page_id) - 1)::BIGINT AS capture_slot
FROM k
"""
