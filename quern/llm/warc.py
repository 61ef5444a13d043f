r"""WARC archives and their index by external merge (operator 5).

Writing: payloads of at least :data:`REVISIT_BYTES` bytes that are equal (by
SHA-1 and length) are stored once, by the row with the largest page_id; the
others become revisit records that refer to it.  Which digests repeat is found
on (digest, length, page_id) alone, reduced before the shuffle; shorter pages
and pages without an id never take part in the join.  Each record is a gzip
member of its own, so that its offset in the index is a place to read from.
Tasks gather members into archives of :data:`ARCHIVE_BYTES` bytes (a longer
record is one alone) and Spark's text writer puts each into a file, followed by
an empty member as its line separator; so archives are committed like any
table, in the folder that all executors share, and a lost task leaves nothing
behind.

Reading: archives come back as whole files, are unpacked member by member,
parsed by Content-Length, and every stored payload is hashed again.  The
captures of an archive, sorted by URL key, timestamp and page, are one run.
Runs are dealt out by ranges of that key, and in each range a loser tree merges
the slices of all runs (a slice that a fetch has mixed counts as several): the
ranges in order are the capture histories of the whole corpus.  A hot URL
spreads over ranges, as the page is part of the key.

Pages have no capture times: page n counts as captured n seconds after
:data:`EPOCH`, in UTC whatever the session's zone.

Defined results: a null html is an empty payload, a null url an empty one.
Control characters in a url become blanks in the header.  Repeated rows are
stored each; of rows with the same largest page_id each is a response.  A null
page_id is written as an empty name and read back as null; it never is the one
that others refer to.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import partitions, saved, scratch

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16_000_000
#: the seconds since 1970 that page 0 counts as captured at
EPOCH = 1704067200
SEPARATOR = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def repeated(pages: DataFrame) -> DataFrame:
    """digest, size, keeper: payloads that several rows have, and the largest page_id among them. `pages`: page_id, digest, size."""
    by = pages.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return by.where("n > 1").select("digest", F.col("size").alias("same_size"), "keeper")


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as `2024-01-01T00:00:00Z`; no time zone takes part."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def records(pages: DataFrame) -> DataFrame:
    """One column `value`: the WARC record of each row, without the line breaks that end it."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    same = repeated(df.select("page_id", "digest", "size")).withColumnRenamed("digest", "same_digest")
    may = (F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    once = df.where(~may).withColumn("keeper", F.lit(None).cast("long"))
    df = df.where(may).join(same, (F.col("digest") == F.col("same_digest")) & (F.col("size") == F.col("same_size")), "left").select(*once.columns).unionByName(once)
    revisit = F.coalesce(F.col("keeper") != F.col("page_id"), F.lit(False))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", utc(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(">"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("html")),
    )
    return df.select(value.alias("value"))


def member(data: bytes) -> bytes:
    """`data` as one gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


#: a gzip member without content, which may follow any other
EMPTY = member(b"")


def _archives(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for value in batch.column("value"):
                one = member(value.as_buffer().to_pybytes() + SEPARATOR)
                if made and size + len(one) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["value"])
                    made, size = [], 0
                made.append(one)
                size += len(one)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["value"])

    return run


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    packed = records(pages).mapInArrow(_archives(archive_bytes), "value binary").select(F.col("value").cast("string"))
    # a file per row; the bytes of a string are written as they are, and Latin-1 gives those of the separator
    packed.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def members(archive: bytes, at: int = 0, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members from `at` on that have content; each is fed in pieces, so reading one does not touch the rest."""
    view = memoryview(archive)
    while at < len(view):
        start, unpack, out = at, zlib.decompressobj(31), []
        while not unpack.eof:
            fed = view[at : at + piece]
            if not len(fed):
                raise ValueError(f"the member at {start} has no end")
            out.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        if any(out):
            yield start, b"".join(out)


def url_key(url: str) -> str:
    """Host parts in reverse, then path and query: `http://www.a.org:80/x?y` is `org,a,www:80)/x?y`, lower-cased; a fragment is dropped."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    name, colon, port = host.rpartition("@")[2].partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (slash or "/") + path


def parse(archive: bytes) -> Iterator[dict[str, Any]]:
    """The records of an archive; raises where lengths or digests don't fit."""
    for at, record in members(archive):
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, stop = end + 4, end + 4 + int(head["Content-Length"])
        if record[stop:] != SEPARATOR:
            raise ValueError(f"the record at {at} doesn't end where its length says")
        split = record.index(b"\r\n\r\n", start, stop)
        http = dict(x.split(": ", 1) for x in record[start:split].decode("utf-8").split("\r\n")[1:])
        payload, digest = record[split + 4 : stop], head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"the payload at {at} isn't what was written")
        number = lambda x: int(y) if (y := x.removeprefix("<urn:page:").rstrip(">")) else None
        yield {
            "page_id": number(head["WARC-Record-ID"]), "url_key": url_key(head.get("WARC-Target-URI", "")), "captured": head["WARC-Date"], "offset": at,
            "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"],
            "refers_to": number(head["WARC-Refers-To"]) if revisit else None,
        }


_INDEX = "archive string, page_id long, url_key string, captured string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_COLUMNS = [x.split()[0] for x in _INDEX.split(", ")]
_TYPES = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _INDEX.split(", ")])


def _key(row: dict[str, Any]) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["offset"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = path.as_py().rsplit("/", 1)[1]
            run = sorted(({"archive": name} | r for r in parse(content.as_py())), key=_key)
            yield pa.RecordBatch.from_pylist(run, schema=_TYPES)


class LoserTree:
    """Merges sorted runs: each step replays one path from a leaf to the root, about log2(runs) comparisons."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.head: list = [next(r, None) for r in self.runs]
        n = len(self.runs)
        self.loser = [0] * n  # of each inner node; place 0 has the winner
        winner = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winner[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[a] is not None
        return self.head[a] <= self.head[b]

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.runs)
        while n and (item := self.head[self.winner]) is not None:
            yield item
            at = self.winner
            self.head[at] = next(self.runs[at], None)
            node = (at + n) // 2
            while node:
                if self._before(self.loser[node], at):
                    at, self.loser[node] = self.loser[node], at
                node //= 2
            self.winner = at


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict[str, Any]] = []
    runs: list[list[tuple]] = []
    now: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = _key(row)
            run = now.get(row["archive"])
            if run is None or run[-1][0] > key:  # a new archive, or a run that a fetch has mixed goes on as another
                run = now[row["archive"]] = []
                runs.append(run)
            run.append((key, len(rows)))
            rows.append(row)
    out = []
    for _, i in LoserTree(runs):
        out.append(rows[i])
        if len(out) == 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_TYPES)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_TYPES)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The capture histories of the archives under `path`, in global order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = saved(files.mapInArrow(_runs, _INDEX), "captures")
    ranged = runs.repartitionByRange(partitions(runs), "url_key", "captured", "page_id", "archive", "offset")
    return ranged.mapInArrow(_merged, _INDEX)


def archive(pages: DataFrame) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives and returns what reading them back finds, a row per page in global order."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write(pages, path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset")
