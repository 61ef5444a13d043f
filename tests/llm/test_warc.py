import datetime
import gzip
import hashlib
import random

import pyarrow as pa
import pytest

from quern.llm import warc as w
from quern.llm.common import scratch, table

SCHEMA = "page_id long, url string, html string, digest string, keeper long"


def brute(rows):
    payload = {}
    for page, _, text in rows:
        data = (text or "").encode()
        if page is not None and len(data) >= w.REVISIT_BYTES:
            payload.setdefault(data, []).append(page)
    for page, _, text in rows:
        data = (text or "").encode()
        group = payload.get(data, [])
        keeper = max(group) if len(group) > 1 and page is not None else None
        revisit = keeper is not None and keeper != page
        yield page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None


def check(df, rows):
    out = df.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(brute(rows), key=str)
    keys = [(r.url_key, r.captured, r.page_id or 0) for r in out]
    assert keys == sorted(keys)


def test_odd_pages(spark):
    big, bytes_1000 = "é\r\n\r\nWARC/1.1\r\n" * 200, "x" * 1000
    rows = [
        (1, "http://a.org/x", big), (2, "http://a.org/x", big), (9, None, big), (3, "http://b.org", "y" * 999), (4, "http://b.org", "y" * 999), (5, "http://b.org/\r\nEvil: 1", bytes_1000),
        (6, "", bytes_1000), (7, "u://h:80/p?q#f", None), (8, "no scheme", ""), (9, "http://a.org/x", big), (None, "http://n.org", big), (None, None, "\r\n\r\n"), (10, "http://é.org/ü", "世" * 400), (11, "http://z", "a" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    check(w.archive(df), rows)
    check(w.archive(df.limit(0)), [])


def test_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    check(w.archive(pages), [tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_archives_hold_the_payloads(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<p>{'text ' * 300}{k % 4}</p>") for k in range(40)]
    path = scratch(spark, "archives")
    w.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, 600)
    files = {f.path.rsplit("/", 1)[1]: bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()}
    assert len(files) > 10 and all(len(x) < 1500 for x in files.values())  # archives are bounded by bytes
    whole = [gzip.decompress(x) for x in files.values()]  # and are gzip files
    assert sum(x.count(b"WARC-Type: response") for x in whole) == 4 and sum(len(list(w.parse(x))) for x in files.values()) == 40
    for r in w.index(spark, path).collect():  # an offset is a place to read from
        at, record = next(w.members(files[r.archive], r.offset))
        assert at == r.offset and f"<urn:page:{r.page_id}>".encode() in record and record.endswith(b"\r\n\r\n")


def test_long_members_are_read_in_pieces():
    data = [b"a" * 10, random.Random(1).randbytes(300_000), b"", b"b" * 1_000_000]
    archive = b"".join(w.member(x) + w.EMPTY for x in data)
    assert [x for _, x in w.members(archive, piece=1000)] == [x for x in data if x]
    with pytest.raises(ValueError):
        list(w.members(archive[:-30]))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_dates_are_utc_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ids = [0, 1, 59, 3600, 86399, 86400, 60 * 86400 + 5, 70 * 86400 + 7200 + 1800, None]
        out = w.archive(spark.createDataFrame([(k, "http://a.b/", "x") for k in ids], "page_id long, url string, html string")).collect()
        assert {r.page_id: r.captured for r in out} == {k: datetime.datetime.fromtimestamp(w.EPOCH + (k or 0), datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for k in ids}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_mixed_runs_are_merged():
    row = lambda archive, k: {"archive": archive, "page_id": k, "url_key": f"k{k:03}", "captured": "t", "offset": k, "payload_bytes": 0, "payload_digest": "", "record_type": "response", "refers_to": None}
    rnd = random.Random(5)
    rows = [row("a", k) for k in range(0, 40, 2)] + [row("b", k) for k in range(1, 40, 2)]
    for mixed in (rows, rows[10:20] + rows[:10] + rows[20:], rnd.sample(rows, len(rows))):
        out = [r for b in w._merged(iter([pa.RecordBatch.from_pylist(mixed, schema=w._TYPES)])) for r in b.to_pylist()]
        assert [r["page_id"] for r in out] == list(range(40))


def test_loser_tree():
    rnd = random.Random(3)
    for n in range(0, 12):
        runs = [sorted((rnd.randrange(50), k) for _ in range(rnd.randrange(0, 20))) for k in range(n)]
        assert list(w.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert w.url_key("HTTP://User@www.Example.org:80/Path?q=1#frag") == "org,example,www:80)/path?q=1"
    assert w.url_key("http://a.b") == "b,a)/"
    assert w.url_key("") == ")/"
