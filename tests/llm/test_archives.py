import base64
import gzip
import hashlib

import pytest

from contestkit.llm import archives, common, queries
from contestkit.llm.common import fresh_path


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, VERSION int, `block` string")


def plain(rows):
    """What the contract asks for, from the pages alone; None sorts last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, []
    for k in order:
        payload = (rows[k][2] or "").encode()
        is_first = payload not in first
        first.setdefault(payload, rows[k][0])
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((rows[k][0], len(payload), sha, "response" if is_first else "revisit", None if is_first else first[payload]))
    return sorted(out, key=repr)


TRICKY = [
    (1, "http://a/x y", "<p>one</p>"), (2, None, None), (3, "http://b/", ""), (4, "http://c/\n\tq", "<p>one</p>"), (5, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"),
    (6, "v", "\nhttp://z/ 1.2.3.4 20000101000000 text/html 5\nhello\nfiledesc://a 0.0.0.0 2000 text/plain 1\n"), (7, "w", "é ü 漢字   😀"), (7, "w", "é ü 漢字   😀"), (None, "n", "<p>one</p>"),
    (-3, "m", "negative id"), (9, "m", "negative id"), (10, "l", "long " * 300_000), (11, "h", "HTTP/1.1 200 OK\r\n\r\nbody\n\n"), (12, "e", "ends\r\n\r\n"), (13, "e", "ends\n"), (14, "e", "\n"), (15, "e", "\r\n\r\n"),
]


@pytest.mark.parametrize("most", [1, 3000, archives.ARCHIVE_BYTES])
def test_pages_come_back(spark, most):
    got = archives.archived_pages(pages(spark, TRICKY).repartition(3), archive_bytes=most).collect()
    assert sorted(map(tuple, got), key=repr) == plain(TRICKY)


def test_query_against_the_pages(spark, tmp_path, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(10_000 + k, "u", rows[k % 3][2]) for k in range(300)]  # most rows share a payload
    pages(spark, rows).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_shuffled_side_of_the_uneven_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = [(k, "u", "hot") for k in range(20)] + [(100 + k, "u", f"pair {k // 2}") for k in range(20)] + [(200 + k, "u", f"own {k}") for k in range(5)]
    assert sorted(map(tuple, archives.archived_pages(pages(spark, rows)).collect()), key=repr) == plain(rows)


def test_small_payloads_stay_responses_and_empty_tables(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in archives.archived_pages(pages(spark, rows), min_bytes=4).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert archives.archived_pages(pages(spark, [])).collect() == []


V1 = b"filedesc://IA-001.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"filedesc://IA-002.arc 0.0.0.0 20010401120000 text/plain 200 - - 0 IA-002.arc 122\n2 0 Alexa Internet\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def filed(head, rest):
    """The head with its block's true length."""
    line, _, block = head.partition(b"\n")
    return line.rsplit(b" ", 1)[0] + b" %d\n" % len(block) + block + b"\n" + rest


def test_versions_and_lengths():
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>hi</p>"
    one = filed(V1, b"http://a.b/c d 1.2.3.4 19970101000000 text/html %d\n" % len(http) + http + b"\ndns:a.b 1.1.1.1 199701010000 text/dns 4\nabcd\n")
    got = list(archives.parse_arc(one))
    assert [(r.url, r.version, len(r.block), r.error) for r in got] == [("filedesc://IA-001.arc", 1, len(V1.split(b"\n", 1)[1]), None), ("http://a.b/c d", 1, len(http), None), ("dns:a.b", 1, 4, None)]
    assert archives.http_parts(got[1].block)[1] == b"<p>hi</p>" and archives.iso_date(got[2].date) == "1997-01-01T00:00:00Z"
    two = filed(V2, b"http://a.b/ 1.2.3.4 20010401120001 text/html 404 ABC - 0 IA-002.arc 5\nhello\n")
    got = list(archives.parse_arc(two))
    assert [(r.url, r.version, r.status, r.block) for r in got][1:] == [("http://a.b/", 2, "404", b"hello")]
    both = list(archives.parse_arc(one + two))
    assert [r.version for r in both] == [1, 1, 1, 2, 2] and not any(r.error for r in both)
    assert archives.iso_date("20011399") is None and archives.iso_date("2001") is None and archives.iso_date("2001010203") == "2001-01-02T03:00:00Z"


def test_faulty_archives():
    good = b"http://a/ 1.1.1.1 19970101000000 text/html 3\nabc\n"
    got = list(archives.parse_arc(filed(V1, good + b"some junk\nhere\n" + good)))
    assert [r.error for r in got] == [None, None, "no header line of its version", None] and got[2].block == b"some junk\nhere\n" and got[3].block == b"abc"
    cut = list(archives.parse_arc(filed(V1, good)[:-3]))
    assert cut[-1].error == "2 bytes are missing" and cut[-1].block == b"a"
    assert list(archives.parse_arc(b"")) == [] == list(archives.parse_arc(b"\n\n"))
    packed = gzip.compress(good) + gzip.compress(good)
    assert archives.plain_bytes(packed) == good * 2 and archives.plain_bytes(packed[:-4]) == good * 2 and archives.plain_bytes(good) == good
    broken = list(archives.parse_warc(b"junk\r\n" + archives.warc_record([("WARC-Type", "resource")], b"xy") + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    assert [(b, e) for _, _, b, e in broken] == [(b"junk\r\n", "no record begins here"), (b"xy", None), (b"abc", "6 bytes are missing")]


def test_conversion_of_foreign_archives(spark):
    base = fresh_path(spark, "test-arc")
    body = bytes(range(256))  # no UTF-8
    http = b"HTTP/1.1 200 OK\r\nContent-Type: image/x\r\n\r\n" + body
    rows = [("http://a/1", "1.1.1.1", "19990101000000", "image/x", http), ("http://a/2", "1.1.1.1", "19980101000000", "image/x", http), ("dns:a", "1.1.1.1", "19990101", "text/dns", b"19990101\n")]
    arc = spark.createDataFrame(rows, "url string, ip string, date string, content_type string, block binary")
    archives.write_arc(arc.coalesce(1), f"{base}/arc", 1, compression=None)
    records = archives.read_arc(spark, f"{base}/arc", blocks=True).collect()
    assert [r["kind"] for r in records] == ["warcinfo", "response", "response", "resource"] and bytes(records[1]["payload"]) == body
    archives.convert(spark, f"{base}/arc", f"{base}/warc")
    read = archives.read_warc(spark, f"{base}/warc", payloads=True).collect()
    by = {r["url"]: r for r in read}
    assert all(r["sound"] and r["error"] is None for r in read) and [r["record_type"] for r in read if r["url"] is None] == ["warcinfo"]
    assert by["http://a/2"]["record_type"] == "response" and bytes(by["http://a/2"]["payload"]) == body and by["http://a/2"]["date"] == "1998-01-01T00:00:00Z"
    assert by["http://a/1"]["record_type"] == "revisit" and by["http://a/1"]["refers_to"] == by["http://a/2"]["record_id"] and by["http://a/1"]["payload_digest"] == by["http://a/2"]["payload_digest"]
    assert by["dns:a"]["record_type"] == "resource" and by["dns:a"]["date"] == "1999-01-01T00:00:00Z"
    again = archives.read_arc(spark, f"{base}/arc").collect()
    assert [r["record_id"] for r in again] == [r["record_id"] for r in records]


def test_query_against_its_sql(spark, tmp_path, sf_dir):
    import duckdb

    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(50_000 + k, None, rows[k % 2][2]) for k in range(6)] + [(60_000, "u", None), (60_001, "u", ""), (60_002, "u", "é 漢")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    base = duckdb.connect()
    base.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = base.execute(queries.ORACLES["op13_warc"])
    assert [d[0] for d in found.description] == queries.op13_warc(spark, str(tmp_path)).columns
    assert sorted(found.fetchall(), key=repr) == plain(rows) == sorted(map(tuple, queries.op13_warc(spark, str(tmp_path)).collect()), key=repr)
