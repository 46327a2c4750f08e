"""Legacy ARC archives to WARC: version-specific header lines, declared lengths, synthesised WARC records, revisits.

An archive is read by one task from its beginning, since only declared lengths tell records from payloads that look like records. So
archives are kept to about ``ARCHIVE_BYTES``: a task packs its records into rows of that many bytes, and the text sink
writes each row as a file of its own, through Spark's committer, to any store that Spark can write to. No payload is shuffled
unless more than ``HOT_KEYS`` digests repeat.

ARC version 1 has the header line ``URL IP-address Archive-date Content-type Archive-length``; version 2 has five more fields before the length:
``Result-code Checksum Location Offset Filename``. A ``filedesc://`` record at the beginning tells the version (it may come again, where archives were joined).
Fields are cut off from the right, since old URLs hold blanks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.llm.common import forget, fresh_path, pick, remove, stash, uneven_join

ARCHIVE_BYTES = 16 << 20
_BATCH_BYTES = 8 << 20
_ORIGIN = "contestkit"
#: Fields of a header line by version, and the lines that declare them (fixed by the format).
FIELDS = {1: 5, 2: 10}
DEFINITION = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_HEADER = {
    1: re.compile(rb"^[^\n]* [0-9A-Fa-f.:]+ \d{8,14} \S+ \d+\r?$", re.M),
    2: re.compile(rb"^[^\n]* [0-9A-Fa-f.:]+ \d{8,14} \S+ \S+ \S+ \S+ \S+ \S+ \d+\r?$", re.M),
}
_WARC = re.compile(rb"^WARC/\d+\.\d+\r\n", re.M)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """One record of an ARC archive; ``error`` tells what is wrong with it, else None."""

    offset: int
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    status: str
    block: bytes
    error: str | None = None


def plain_bytes(data: bytes) -> bytes:
    """The archive uncompressed: gzip members, as many as there are; what is left of a cut or broken member stays readable up to the fault."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (EOFError, OSError, zlib.error):
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(data))
            except zlib.error:
                break
            data = member.unused_data
        return b"".join(out)


def iso_date(date: str) -> str | None:
    """8 to 14 digits of an Archive-date as a WARC-Date; what is missing is zero. None if it is no date."""
    if not re.fullmatch(r"\d{8}(\d\d){0,3}", date):
        return None
    d = date.ljust(14, "0")
    if not ("01" <= d[4:6] <= "12" and "01" <= d[6:8] <= "31" and d[8:10] <= "23" and d[10:12] <= "59" and d[12:] <= "60"):
        return None
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an uncompressed archive in order, its ``filedesc`` ones included.

    A header line that does not fit its version gives a record with ``error`` whose block is what was passed over up to the next line that fits;
    a declared length beyond the end gives one with the bytes that there are.
    """
    at, version, n = 0, 0, len(data)
    while True:
        while at < n and data[at] in b"\r\n":
            at += 1
        if at >= n:
            return
        end = data.find(b"\n", at)
        end = n if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if line.startswith(b"filedesc://"):
            version = 2 if _HEADER[2].fullmatch(line) else 1
        if not version:  # an archive without a version block: by its first header line
            version = 2 if _HEADER[2].fullmatch(line) else 1
        if not _HEADER[version].fullmatch(line):
            found = _HEADER[version].search(data, end)
            upto = found.start() if found else n
            yield ArcRecord(at, version, "", "", "", "", "", data[at:upto], "no header line of its version")
            at = upto
            continue
        parts = line.decode("utf-8", "replace").rsplit(" ", FIELDS[version] - 1)
        length, begin = int(parts[-1]), end + 1
        block = data[begin : begin + length]
        error = None if len(block) == length else f"{length - len(block)} bytes are missing"
        yield ArcRecord(at, version, *parts[:4], parts[4] if version == 2 else "-", block, error)
        at = begin + length


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP message; a block of another kind is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [k + len(x) for x in (b"\r\n\r\n", b"\n\n") if (k := block.find(x)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def head_field(head: bytes, name: str) -> str | None:
    """A field of an HTTP head, by its name in either case."""
    found = re.search(rb"^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.M | re.I)
    return found[1].decode("utf-8", "replace") if found else None


def digest(data: bytes) -> str:
    """SHA-1 in base32, bare."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    """White space and control characters as escapes, so that the URL fits a header line; null becomes ``urn:none``."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:none"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record with the blank lines that end it; null fields are left out."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, fields with lower-case names, block, error) of an uncompressed archive's records, by their declared lengths."""
    at, n = 0, len(data)
    while True:
        while at < n and data[at] in b"\r\n":
            at += 1
        if at >= n:
            return
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else at].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdecimal():
            found = _WARC.search(data, at + 1)
            upto = found.start() if found else n
            yield at, {}, data[at:upto], "no record begins here"
            at = upto
            continue
        length, begin = int(fields["content-length"]), end + 4
        block = data[begin : begin + length]
        yield at, fields, block, None if len(block) == length else f"{length - len(block)} bytes are missing"
        at = begin + length


def _packed(pieces: Iterator[bytes], first: Callable[[], bytes], most: int) -> Iterator[bytes]:
    """Whole archives of about ``most`` bytes, each begun by ``first``."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= most:
            yield first() + b"".join(held)
            held, size = [], 0
    if held:
        yield first() + b"".join(held)


def _write(archives: DataFrame, path: str, end: str, compression: str | None) -> None:
    """Each row (archive binary) as a file; the sink supplies ``end``, with which every archive ends."""
    text = archives.select(F.col("archive").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", compression or "none").option("zlib.compress.level", "BEST_SPEED").text(path)


def _archives(batches: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["archive"])


def write_arc(rows: DataFrame, path: str, version: int, archive_bytes: int = ARCHIVE_BYTES, compression: str | None = "gzip") -> None:
    """Archives of ``rows`` (url, ip, date, content_type, block); status 200 is assumed where the block has no HTTP status line."""

    def header(url: str, ip: str, date: str, kind: str, status: str, length: int) -> bytes:
        more = f" {status} - - 0 {_ORIGIN}.arc" if version == 2 else ""
        return f"{url} {ip} {date} {kind}{more} {length}\n".encode()

    def first() -> bytes:
        block = f"{version} 0 {_ORIGIN}\n{DEFINITION[version]}\n\n".encode()
        return header(f"filedesc://{_ORIGIN}.arc", "0.0.0.0", "19960923142103", "text/plain", "200", len(block)) + block + b"\n"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for url, ip, date, kind, block in zip(*batch.columns, strict=True):
                block = block.as_py() or b""
                status = block[9:12].decode() if re.match(rb"HTTP/\d\.\d \d\d\d", block) else "200"
                yield header(clean_url(url.as_py()), ip.as_py() or "0.0.0.0", date.as_py() or "19700101000000", (kind.as_py() or "no-type").split(";")[0].strip() or "no-type", status, len(block)) + block + b"\n"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(x[:-1] for x in _packed(pieces(batches), first, archive_bytes))

    _write(pick(rows, "url", "ip", "date", "content_type", "block").mapInArrow(pack, "archive binary"), path, "\n", compression)


CONVERTED = "archive string, offset long, version int, kind string, record_id string, url string, ip string, date string, content_type string, head binary, payload_bytes long, payload_digest string, sha256 binary, error string"


def read_arc(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record under ``path`` with its WARC fields; with ``blocks`` the payload as well (null otherwise).

    kind: ``response`` for HTTP messages, ``warcinfo`` for version blocks, ``resource`` for all else (as of dns: and ftp:). record_id is made of the
    archive's path and the offset, so a repeated task gives the same. A date that is none becomes that of the version block before it, else 1970.
    ``head`` is the HTTP head; digest and size are those of the payload after it. A record with an ``error`` is a resource. An empty file has no records.
    """
    names = [x.split(" ")[0] for x in CONVERTED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 6, pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip([*names, "payload"], [*kinds, pa.binary()], strict=True)))

    def rows_of(archive: str, data: bytes) -> Iterator[tuple]:
        dated = "1970-01-01T00:00:00Z"
        for r in parse_arc(data):
            date = iso_date(r.date)
            if r.url.startswith("filedesc://"):
                kind, dated = "warcinfo", date or dated
            else:
                kind = "response" if r.block.startswith(b"HTTP/") and not r.error else "resource"
            head, payload = http_parts(r.block) if kind == "response" else (b"", r.block)
            name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{r.offset}')}"
            yield archive, r.offset, r.version, kind, name, r.url, r.ip, date or dated, r.content_type, head, len(payload), digest(payload), hashlib.sha256(payload).digest(), r.error, payload if blocks else None

    return _parsed(spark, path, rows_of, schema, f"{CONVERTED}, payload binary")


def _parsed(spark: SparkSession, path: str, rows_of: Callable[[str, bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that ``rows_of`` makes of every file under ``path``, in batches of bounded size."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for row in rows_of(name.as_py(), plain_bytes(content.as_py())):
                    held.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size >= _BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ddl)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, order_field: str | None = None, archive_bytes: int = ARCHIVE_BYTES, compression: str | None = "gzip") -> None:
    """WARC archives of all ARC records under ``arc_path``.

    Of responses with equal payloads (by SHA-1 and SHA-256) of ``min_bytes`` or more, one stays a response and the others become revisits of it, which keep
    their HTTP head only: the one with the smallest number in the HTTP field ``order_field`` (missing ones last), else the oldest; ties by record id.
    """
    seen = read_arc(spark, arc_path)
    if order_field:

        def numbers(heads: pa.Array) -> pa.Array:
            found = [head_field(x.as_py() or b"", order_field) for x in heads]
            return pa.array([int(x) if x and re.fullmatch(r"-?\d{1,18}", x) else None for x in found], pa.int64())

        order: Column = F.arrow_udf(numbers, "long")(F.col("head"))
    else:
        order = F.lit(None).cast("long")
    seen = seen.filter(F.col("kind") == "response").select("record_id", "url", "date", "payload_digest", "sha256", "payload_bytes", order.alias("place"))
    seen = stash(seen.withColumn("body", F.concat("payload_digest", F.hex("sha256"))), "arc-records")
    first = F.min(F.struct(F.col("place").isNull().alias("none"), "place", "date", "record_id", "url"))
    groups = seen.filter(F.col("payload_bytes") >= min_bytes).groupBy("body").agg(F.count("*").alias("n"), first.alias("first")).filter(F.col("n") > 1)
    groups = stash(groups.select("body", "n", "first"), "arc-copies")
    rows = read_arc(spark, arc_path, blocks=True).withColumn("body", F.when((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes), F.concat("payload_digest", F.hex("sha256"))))
    joined = uneven_join(rows, groups, "body", groups, seen.count())
    refers = F.when(F.col("first.record_id") != F.col("record_id"), F.col("first"))
    columns = ["archive", "kind", "record_id", "url", "ip", "date", "content_type", "head", "payload_digest", "payload"]
    joined = joined.select(*columns, *[refers[c].alias(f"first_{c}") for c in ("record_id", "url", "date")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield _synthesised(*(x.as_py() for x in row))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(x[:-4] for x in _packed(pieces(batches), bytes, archive_bytes))

    _write(joined.mapInArrow(pack, "archive binary"), warc_path, "\r\n\r\n", compression)
    forget(seen)
    forget(groups)


def _synthesised(archive: str, kind: str, name: str, url: str, ip: str, date: str, content_type: str, head: bytes, payload_digest: str, payload: bytes, first: str | None, first_url: str | None, first_date: str | None) -> bytes:
    """The WARC record of one ARC record."""
    block = head + payload if first is None else head
    fields: list[tuple[str, str | None]] = [("WARC-Type", "revisit" if first else kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if kind == "warcinfo":
        block = f"software: {_ORIGIN}\r\nformat: WARC File Format 1.1\r\nconverted-from: {clean_url(archive)}\r\n".encode()
        return warc_record([*fields, ("WARC-Filename", clean_url(archive.rsplit("/", 1)[-1])), ("Content-Type", "application/warc-fields")], block)
    fields += [("WARC-Target-URI", clean_url(url)), ("WARC-IP-Address", ip if ip not in ("", "-", "0.0.0.0") else None)]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if first:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{first}>"), ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", first_date)]
    plain = content_type if content_type not in ("", "-", "no-type") else "application/octet-stream"
    return warc_record([*fields, ("Content-Type", "application/http; msgtype=response" if kind == "response" else plain)], block)


READ = "archive string, offset long, record_type string, record_id string, refers_to string, url string, date string, head binary, payload_bytes long, payload_digest string, sound boolean, error string"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record under ``path``; with ``payloads`` the payload as well.

    payload_digest is worked out from the payload, for a revisit taken from its field; ``sound`` tells whether both agree with the fields. payload_bytes is
    what the archive holds: null for a revisit. Ids are without brackets.
    """
    names = [x.split(" ")[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    schema = pa.schema(list(zip([*names, "payload"], [*kinds, pa.binary()], strict=True)))

    def rows_of(archive: str, data: bytes) -> Iterator[tuple]:
        for offset, fields, block, error in parse_warc(data):
            kind = fields.get("warc-type")
            head, payload = http_parts(block) if fields.get("content-type", "").startswith("application/http") else (b"", block)
            declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            own = declared if kind == "revisit" else digest(payload)
            sound = not error and declared in (None, own) and fields.get("warc-block-digest", f"sha1:{digest(block)}") == f"sha1:{digest(block)}"
            name, refers = (x.strip("<>") if (x := fields.get(k)) else None for k in ("warc-record-id", "warc-refers-to"))
            yield archive, offset, kind, name, refers, fields.get("warc-target-uri"), fields.get("warc-date"), head, None if kind == "revisit" else len(payload), own, sound, error, payload if payloads else None

    return _parsed(spark, path, rows_of, schema, f"{READ}, payload binary")


PAGE_FIELD = "X-Page-Id"


def page_records(pages: DataFrame, date: str = "19991231235959") -> DataFrame:
    """``pages`` (page_id, url, html) as HTTP responses: version (1 or 2, dealt by a hash), url, ip, date, content_type, block. Null html is an empty payload."""
    rows = pick(pages, "page_id", "url", "html")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    tag = F.coalesce(F.concat(F.lit(f"{PAGE_FIELD}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"), tag, F.lit("\r\n"))
    version = (1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(2))).cast("int")
    return rows.select(version.alias("version"), "url", F.lit("192.0.2.1").alias("ip"), F.lit(date).alias("date"), F.lit("text/html").alias("content_type"), F.concat(head.cast("binary"), payload).alias("block"))


def archived_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages`` written as ARC archives of both versions, converted to WARC archives, which stay, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated rows have a record each; of rows that share payload and smallest page_id one is the response and the others revisit it. A null page_id comes after all
    numbers. A null url or html is an empty one; no pages make no archives and no rows. Extra columns are ignored.
    """
    spark = pages.sparkSession
    base = fresh_path(spark, "archives")
    kind = dict(pages.dtypes)["page_id"]
    records = page_records(pages)
    for version in FIELDS:
        write_arc(records.filter(F.col("version") == version).drop("version"), f"{base}/arc/version{version}", version, archive_bytes)
    convert(spark, f"{base}/arc/*", f"{base}/warc", min_bytes, PAGE_FIELD, archive_bytes)
    remove(spark, f"{base}/arc")

    def ids(heads: pa.Array) -> pa.Array:
        return pa.array([head_field(x.as_py() or b"", PAGE_FIELD) for x in heads], pa.string())

    read = read_warc(spark, f"{base}/warc").filter(F.col("record_type").isin("response", "revisit"))
    read = stash(read.select("record_id", F.col("refers_to").alias("of"), "record_type", "payload_bytes", "payload_digest", F.arrow_udf(ids, "string")(F.col("head")).cast(kind).alias("page_id")), "warc-records")
    uses = read.filter(F.col("of").isNotNull()).groupBy("of").agg(F.count("*").alias("n"))
    known = read.filter(F.col("record_type") == "response").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    joined = uneven_join(read, stash(known.join(uses, "of"), "warc-referred"), "of", uses, read.count())
    return joined.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def oracle(min_bytes: int = 0) -> str:
    """DuckDB SQL for the rows of ``archived_pages`` on the table pages, whose ids do not repeat."""
    group = "('0x' || substr(x, 5 * i + 1, 5))::int"  # twenty bits, four digits
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({group} >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0))
    return f"""with p as (select page_id, coalesce(html, '') as payload from pages),
f as (select page_id, payload, sha1(payload) as x, case when strlen(payload) >= {min_bytes} then min(page_id) over (partition by payload) else page_id end as first from p)
select page_id, strlen(payload)::bigint as payload_bytes, array_to_string(list_transform(range(8), lambda i: {digits}), '') as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from f"""
