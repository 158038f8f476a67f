"""Legacy ARC archives to WARC: version-specific header lines, declared lengths, synthesised WARC records.

An ARC archive begins with a version block, whose second line names the version and whose third lists the fields of each
record's header line: five of them in version 1, ten in version 2. A record's body has the length that its line declares;
nothing else delimits it. The converter gives each record what WARC asks for besides: an identifier (the same one for the
same record at every run), an ISO timestamp, a type and digests.

WARC archives begin with a warcinfo record and hold a gzip member for each record, so that any of them can be read from its
offset. Spark's text writer writes them, a member a row, so retried tasks leave no half-written archive; its row separator
is an empty gzip member, which adds nothing to the text. Archives are bounded in bytes and read as a whole, each by one task,
again by declared lengths alone. A revisit names the WARC-Record-ID of the response that has its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, map_rows, shared_dir, table

#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
#: Bytes of records in an archive, about.
ARCHIVE_BYTES = 32 << 20
#: Namespace of the record identifiers.
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
_END = b"\r\n\r\n"
#: Ways that the rows of null ids with one payload are dealt out.
_SPREAD = 32
#: Field names of the header line by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ),
}


class ArchiveError(ValueError):
    """Bytes that are not what the archive declares."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    version: int = 1
    extra: dict[str, str] = field(default_factory=dict)


@dataclass
class WarcRecord:
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP headers; the block itself where it holds none."""
        if not self.headers.get("Content-Type", "").startswith("application/http"):
            return self.block
        head, mark, rest = self.block.partition(_END)
        return rest if mark else b""


def _plain(value: str | None) -> str:
    """A header line field: no white space, never empty."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "") or "-"


def write_arc(records: list[ArcRecord], version: int, name: str = "archive.arc", date: str = "20000101000000") -> bytes:
    """An ARC archive of one version: its version block, then the records."""
    about = f"{version} 0 legacy\n{' '.join(ARC_FIELDS[version])}\n".encode()
    more = " 200 - - 0 -" if version == 2 else ""
    out = [f"filedesc://{_plain(name)} 0.0.0.0 {date} text/plain{more} {len(about)}\n".encode() + about]
    at = len(out[0]) + 1
    for r in records:
        line = [_plain(r.url), r.ip or "0.0.0.0", _plain(r.date), _plain(r.content_type)]
        if version == 2:
            line += [r.extra.get("Result-code", "200"), r.extra.get("Checksum", "-"), _plain(r.extra.get("Location")), str(at), _plain(name)]
        out.append((" ".join([*line, str(len(r.body))]) + "\n").encode() + r.body)
        at += len(out[-1]) + 1
    return b"\n".join(out) + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive (plain or gzip), without its version block."""
    data = _plain_bytes(data)
    at, fields, version = 0, None, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no end of the header line at byte {at}")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        at = end + 1
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ArchiveError("an ARC archive begins with its version block")
            size = _length(line.split(" ")[-1], at, data)
            about = data[at : at + size].decode("utf-8", "replace").split("\n")
            version = int(about[0].split(" ")[0]) if about[0][:1].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ArchiveError(f"unknown ARC version: {about[0]!r}")
            fields = ARC_FIELDS[version]
            at += size
            continue
        # a URL with spaces in it was never legal, yet occurs: all surplus fields are its
        parts = line.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ArchiveError(f"{len(parts)} fields in a header line of version {version}")
        named = dict(zip(fields, parts))
        size = _length(named["Archive-length"], at, data)
        known = {"URL", "IP-address", "Archive-date", "Content-type", "Archive-length"}
        extra = {k: v for k, v in named.items() if k not in known}
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], data[at : at + size], version, extra)
        at += size


def _length(text: str, at: int, data: bytes) -> int:
    if not text.isdigit() or at + int(text) > len(data):
        raise ArchiveError(f"a declared length of {text!r} at byte {at} of {len(data)}")
    return int(text)


def _plain_bytes(data: bytes) -> bytes:
    """The bytes of a gzip file of any number of members, or the data itself."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):  # in pieces, as what follows a member is copied
            piece = data[at : at + 16_384]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if not member.eof:
            raise ArchiveError(f"no end of the gzip member before byte {at}")
    return b"".join(out)


def gzip_member(data: bytes) -> bytes:
    """The same bytes at every run."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter date of version 1, as WARC writes it; impossible ones become the first of 1970."""
    digits = date if date.isdigit() else ""
    digits = digits[:14] + "19700101000000"[len(digits[:14]) :] if len(digits) >= 4 else "19700101000000"
    y, mo, d, h, mi, s = digits[:4], *(digits[k : k + 2] for k in range(4, 14, 2))
    if not (1 <= int(mo) <= 12 and 1 <= int(d) <= 31 and int(h) < 24 and int(mi) < 60 and int(s) < 61):
        return "1970-01-01T00:00:00Z"
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def to_warc(record: ArcRecord, identity: str = "") -> WarcRecord:
    """The equivalent WARC record: a response if the body is an HTTP message, else a resource.

    The identifier depends on URL, date, body and ``identity`` alone.
    """
    is_http = record.body[:5] == b"HTTP/"
    name = "\0".join([record.url, record.date, hashlib.sha1(record.body).hexdigest(), identity])
    headers = {
        "WARC-Type": "response" if is_http else "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>",
        "WARC-Date": iso_date(record.date),
        "WARC-Target-URI": record.url,
    }
    if record.ip not in ("", "-", "0.0.0.0"):
        headers["WARC-IP-Address"] = record.ip
    made = WarcRecord(headers["WARC-Type"], headers, record.body)
    headers["Content-Type"] = "application/http; msgtype=response" if is_http else record.content_type
    headers["WARC-Block-Digest"] = digest(record.body)
    headers["WARC-Payload-Digest"] = digest(made.payload)
    return made


def warcinfo(name: str) -> WarcRecord:
    """The record that an archive begins with."""
    block = b"software: graphloom\r\nformat: WARC File Format 1.0\r\n"
    headers = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>",
        "WARC-Date": "2000-01-01T00:00:00Z",
        "Content-Type": "application/warc-fields",
        "WARC-Block-Digest": digest(block),
    }
    return WarcRecord("warcinfo", headers, block)


def as_revisit(record: WarcRecord, original: WarcRecord) -> WarcRecord:
    """The record without its payload, naming the one that has it; the HTTP headers stay."""
    head, _, _ = record.block.partition(_END)
    block = head + _END
    headers = record.headers | {
        "WARC-Type": "revisit",
        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        "WARC-Refers-To": original.headers["WARC-Record-ID"],
        "WARC-Refers-To-Target-URI": original.headers["WARC-Target-URI"],
        "WARC-Refers-To-Date": original.headers["WARC-Date"],
        "WARC-Block-Digest": digest(block),
    }
    return WarcRecord("revisit", headers, block)


def write_record(record: WarcRecord) -> bytes:
    """One record without the two blank lines that end it."""
    lines = [f"{k}: {v}" for k, v in record.headers.items()] + [f"Content-Length: {len(record.block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines)).encode("utf-8", "surrogateescape") + _END + record.block


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC archive (plain or gzip), found by declared lengths."""
    data = _plain_bytes(data)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ArchiveError(f"no WARC record at byte {at}")
        end = data.find(_END, at)
        if end < 0:
            raise ArchiveError(f"no end of the headers at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = _length(headers.pop("Content-Length", ""), end + 4, data)
        yield WarcRecord(headers.get("WARC-Type", ""), headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size
        if data[at : at + 4] != _END:
            raise ArchiveError(f"no end of the record at byte {at}")
        at += 4


# --- on Spark


def _archive_batches(function: Callable[[bytes], Iterator[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for row in function(data.as_py()):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``content`` of each archive under ``path``: any place that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def convert_archives(spark: SparkSession, path: str) -> DataFrame:
    """WARC records (type, target_uri, date, record_id, payload_digest, record: bytes) of all ARC archives under a path.

    A malformed archive fails the query and says where it stops making sense; an archive without records gives no rows.
    """
    names = [("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()), ("payload_digest", pa.string()), ("record", pa.binary())]

    def rows(data: bytes) -> Iterator[tuple]:
        for r in map(to_warc, read_arc(data)):
            h = r.headers
            yield r.kind, h["WARC-Target-URI"].encode("utf-8", "replace").decode(), h["WARC-Date"], h["WARC-Record-ID"], h["WARC-Payload-Digest"], write_record(r)

    schema = "record_type string, target_uri string, warc_date string, record_id string, payload_digest string, record binary"
    return map_rows(archive_files(spark, path), _archive_batches(rows, pa.schema(names)), schema)


def save_archives(records: DataFrame, path: str) -> None:
    """Write ``record`` (bytes) rows as WARC archives, one a partition, each behind a warcinfo record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"archive {TaskContext.get().partitionId()}"
        for k, batch in enumerate(b for b in batches if b.num_rows):
            rows = batch.column(0).to_pylist()
            if k == 0:
                rows = [write_record(warcinfo(name)), *rows]
            yield pa.RecordBatch.from_arrays([pa.array([gzip_member(r + _END) for r in rows], pa.binary())], ["record"])

    rows = map_rows(records.select("record"), run, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", gzip_member(b"").decode("latin-1")).text(path)


def _page(page_id: int | None, url: str | None, html: bytes) -> WarcRecord:
    """A page as the crawler of its time would have stored it, in an ARC archive of either version, converted to WARC."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    old = ArcRecord(url or "-", "0.0.0.0", "20000101000000", "text/html", http + html)
    (arc,) = read_arc(write_arc([old], 1 if (page_id or 0) % 2 else 2))
    made = to_warc(arc, "" if page_id is None else str(page_id))
    if page_id is not None:
        made.headers["WARC-Page-ID"] = str(page_id)
    return made


def page_record(page_id: int | None, url: str | None, html: bytes, keeper: Mapping | None = None) -> bytes:
    """The record of a page; a revisit if its payload is that of ``keeper`` (page_id, url)."""
    made = _page(page_id, url, html)
    return write_record(as_revisit(made, _page(keeper["page_id"], keeper["url"], html)) if keeper else made)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page of the archives under ``path``.

    A revisit is resolved by the identifier that it names; one that names no response of these archives with its payload's
    digest and size fails the query.
    """
    names = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("original", pa.string())]

    def rows(data: bytes) -> Iterator[tuple]:
        for r in read_warc(data):
            h = r.headers
            if r.kind == "warcinfo":
                continue
            if r.kind == "revisit":
                size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", r.block)[1])
            else:
                size = len(r.payload)
                if digest(r.payload) != h["WARC-Payload-Digest"]:
                    raise ArchiveError(f"{h['WARC-Record-ID']}: the payload is not the one that was written")
            sha1 = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            yield int(h["WARC-Page-ID"]) if "WARC-Page-ID" in h else None, size, sha1, r.kind, h["WARC-Record-ID"], h.get("WARC-Refers-To")

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, original string"
    found = cut(map_rows(archive_files(spark, path), _archive_batches(rows, pa.schema(names)), schema))
    asked = found.where("original IS NOT NULL").select("original").distinct()
    originals = found.where("record_type = 'response'").join(asked.withColumnRenamed("original", "record_id"), "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("original")).agg(F.max("page_id").alias("refers_to"), F.max("payload_digest").alias("d"), F.max("payload_bytes").alias("n"))
    joined = found.join(originals, "original", "left")
    sound = (F.col("d") == F.col("payload_digest")) & (F.col("n") == F.col("payload_bytes"))
    broken = F.raise_error(F.concat(F.lit("no response is what this revisit names: "), "record_id")).cast("long")
    refers = F.when(F.col("record_type") != "revisit", F.lit(None)).when(sound, F.col("refers_to")).otherwise(broken)
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html) into archives under ``path``.

    Of equal payloads of at least ``REVISIT_FROM`` bytes, that with the largest page_id is a response and the others
    revisit it; rows that repeat this id are responses too, and so are null ids among themselves. A null html is an empty
    payload, a null url is written as "-"; other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    large = rows.where(F.length("html") >= REVISIT_FROM).select("page_id", "url", "digest")
    classes = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper.page_id IS NOT NULL").drop("n")
    # a page that is repeated with different payloads may revisit several pages, each under its payload's digest
    revisits = large.join(classes, "digest").where("NOT page_id <=> keeper.page_id").select("page_id", "digest", "keeper").distinct()
    total = rows.agg(F.sum(F.length("html") + F.lit(600))).first()[0] or 0
    pieces = max(2, -(-total // archive_bytes))
    # null ids are dealt out by payload and address, else they would meet in one archive
    at = lambda salt: F.coalesce(F.col("page_id"), F.xxhash64("digest", salt)).alias("at")
    left = rows.select("*", at(F.pmod(F.xxhash64("url"), F.lit(_SPREAD))))
    salts = F.explode(F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(_SPREAD - 1))).otherwise(F.array(F.lit(0))))
    right = revisits.withColumn("salt", salts).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keeper", at(F.col("salt").cast("long")))
    left, right = left.repartition(pieces, "at"), right.repartition(pieces, "at")
    here = (left["at"] == right["at"]) & left["page_id"].eqNullSafe(right["p"]) & (left["digest"] == right["d"])
    joined = left.join(right, here, "left").select("page_id", "url", "html", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [page_record(*row) for row in zip(*(batch.column(n).to_pylist() for n in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    save_archives(map_rows(joined, run, "record binary"), path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
