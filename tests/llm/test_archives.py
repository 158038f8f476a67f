import gzip
import hashlib
import zlib

import pytest

from cases import collected
from graphloom.llm import archives as A


def expected(rows):
    out = []
    for i, _, html in rows:
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        keeper, payload = max(same, default=None), (html or "").encode()
        again = len(payload) >= A.REVISIT_FROM and keeper is not None and i != keeper
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=repr)


def rows():
    big, tricky = "<p>é" + "x" * 1200, "\r\n\r\nWARC/1.0\r\n\r\n" * 200
    out = [(1, "http://a b/ü", big), (2, None, big), (7, "http://c\n", big), (7, "http://c", big), (3, "u", "s"), (4, "u", "s")]
    out += [(5, "u", None), (6, "u", ""), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (9, "u", "y" * 2000), (2, "u", "y" * 2000)]
    return out + [(11, "u", tricky), (12, "u", tricky), (None, "v", None), (None, "v", "z" * 3000), (13, "u", "l" * 3_000_000), (14, "u", "w" * 1000), (15, "u", "w" * 1000), (16, "u", "v" * 999), (17, "u", "v" * 999)]


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows()], "page_id long, url string, html string, digest int, at string")
    for k, size in enumerate((A.ARCHIVE_BYTES, 5000)):
        A.archive_pages(frame, f"{tmp_path}/{k}", size)
        assert collected(A.read_pages(spark, f"{tmp_path}/{k}")) == expected(rows())
    A.archive_pages(frame.limit(0), f"{tmp_path}/none")
    assert A.read_pages(spark, f"{tmp_path}/none").count() == 0


def test_archives_are_warc(spark, tmp_path):
    """A member a record, a warcinfo first, identifiers that every revisit resolves to, digests of what it stands for."""
    frame = spark.createDataFrame(rows(), "page_id long, url string, html string")
    A.archive_pages(frame, str(tmp_path / "a"), 5000)
    records, revisits = {}, []
    for file in sorted((tmp_path / "a").glob("part-*")):
        data, members = file.read_bytes(), []
        while data:
            member = zlib.decompressobj(31)
            members.append(member.decompress(data))
            assert member.eof
            data = member.unused_data
        assert gzip.decompress(file.read_bytes()) == b"".join(members)
        found = [next(A.read_warc(m)) for m in members if m]
        assert [r.headers for r in A.read_warc(file.read_bytes())] == [r.headers for r in found]
        assert [r.kind for r in found].count("warcinfo") == 1 and found[0].kind == "warcinfo"
        records |= {r.headers["WARC-Record-ID"]: r for r in found if r.kind == "response"}
        revisits += [r for r in found if r.kind == "revisit"]
    assert len(revisits) == sum(r[3] == "revisit" for r in expected(rows()))
    for r in revisits:
        original = records[r.headers["WARC-Refers-To"]]
        assert r.headers["WARC-Payload-Digest"] == original.headers["WARC-Payload-Digest"] == A.digest(original.payload)
        assert r.headers["WARC-Refers-To-Target-URI"] == original.headers["WARC-Target-URI"]


def test_revisits_of_nothing_fail(spark, tmp_path):
    big = b"x" * 2000
    lost = [A.page_record(1, "u", big, {"page_id": 2, "url": "u"}), A.page_record(2, "v", big)]
    A.save_archives(spark.createDataFrame([(r,) for r in lost], "record binary"), str(tmp_path / "a"))
    with pytest.raises(Exception, match="this revisit names"):
        A.read_pages(spark, str(tmp_path / "a")).collect()


def test_table(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert collected(A.op7_warc(spark, sf_dir)) == expected(pages)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_archives_become_warc(spark, tmp_path, version):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>\n\n2 0 nobody\n</html>"
    records = [
        A.ArcRecord("http://example.org/", "1.2.3.4", "19961231235959", "text/html", http),
        A.ArcRecord("dns:example.org", "0.0.0.0", "199612", "text/dns", b"example.org. 1 IN A 1.2.3.4\n"),
        A.ArcRecord("http://example.org/empty", "-", "no date", "text/plain", b""),
    ]
    data = A.write_arc(records, version)
    assert [(r.url, r.body, r.version) for r in A.read_arc(data)] == [(r.url, r.body, version) for r in records]
    (tmp_path / "a.arc").write_bytes(data)
    members = data[:200], data[200:]
    (tmp_path / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    found = A.convert_archives(spark, str(tmp_path)).orderBy("target_uri").collect()
    assert [(r.record_type, r.target_uri, r.warc_date) for r in found] == [
        *[("resource", "dns:example.org", "1996-12-01T00:00:00Z")] * 2,
        *[("response", "http://example.org/", "1996-12-31T23:59:59Z")] * 2,
        *[("resource", "http://example.org/empty", "1970-01-01T00:00:00Z")] * 2,
    ]
    assert found[0].record_id == found[1].record_id != found[2].record_id
    assert found[2].payload_digest == A.digest(http.partition(b"\r\n\r\n")[2])
    (made,) = A.read_warc(bytes(found[2].record) + b"\r\n\r\n")
    assert made.block == http and made.headers["WARC-IP-Address"] == "1.2.3.4"


@pytest.mark.parametrize(
    "data",
    [
        b"http://x 0.0.0.0 2000 text/html 3\nabc\n",
        b"filedesc://x 0.0.0.0 2000 text/plain 4\n9 0 \n",
        A.write_arc([A.ArcRecord("u", "", "2000", "t", b"abcdef")], 1)[:-4],
        A.write_arc([], 1) + b"one two\n",
        A.write_arc([], 2) + b"no end of line",
    ],
)
def test_malformed_archives_are_refused(data):
    with pytest.raises(A.ArchiveError):
        list(A.read_arc(data))


def test_urls_with_spaces_are_read():
    data = A.write_arc([], 1) + b"http://a b c 1.1.1.1 2000 text/html 2\nhi\n"
    assert [(r.url, r.body) for r in A.read_arc(data)] == [("http://a b c", b"hi")]
