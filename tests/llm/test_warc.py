import base64
import gzip
import hashlib

import pytest

from cohortlens.llm import warc
from cohortlens.session import scratch_path


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    html = "<p>é \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(5, "http://a/5", html), (3, "http://a/3", html), (9, "http://a/9", html), (1, None, None), (2, "http://a/2", ""), (4, "x\r\ny", "short"), (4, "x\r\ny", "short"), (None, "http://n", html), (None, "http://m", "lone"), (7, "http://a/7", "z" * 200_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")


def test_round_trip(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path).collect()
    assert sorted(r.record_type for r in records) == sorted(["request", "metadata"] * 10 + ["response"] * 6 + ["revisit"] * 4)
    rows = warc.captures(warc.read_archives(spark, path)).collect()
    assert len(rows) == 10
    html = pages.where("page_id = 5").first().html
    got = {}
    for r in rows:
        page = r.metadata[0].fields["page-id"]
        got.setdefault(page, []).append(r)
        assert len(r.requests) == 1 and len(r.metadata) == 1
        if r.capture.record_type == "revisit":
            assert r.capture.payload_bytes == 0 and r.origin.capture.payload_digest == "".join(r.capture.target_uri and r.origin.capture.payload_digest)
    assert got["3"][0].capture.record_type == "response" and bytes(got["3"][0].capture.payload).decode() == html
    for page in ("5", "9"):
        assert got[page][0].capture.record_type == "revisit"
        assert got[page][0].origin.metadata[0].fields["page-id"] == "3"
        assert (got[page][0].origin.capture.payload_bytes, got[page][0].origin.capture.payload_digest) == (len(html.encode()), sha(html))
    assert got["2"][0].origin.metadata[0].fields["page-id"] == "1" and got["1"][0].capture.payload_digest == sha("")
    assert [r.capture.record_type for r in got["4"]] == ["response"] * 2
    assert sorted(r.capture.record_type for r in got[""]) == ["response", "revisit"]


def test_least_payload(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path, least=10)
    kinds = {(r.metadata[0].fields["page-id"], r.capture.record_type) for r in warc.captures(warc.read_archives(spark, path)).collect()}
    assert ("2", "response") in kinds and ("5", "revisit") in kinds


def test_gzip_and_broken_files(spark, tmp_path):
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(body) + gzip.compress(body))
    (tmp_path / "b.warc").write_bytes(body + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in rows) == ["response"] * 3 + ["unreadable"]
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {b"hi"}


def test_records_after_a_broken_one_are_read(spark, tmp_path):
    record = lambda i, size: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Type: application/http\r\nContent-Length: {size}\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(record(1, 27) + record(2, 9_999_999) + b"junk without a header\r\n" + record(3, 27) + record(4, "x") + record(5, 27))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r.record_type, r.record_id) for r in rows] == [("response", "urn:uuid:1"), ("unreadable", None), ("response", "urn:uuid:3"), ("unreadable", None), ("response", "urn:uuid:5")]
    assert rows[1].at == len(record(1, 27))


def test_empty(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.captures(warc.read_archives(spark, path)).count() == 0
