import base64
import hashlib

import pytest

from semilattice.llm import warc

SCHEMA = "page_id long, url string, html string, payload_bytes string, record_type string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_arc_versions():
    one = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\n1 0 x\n</p>"
    two = b"plain\nbytes\xff"
    for v in (1, 2):
        data = warc.arc_version_block(v, "f", "20010203040506") + warc.arc_record(v, "http://a/b c", "20010203040506", "text/html", one) + warc.arc_record(v, "dns:x", "1999", "text/dns", two) + warc.arc_record(v, "http://e/", "20010203040506", "x/y", b"")
        a, b, c = warc.read_arc(data)
        assert (a.version, a.url, a.date, a.payload, a.block) == (v, "http://a/b%20c", "20010203040506", b"<p>\n\n1 0 x\n</p>", one)
        assert (b.http, b.payload, c.block) == (False, two, b"")
        out = warc.convert(a, None) + b"\r\n\r\n" + warc.convert(b, None) + b"\r\n\r\n" + warc.convert(c, ("<urn:uuid:1>", "u", "d"))
        (h, x), (g, y), (r, z) = warc.read_warc(out)
        assert (h["warc-type"], h["warc-date"], h["warc-payload-digest"], x) == ("response", "2001-02-03T04:05:06Z", "sha1:" + digest(a.payload), one)
        assert (g["warc-type"], g["content-type"], g["warc-date"], y) == ("resource", "text/dns", "1999-01-01T00:00:00Z", two)
        assert (r["warc-type"], r["warc-refers-to"], z) == ("revisit", "<urn:uuid:1>", b"")
        assert h["warc-record-id"] == warc.record_id(a, "") != warc.record_id(b, "")


@pytest.mark.parametrize("broken", [b"http://x 0.0.0.0 1 t 3\nabc\n", warc.arc_version_block(1, "f", "1")[:-10], warc.arc_version_block(1, "f", "1") + b"http://x 0.0.0.0 1 t 30\nabc\n", warc.arc_version_block(1, "f", "1") + b"two fields\n", b"filedesc://f 0.0.0.0 1 t 8\n7 0 abcd\n\n"])
def test_bad_archives_are_named(broken):
    with pytest.raises(ValueError):
        list(warc.read_arc(broken, "f"))


def test_a_wrong_digest_is_noticed():
    r = warc.warc_record([("WARC-Type", "resource"), ("WARC-Block-Digest", "sha1:AAAA")], b"x")
    with pytest.raises(ValueError):
        list(warc.read_warc(r))


def brute(rows, least):
    first = {}
    for i, h in rows:
        k = (h or "").encode()
        if i is not None:
            first[k] = min(first.get(k, i), i)
    out = []
    for i, h in rows:
        k = (h or "").encode()
        same = len(k) >= least and i is not None and first[k] != i
        out.append((i, len(k), digest(k), "revisit" if same else "response", first[k] if same else None))
    return out


@pytest.mark.parametrize("version,least,size", [(1, 0, 1 << 20), (2, 10, 500)])
def test_pages_equal_brute_force(spark, monkeypatch, version, least, size):
    monkeypatch.setattr(warc.write_arc, "__defaults__", (1, "20000101000000", size))
    html = [None, "", "<p>a</p>", "filedesc://x 0 0 0 0\n", "\r\n\r\nWARC/1.0\r\n", "é漢\x00\n" * 400, "b" * 100_000]
    rows = [(i, html[i % len(html)] if i % 3 else f"page {i}") for i in range(60)] + [(100 + i, "same " * 9) for i in range(300)]
    df = spark.createDataFrame([(i, None if (i or 0) % 5 == 0 else f"http://h/ {i}?é", h, "x", "y") for i, h in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in warc.archive_pages(spark, df, least, version).collect())
    assert got == sorted(brute(rows, least))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "u", "one", "", ""), (5, "u", "one", "", ""), (5, "u", "one", "", ""), (9, "u", "two", "", ""), (None, None, "three", "", "")], SCHEMA)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(spark, df).collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (5, "revisit", 5), (9, "response", None), (None, "response", None)], key=str)


def test_empty(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0
