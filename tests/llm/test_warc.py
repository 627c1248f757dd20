"""WARC records: what goes in comes out again, and derivatives hold what their response says."""

import base64
import gzip
import hashlib

from quillon.llm import queries, warc

PAGE = "<html lang='fr'><head><title>A &amp; B</title></head><body><p>Bonjour é</p><a href='/x?a=1&amp;b=2'>x</a><a href=\"http://o/y\">y</a><a href='/x?a=1&amp;b=2'>again</a></body></html>"


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(block):
    return [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]


def test_records_round_trip():
    made = [warc.make_record([("WARC-Type", t), ("X", "a\r\nb")], b) for t, b in (("response", b"one\r\n\r\ntwo"), ("request", b""), ("response", b"\x00\xff"))]
    got = list(warc.parse_records(b"".join(made)))
    assert [(h["WARC-Type"], h["X"], b, whole) for h, b, whole in got] == [("response", "a b", b"one\r\n\r\ntwo", True), ("request", "a b", b"", True), ("response", "a b", b"\x00\xff", True)]
    assert list(warc.parse_records(b"no record")) == [] == list(warc.parse_records(b"WARC/1.1\r\nX: y"))


def test_derivatives_of_a_page():
    (d,) = warc.derive(warc.response_record(7, "http://h/p/", PAGE, "2024-01-01T00:00:00Z"))
    body = PAGE.encode()
    assert (d["url"], d["payload_digest"], d["digest_valid"], d["complete"], d["text"]) == ("http://h/p/", sha(body), True, True, "Bonjour é\nxyagain".replace("é\nx", "é\nx"))
    for kind, content in (("metadata", "application/warc-fields"), ("conversion", "text/plain; charset=utf-8")):
        (head, block, whole), = warc.parse_records(d[kind])
        assert whole and head["WARC-Type"] == kind and head["Content-Type"] == content
        assert head["WARC-Refers-To"] == d["response_id"] and head["WARC-Record-ID"] == d[f"{kind}_id"] and head["WARC-Date"] == "2024-01-01T00:00:00Z"
        assert head["WARC-Target-URI"] == "http://h/p/" and head["WARC-Source-Payload-Digest"] == sha(body) and head["WARC-Block-Digest"] == sha(block) == d[f"{kind}_digest"]
    assert next(warc.parse_records(d["conversion"]))[1].decode() == d["text"]
    told = fields(next(warc.parse_records(d["metadata"]))[1])
    assert told == [("status", "HTTP/1.1 200 OK"), ("http-content-type", "text/html; charset=utf-8"), ("http-content-length", str(len(body))), ("charset", "utf-8"), ("title", "A & B"), ("language", "fr"), ("outlink", "http://h/x?a=1&b=2"), ("outlink", "http://o/y")]
    assert d["n_links"] == 2


def response(body, head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html", **more):
    block = head + b"\r\n\r\n" + body
    return warc.make_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), *more.items()], block)


def test_digests_and_cut_blocks():
    assert next(warc.derive(response(b"x")))["digest_valid"] is None
    assert next(warc.derive(response(b"x", **{"WARC-Payload-Digest": "md5:abc"})))["digest_valid"] is None
    assert next(warc.derive(response(b"x", **{"WARC-Payload-Digest": sha(b"x")})))["digest_valid"] is True
    assert next(warc.derive(response(b"x", **{"WARC-Payload-Digest": sha(b"y")})))["digest_valid"] is False
    whole = response(b"some words")
    assert [d["complete"] for d in warc.derive(whole)] == [True] and [d["complete"] for d in warc.derive(whole[:-8])] == [False]


def test_charset_is_found_however_late_it_stands():
    page = b"<html><!-- " + b"x" * 5000 + b" --><head><meta charset='iso-8859-1'></head><p>caf\xe9</p>"
    assert next(warc.derive(response(page)))["text"].endswith("café")
    assert next(warc.derive(response(b"<p>caf\xe9", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1")))["text"] == "café"
    assert next(warc.derive(response("<p>é".encode(), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nosuch")))["text"] == "é"


def test_rows_and_files(spark, tmp_path):
    rows = [(1, "http://h/", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "http://h/", "word " * 400_000, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, record string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.n_links, r.digest_valid, len(r.text)) for r in queries.QUERIES["op7_warc_derivatives"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, True, len("Bonjour é\nxyagain")), (2, 0, True, 0), (None, 0, True, 0), (3, 0, True, 5 * 400_000 - 1)}
    two = response(b"one") + warc.make_record([("WARC-Type", "request")], b"") + response(b"two")
    records = spark.createDataFrame([(1, bytearray(two), 5), (2, None, 5), (3, bytearray(b"junk"), 5)], "id int, record binary, text int")
    found = warc.derivatives(records)
    assert sorted((r.id, r.text) for r in found.collect()) == [(1, "one"), (1, "two")]
    for name, codec in (("plain", "none"), ("packed", "gzip")):
        warc.write_warc(found, str(tmp_path / name), "conversion", codec)
        files = sorted((tmp_path / name).glob("part-*"))
        data = b"".join(gzip.decompress(f.read_bytes()) if codec == "gzip" else f.read_bytes() for f in files)
        assert sorted(b for _, b, _ in warc.parse_records(data)) == [b"one", b"two"]
