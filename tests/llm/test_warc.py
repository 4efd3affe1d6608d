import gzip
import hashlib
import time
import zlib

import pytest

from pyspark.sql import functions as F

from grainflow.llm import warc

PAGE = "<!DOCTYPE html><html lang='de'><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;3</p><script>if (a < b) x('<p>')</script><a href=\"/x?a=1&amp;b=2\">link</a></body></html>"


def test_text_and_links():
    assert warc.plain_text(PAGE) == "A & B\nOne\ntwo <3\nlink"
    meta, text = warc.derive("<urn:uuid:1>", "http://h/", "2024-01-01T00:00:00Z", b"HTTP/1.1 404 Not Found\r\nX-A: b: c\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + PAGE.encode("latin-1"))
    assert "http-status: HTTP/1.1 404 Not Found\r\n" in meta["block"] and "http-header-x-a: b: c\r\n" in meta["block"]
    assert "title: A & B\r\n" in meta["block"] and "language: de\r\n" in meta["block"] and "outlink: /x?a=1&b=2\r\n" in meta["block"]
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>" and meta["record_id"] != text["record_id"]
    assert text["payload_digest"] == warc.digest(PAGE.encode()) and text["block_digest"] == warc.digest(text["block"].encode())
    assert warc.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", PAGE), (2, "http://h/2", ""), (3, None, "text only"), (4, "http://h/4", None), (1, "http://h/1", PAGE), (5, "http://h/5", "<p>" + "long " * 50_000)], "page_id long, url string, html string").withColumn("record_id", F.lit("mine"))
    made = warc.responses(pages, "page_id", "url", "html")
    out = warc.derivatives(made)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == 10 and out.columns[0] == "key"
    assert [r["block"] for r in rows if r["key"] == 2 and r["warc_type"] == "conversion"] == [""]
    stored = b"".join(warc.to_bytes(r) for r in rows)
    back = list(warc.parse(stored))
    assert [b["block"].decode() for b in back] == [r["block"] for r in rows]
    assert [b.get("refers_to") for b in back] == [r["refers_to"] for r in rows] and [b["block_digest"] for b in back] == [r["block_digest"] for r in rows]
    responses = [{"warc_type": "response", "block": bytes(r["block"]), "content_length": len(r["block"]), "content_type": "application/http;msgtype=response", **{k: r[k] for k in ("record_id", "target_uri", "date")}} for r in made.collect() if r["block"] is not None]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.to_bytes, responses)))
    again = warc.derivatives(warc.read_warc(spark, str(tmp_path / "a.warc"))).collect()
    assert sorted(r["record_id"] for r in again) == sorted(r["record_id"] for r in rows)
    assert {(r["record_id"], r["block_digest"], r["payload_digest"]) for r in again} == {(r["record_id"], r["block_digest"], r["payload_digest"]) for r in rows}
    assert warc.derivatives(made.limit(0)).count() == 0


def chunked(data, n=7):
    return b"".join(f"{len(data[i : i + n]):x};x=1\r\n".encode() + data[i : i + n] + b"\r\n" for i in range(0, len(data), n)) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    ("head", "body"),
    [
        ("Content-Encoding: gzip", gzip.compress(PAGE.encode())),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode(), wbits=-15)),
        ("Transfer-Encoding: chunked", chunked(PAGE.encode())),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: x-gzip", chunked(gzip.compress(PAGE.encode()[:90]) + gzip.compress(PAGE.encode()[90:]))),
        ("Content-Encoding: gzip", PAGE.encode()),
        ("Transfer-Encoding: chunked", PAGE.encode()),
        ("Content-Encoding: br", PAGE.encode()),
    ],
)
def test_codings(head, body):
    meta, text = warc.derive("<urn:uuid:1>", None, None, f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body)
    assert text["block"] == warc.plain_text(PAGE) and text["payload_digest"] == warc.digest(body)


def test_markup_without_ends():
    assert warc.plain_text("a < b <b>c</b> <i") == "a < b c <i" and warc.plain_text("x<script>y") == "x" and warc.plain_text("x<!-- y") == "x"
    assert warc.read_page("<title>a<title>b</title>c<title>d</title>").title == "a b" and warc.read_page("<title>a").title is None
    assert warc.plain_text("x<style>y</styles>z</STYLE >w<custom-el>v") == "xwv"
    found = warc.read_page("<html data-lang='x' lang=en><a data-href=1 HREF = y><a href='z w'><a href>")
    assert found.language == "en" and found.links == ["y", "z w"]


@pytest.mark.parametrize("text", ["<title>" * 100_000, "<a" * 100_000, "<a " * 100_000 + ">", "<" * 1_000_000 + ">", "<html lang" * 100_000 + ">", "<script>" * 100_000, "<script></scrip" * 100_000 + "</script", "<!--" * 100_000, "</script" * 100_000 + ">", "<script>" + "</script " * 100_000, "<html lang" + " " * 1_000_000 + ">", "&" * 1_000_000, " \n" * 1_000_000, "<a href=\"" * 100_000 + ">"])
def test_time_is_in_proportion(text):
    began = time.perf_counter()
    warc.derive("<urn:uuid:1>", None, None, text.encode())
    assert time.perf_counter() - began < 5


def test_keys_of_any_type_and_gzipped_files(spark, tmp_path):
    for kind, value in (("smallint", 3), ("decimal(10,0)", 3), ("string", "k"), ("bigint", None)):
        pages = spark.createDataFrame([(PAGE,)], "html string").withColumn("id", F.lit(value).cast(kind)).withColumn("url", F.lit("http://h/"))
        rows = warc.derivatives(warc.responses(pages, "id", "url", "html")).collect()
        assert [str(r["key"]) for r in rows] == [str(value)] * 2
    made = [{"warc_type": "response", "record_id": f"<urn:uuid:{i}>", "content_length": 3, "block": b"abc"} for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.to_bytes(r)) for r in made))
    assert sorted(r["record_id"] for r in warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()) == [r["record_id"] for r in made]


@pytest.mark.parametrize("name", ["x-unknown", "none", "utf8mb4", "hex", "zlib", "rot13", "idna", "punycode", "undefined", "unicode_escape", "utf-16", "a" * 300])
def test_any_charset(name):
    meta, text = warc.derive("r", None, None, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode() + "<p>Café \udcff".encode("utf-8", "surrogatepass"))
    assert text["block"].startswith("Café" if name != "utf-16" else "") and meta["warc_type"] == "metadata"


def test_long_references():
    nines, zeros = "9" * 5000, "0" * 5000
    page = f"<title>a&#{nines};b</title><a href='/x?&#{nines}'>&#{zeros}65;&#x{zeros}42;&#x{nines};&#{nines}&#00000038;lt;</a>"
    meta, text = warc.derive("r", None, None, page.encode())
    assert "title: a�b\r\n" in meta["block"] and "outlink: /x?�\r\n" in meta["block"]
    assert text["block"].splitlines()[-1] == "AB��&lt;"
    assert warc.plain_text("&#55;&#x41;&amp;&#1114112;&#0;") == "7A&��"


def test_broken_files():
    one = warc.to_bytes({"warc_type": "response", "record_id": "<1>", "content_length": 3, "block": b"abc"})
    two = warc.to_bytes({"warc_type": "response", "record_id": "<2>", "content_length": 4, "block": b"defg"})
    ids = lambda data: [(r["record_id"], r["block"]) for r in warc.parse(data)]
    assert ids(one + two) == [("<1>", b"abc"), ("<2>", b"defg")]
    for cut in range(len(two) - 5):
        assert ids(one + two[:cut]) == [("<1>", b"abc")]
    for length in (b"", b"x", b"-3", b"9" * 5000):
        assert ids(one.replace(b"Content-Length: 3", b"Content-Length: " + length) + two) == [("<2>", b"defg")]
    assert ids(one.replace(b"Content-Length: 3\r\n", b"") + two) == [("<2>", b"defg")]
    assert ids(b"") == ids(b"WARC/") == ids(gzip.compress(one)[:30]) == []


def test_query_equals_page_by_page(spark):
    """Every page of the table against the markup read by another parser."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "template", "noscript")
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "template", "noscript")
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in warc.query(spark, sf).collect():
        got.setdefault(r["page_id"], {})[r["warc_type"]] = r
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        words = Words()
        words.feed(p["html"])
        pair = got[p["page_id"]]
        assert pair["conversion"]["block"].split() == "".join(words.out).split()
        for r in pair.values():
            data = r["block"].encode()
            assert r["target_uri"] == p["url"] and r["content_length"] == len(data) and r["block_digest"] == warc.digest(data) and r["payload_digest"] == warc.digest(p["html"].encode())
        assert pair["metadata"]["refers_to"] == pair["conversion"]["refers_to"] and pair["metadata"]["record_id"] != pair["conversion"]["record_id"]
