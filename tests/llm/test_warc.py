import base64
import gzip
import hashlib
import html.parser
import random
import time

import pytest
from pyspark.sql import functions as F

from driftlog.llm import warc as W

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><!-- hidden --><h1>Head</h1><p>One <b>bold</b> &lt;tag&gt;<br>two<p title="a > b">three</p><ul><li>x</li><li>y</li></ul></body></html>"""


def test_plain_text():
    assert W.plain_text(PAGE) == "Head\nOne bold <tag>\ntwo\nthree\nx\ny"
    assert W.plain_text("") == "" and W.plain_text("<p") == "<p" and W.plain_text("1 < 2 > 0") == "1 < 2 > 0"
    assert W.plain_text("<script>never closed") == "" and W.plain_text("<!-- open") == ""


def test_text_after_what_is_not_closed_stays():
    shown = {
        "<html><head><title>T</title><body><p>Hello": "Hello",
        "<head><title>T</title><p>Hello</head> you": "Hello you",
        "<head><title>T</title>Hello": "Hello",
        "<head><meta charset=x><script>'<p>'</script><title>T</title>\n<h1>Hello": "Hello",
        "<head><title>T</title></head><body>Hello": "Hello",
        "a<svg viewBox='0 0 1 1'/>b": "a b",
        "a<svg/>b<svg><path d='M0'/>no</svg>c": "a b c",
        "a<svg><path d='M0'/>b": "a b",
        "a<template>b<p>c": "a b\nc",
        "a<noscript>b": "a b",
        "a<noscript>no</noscript>b<noscript>c": "a b c",
        "a<style>no": "a",
        "<head><title>T": "T",
    }
    assert {page: W.plain_text(page) for page in shown} == shown
    assert W.plain_text("<template>" * 100_000 + "x") == "x"


@pytest.mark.parametrize("page", ["<script ", '<p "', "<title>", "<title ", "<html ", "<p \"'", "<head ", "<svg '", "<!--", "<a href='x", "</"])
def test_pages_of_unclosed_tags_take_linear_time(page):
    began = time.process_time()
    many = page * ((1 << 20) // len(page))
    W.plain_text(many), W.title_of(many), W._LANG.search(many)
    assert time.process_time() - began < 10


class Plain(html.parser.HTMLParser):
    """The text of simple pages by the standard library's parser."""

    BLOCKS = {"p", "br", "div", "h1", "li", "ul", "html", "body", "head", "title", "td", "tr", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BLOCKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def test_text_equals_that_of_a_plain_parser():
    rng = random.Random(3)
    for _ in range(200):
        parts = ["<html><head><title>T &amp; t</title><style>p{}</style></head><body>"]
        for _ in range(rng.randrange(12)):
            word = rng.choice(["one", "two &lt; three", "é &eacute;", "a\n b", "5 > 4"])
            parts.append(rng.choice([f"<p class='x > y'>{word}</p>", f"<div><b>{word}</b> and</div>", f"{word}<br/>", f"<ul><li>{word}</li></ul>", "<script>var a = '<p>';</script>", f'<a href="/{word}">link</a> ', f"<table><tr><td>{word}</td></tr></table>"]))
        page = "".join(parts) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        assert W.plain_text(page).split() == "".join(plain.out).split()


def test_files_that_are_broken():
    good = W.record("response", [("WARC-Record-ID", "<urn:uuid:1>")], b"one")
    bad = good.replace(b"Content-Length: 3", b"content-length: none")
    assert [h["warc-record-id"] for h, _ in W.records(bad + good.replace(b"WARC-Record-ID", b"warc-record-id"))] == ["<urn:uuid:1>"] * 2
    zipped = gzip.compress(good) + gzip.compress(good)
    assert next(W.records(zipped[:-12]))[1] == b"one"
    assert [*W.records(b"\x1f\x8bnone")] == [] and [*W.records(b"")] == []


def test_http_bodies():
    body = b"h\xc3\xa9llo"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(body)
    status, headers, raw = W.split_http(block)
    assert status == "HTTP/1.1 200 OK" and W.decoded(headers, raw) == body
    assert W.decoded([("Transfer-Encoding", "chunked")], b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert W.decoded([("Content-Encoding", "gzip")], b"broken") == b"broken"
    assert W.characters([("Content-Type", "text/html; charset=latin-1")], b"\xe9") == "é"
    assert W.characters([("Content-Type", "text/html; charset=none-such")], b"a") == "a"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", PAGE, "x"), (2, "http://b/", None, "x"), (3, None, "", "x"), (4, "http://c/", "<p>" + "long " * 100_000, "x"), (1, "http://a/", PAGE, "x"), (None, "http://d/", "plain", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")


def test_records_refer_to_their_response(pages):
    got = W.derivatives(W.responses_of_pages(pages), "page_id").collect()
    assert len(got) == 12 and {r.record_type for r in got} == {"metadata", "conversion"}
    for r in got:
        assert r.content_length == len(r.block) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["metadata"].refers_to == one["conversion"].refers_to and one["metadata"].record_id != one["conversion"].record_id
    assert one["metadata"].payload_digest == W.digest(PAGE.encode()) and one["conversion"].title == "A & B"
    assert b"source-content-type: text/html; charset=utf-8" in one["metadata"].block and "Content-Length: " in one["conversion"].source_headers
    assert len({r.record_id for r in got}) == 10  # the repeated page gives the same records
    assert next(r for r in got if r.page_id == 2 and r.record_type == "conversion").block == b""


def test_files_round_trip(spark, pages, tmp_path):
    found = W.derivatives(W.responses_of_pages(pages.where("page_id = 1").limit(1)), "page_id").cache()
    data = b"".join(r.content for r in W.warc_files(found).collect())
    back = {h["WARC-Type"]: (h, b) for h, b in W.records(data)}
    for r in found.collect():
        h, b = back[r.record_type]
        assert bytes(b) == bytes(r.block) and h["WARC-Refers-To"] == r.refers_to and h["WARC-Target-URI"] == "http://a/" and h["WARC-Payload-Digest"] == r.payload_digest
    response = W.record("response", [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http")], W.http_response(PAGE.encode()))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(W.record("warcinfo", [], b"x")) + gzip.compress(response))
    again = W.derivatives(W.read_responses(spark, str(tmp_path / "a.warc.gz"))).where(F.col("record_type") == "conversion").first()
    assert again.refers_to == "<urn:uuid:1>" and again.warc_date == "2020-01-01T00:00:00Z" and again.block.decode() == W.plain_text(PAGE)


def test_digests_of_the_response_are_kept(spark, tmp_path):
    zipped = gzip.compress(PAGE.encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + zipped
    given = [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Block-Digest", W.digest(block)), ("WARC-Payload-Digest", W.digest(zipped))]
    (tmp_path / "a.warc").write_bytes(W.record("response", given, block) + W.record("response", [("WARC-Record-ID", "<urn:uuid:2>")], block))
    got = {(r.refers_to, r.record_type): r for r in W.derivatives(W.read_responses(spark, str(tmp_path / "a.warc"))).collect()}
    for kind in ("metadata", "conversion"):
        r = got["<urn:uuid:1>", kind]
        assert r.payload_digest == W.digest(zipped) and f"WARC-Payload-Digest: {W.digest(zipped)}".encode() in r.warc
        assert got["<urn:uuid:2>", kind].payload_digest == W.digest(PAGE.encode())
    meta = bytes(got["<urn:uuid:1>", "metadata"].block)
    assert f"source-warc-block-digest: {W.digest(block)}\r\nsource-warc-payload-digest: {W.digest(zipped)}\r\n".encode() in meta
    assert b"source-warc" not in got["<urn:uuid:2>", "metadata"].block


def test_no_pages(pages):
    assert W.derivatives(W.responses_of_pages(pages.limit(0)), "page_id").count() == 0
