"""WARC derivatives: from response records to metadata and plain-text conversion records.

Each response gives two records that refer to it: ``metadata`` (source headers
and what the conversion found, as warc-fields) and ``conversion`` (plain text).
Both keep the response's id in WARC-Refers-To, its target and date, and its
payload digest, made from the decoded body only where the response has none; the
metadata also names the response's own digests; each has digests of its own block. Everything is per record:
no shuffle.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html as html_lib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: The date of pages that come without one.
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name-based ids of URLs, RFC 4122

#: What stands in a tag. A `<` outside quotes ends the search for its `>`, so that pages of unclosed tags or quotes take linear time.
_INSIDE = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OPEN = re.compile(rf"<!--|<!\[CDATA\[|<(script|style|noscript|template|svg|head|title|body)\b{_INSIDE}>", re.I)
_END = {name: re.compile(end, re.I) for name, end in [("<!--", "-->"), ("<![cdata[", r"\]\]>"), *((n, rf"</{n}\s*>") for n in ("script", "style", "noscript", "template", "svg", "title"))]}
#: The end tag of a head, or the first tag in it that opens anything of a body.
_HEAD_END = re.compile(r"(</head\s*>)|<(?!(?:base|basefont|bgsound|link|meta|noscript|script|style|template|title)\b)[a-z]", re.I)
#: What takes the rest of the page where its end is missing.
_TO_THE_END = ("<!--", "script", "style")
_BREAK = re.compile(rf"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|figcaption|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b{_INSIDE}>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z!?]{_INSIDE}>|</?[a-zA-Z][^<>]*+>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*+>", re.I), re.compile(r"</title\s*+>", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*+=\s*+[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(rb"charset\s*+=\s*+[\"']?\s*+([\w.:-]+)", re.I)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(name: str) -> str:
    """A record id that is the same for the same name."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def without_hidden(page: str) -> str:
    """The page with a space for each comment and each element that isn't shown.

    Comments, scripts and styles without an end go on to the end of the page; of
    other elements without one only the tag goes, and a self-closed svg is empty.
    A head without an end tag before the first element of the body loses its tag
    and its title.
    """
    out, at, seek, in_head, missing = [], 0, 0, False, set()
    while m := _OPEN.search(page, seek):
        name, seek = (m[1] or m[0]).lower(), m.end()
        end = None
        if name == "body" or (name == "title" and not in_head):
            in_head = in_head and name != "body"
            continue
        if name == "head":
            found = None if name in missing else _HEAD_END.search(page, seek)
            if found is None:
                missing.add(name)
            in_head = not (found and found[1])
            end = None if in_head else found.end()
        elif not (name == "svg" and m[0].endswith("/>")) and name not in missing:
            found = _END[name].search(page, seek)
            if found:
                end = found.end()
            elif name in _TO_THE_END:
                end = len(page)
            else:
                missing.add(name)
        if name == "<![cdata[" and end is None:
            continue
        in_head = in_head and name != "title"
        out += [page[at : m.start()], " "]
        at = seek = seek if end is None else end
    out.append(page[at:])
    return "".join(out)


def plain_text(page: str) -> str:
    """What a page shows: no markup, scripts or styles; a line for each block; entities resolved; spaces folded."""
    text = _TAG.sub("", _BREAK.sub("\n", without_hidden(page)))
    text = html_lib.unescape(text) if "&" in text else text
    return _LINES.sub("\n", _BLANK.sub(" ", text.replace("\r", "\n"))).strip()


def title_of(page: str) -> str:
    """What stands in the first title that ends, as one line."""
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return one_line(html_lib.unescape(_TAG.sub("", page[begin.end() : end.start()]))) if end else ""


def one_line(text: str) -> str:
    return " ".join(text.split())


def http_response(body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; a block that isn't one is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, found, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    headers = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines[1:]) if c]
    return lines[0] if lines else "", headers, body


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without chunks and compression; as it stands where they are broken."""
    get = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in get.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        body = b"".join(out) or body
    try:
        if get.get("content-encoding") in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if get.get("content-encoding") == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def characters(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    m = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:2048])
    try:
        return body.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as bytes; CR and LF in header values are folded."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """Values by name, in whatever case it is written."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def _inflated(data: bytes) -> bytes:
    """Gzipped bytes as far as they can be read."""
    out, src = [], gzip.GzipFile(fileobj=io.BytesIO(data))
    with contextlib.suppress(EOFError, OSError, zlib.error):
        while part := src.read1(1 << 16):
            out.append(part)
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a WARC file, gzipped by record or not.

    What a broken gzip stream still gives is read; a record whose length is no
    number is empty, and the search goes on after its headers.
    """
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = Headers({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)})
        length = headers.get("Content-Length") or ""
        size = int(length) if length.isascii() and length.isdigit() else 0
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, title string, block binary, warc binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _derive(record_id: str, uri: str | None, date: str | None, block: bytes, block_digest: str | None = None, payload_digest: str | None = None) -> list[dict]:
    status, headers, body = split_http(block)
    body = decoded(headers, body)
    page, payload = characters(headers, body), payload_digest or digest(body)
    title = title_of(page)
    text = plain_text(page).encode("utf-8", "replace")
    lang = m[1] if (m := _LANG.search(page)) else ""
    source = "\n".join(f"{k}: {one_line(v)}" for k, v in headers)
    fields = [("title", title), ("language", lang), ("http-status", status), ("source-length", str(len(body))), ("text-length", str(len(text))), *((f"source-{k.lower()}", v) for k, v in headers), ("source-warc-block-digest", block_digest or ""), ("source-warc-payload-digest", payload_digest or "")]
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields if v).encode()
    out = []
    for kind, content, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = named_id(f"{record_id} {kind}")
        heads = [("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri or ""), ("WARC-Date", date or DATE), ("WARC-Block-Digest", digest(data)), ("WARC-Payload-Digest", payload), ("Content-Type", content)]
        out.append({"record_type": kind, "record_id": own, "refers_to": record_id, "target_uri": uri, "warc_date": date or DATE, "content_type": content, "content_length": len(data), "block_digest": digest(data), "payload_digest": payload, "source_headers": source, "title": title, "block": data, "warc": record(kind, [h for h in heads if h[1]], data)})
    return out


def derivatives(responses: DataFrame, key: str = "key") -> DataFrame:
    """Two records for each response of (key, record_id, target_uri, warc_date, block) and, where there are any, (block_digest, payload_digest).

    ``source_headers`` holds the response's HTTP headers, one a line; ``warc``
    the whole record, ready to be written. A null or empty block gives an
    empty text and metadata without title; a null id is named after key and
    target; a null date is DATE. Bytes that aren't UTF-8 become U+FFFD. Repeated rows give repeated records; an empty
    table none. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, keys = [], []
                for r in batch.slice(at, 256).to_pylist():
                    got = _derive(r["record_id"] or named_id(f"{r['key']} {r['target_uri'] or ''}"), r["target_uri"], r["warc_date"], r["block"] or b"", r["block_digest"], r["payload_digest"])
                    rows += got
                    keys += [r["key"]] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([x[f.name] for x in rows], f.type) for f in _ARROW)], [key, *_ARROW.names])

    digests = [F.col(c) if c in responses.columns else F.lit(None).cast("string").alias(c) for c in ("block_digest", "payload_digest")]
    texts = [F.make_valid_utf8(c).alias(c) for c in ("record_id", "target_uri", "warc_date")]
    own = responses.select(responses[key].cast("long").alias("key"), *texts, "block", *digests)
    return own.mapInArrow(run, f"{key} long, {SCHEMA}")


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as response records; the id is named after both and is made in ``derivatives``."""
    html = F.coalesce(pages["html"], F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return pages.select(pages["page_id"].alias("page_id"), F.lit(None).cast("string").alias("record_id"), pages["url"].alias("target_uri"), F.lit(DATE).alias("warc_date"), F.concat(head, html).alias("block"))


def read_responses(spark, path: str) -> DataFrame:
    """Response records of WARC files (``path`` as Spark takes it): (key, record_id, target_uri, warc_date, block, block_digest, payload_digest)."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block", pa.binary()), ("block_digest", pa.string()), ("payload_digest", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                got = [(h, b) for h, b in records(data.as_py()) if h.get("WARC-Type") == "response"]
                cols = [list(range(len(got))), *([h.get(k) for h, _ in got] for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date")), [b for _, b in got], *([h.get(k) for h, _ in got] for k in ("WARC-Block-Digest", "WARC-Payload-Digest"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key long, record_id string, target_uri string, warc_date string, block binary, block_digest string, payload_digest string")


def warc_files(found: DataFrame, per_file: int = 64 << 20) -> DataFrame:
    """The ``warc`` column as the contents of WARC files, gzipped by record: (content), of about ``per_file`` bytes of records each. A task starts a file of its own."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(gzip.compress(data := value.as_py(), 6, mtime=0))
                size += len(data)
                if size >= per_file:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    return found.select("warc").mapInArrow(run, "content binary")
