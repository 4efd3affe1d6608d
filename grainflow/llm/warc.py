"""WARC derivatives: linked metadata and plain-text conversion records from responses.

Every response gives a metadata record (application/warc-fields: what the source's HTTP header and the
page's head say) and a conversion record (text/plain). Both name the response in
WARC-Refers-To, keep its target, date and payload digest, and carry a digest of their own
block. Record ids follow from the response's id, so reruns agree. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StringType

from grainflow.llm.common import as_schema, by_size, short_batches, table, whole_number

VERSION = "WARC/1.1"
# Elements that end a line, and elements whose content isn't shown.
_BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())
_HIDDEN = frozenset("script style template noscript".split())
_NAME = re.compile(r"</?([a-z][a-z0-9]*+)(?![\w-])", re.I)
_LANGUAGE = re.compile(r"(?<![\w-])lang\s*+=\s*+[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++))", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _HIDDEN}
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
#: Numeric character references with more digits than any character needs.
_LONG = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
#: Encodings that Python knows but no web page has.
_NO_CHARSETS = frozenset("idna punycode undefined unicode_escape raw_unicode_escape".split())
#: Headers of a record, in the order in which they are written.
HEADERS = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def unescape(text: str) -> str:
    """Character references replaced. One beyond the last character is U+FFFD, however many digits it has; leading zeros don't count."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"

    return html.unescape(_LONG.sub(short, text) if "&#" in text else text)


@dataclass
class Page:
    """What one pass over a page's markup finds."""

    text: list[str] = field(default_factory=list)  # pieces between tags, with a line feed for each tag that ends a line
    title: str | None = None
    language: str | None = None
    links: list[str] = field(default_factory=list)


def read_page(page: str) -> Page:
    """One forward pass, in time proportional to the page.

    A tag is a `<` before a letter, `/`, `!` or `?`, up to the next `>`; one that never ends is text. A comment
    and the content of a script, style, template or noscript element go, up to their end or the page's. The title is
    what stands between the first title tag that is closed later and its end tag.
    """
    out = Page()
    at, end, opened = 0, -1, None
    while (start := page.find("<", at)) >= 0:
        out.text.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        end = page.find(">", start) if end < start else end
        if end < 0:  # so no later tag ends either
            at = start
            break
        after = page[start + 1 : start + 2]
        if not after or not (after in "/!?" or after.isascii() and after.isalpha()):
            out.text.append("<")
            at = start + 1
            continue
        at = end + 1
        tag = _NAME.match(page, start, end)
        if not tag:
            continue
        name, ends = tag[1].lower(), page[start + 1] == "/"
        if name in _BREAKS:
            out.text.append("\n")
        if name in _HIDDEN and not ends:
            if not (stop := _ENDS[name].search(page, at)) or (end := page.find(">", stop.end())) < 0:
                at = len(page)
                break
            at = end + 1
        elif name == "title":
            if not ends:
                opened = len(out.text) if opened is None else opened
            elif opened is not None and out.title is None:
                out.title = " ".join(unescape("".join(out.text[opened:])).split())
        elif name == "html" and not ends and out.language is None and (found := _LANGUAGE.search(page, tag.end(), end)):
            out.language = found[1]
        elif name == "a" and not ends and (found := _HREF.search(page, tag.end(), end)):
            out.links.append(unescape(found[1] or found[2] or found[3] or ""))
    out.text.append(page[at:])
    return out


def shown(pieces: list[str]) -> str:
    return _LINES.sub("\n", _SPACE.sub(" ", unescape("".join(pieces)))).strip()


def plain_text(page: str) -> str:
    """The text that a page shows: no markup, scripts, styles or comments; block elements end lines."""
    return shown(read_page(page).text)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response; a block with no header is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [x.partition(":") for x in lines]
    return status, [(a.strip(), b.strip()) for a, _, b in pairs], payload


def charset(headers: list[tuple[str, str]]) -> str:
    """The header's charset, if it names an encoding of text that is known here; else utf-8."""
    for name, value in headers:
        if name.lower() == "content-type" and (m := re.search(r"charset\s*+=\s*+[\"']?([\w.:-]+)", value, re.I)):
            try:
                found = codecs.lookup(m[1])
            except (LookupError, ValueError):
                break
            if found._is_text_encoding and found.name.replace("-", "_") not in _NO_CHARSETS:
                return found.name
            break
    return "utf-8"


def decoded(data: bytes, name: str) -> str:
    """Text in this encoding, with U+FFFD for what isn't valid; an encoding that can't do that gives way to utf-8."""
    try:
        return data.decode(name, "replace")
    except ValueError:
        return data.decode("utf-8", "replace")


def unchunked(data: bytes) -> bytes:
    """The content of chunked data; from the first chunk that has no valid size on, as it stands."""
    out, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        size = data[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            break
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out) + data[at:]


def unzipped(data: bytes, kind: str) -> bytes:
    """Gzip members or a deflate stream, decompressed as far as they are sound; other data as it stands."""
    out, rest = [], data
    try:
        while rest:
            stream = zlib.decompressobj(47 if kind == "gzip" or rest[:1] == b"\x78" else -15)
            out.append(stream.decompress(rest) + stream.flush())
            rest = stream.unused_data
    except zlib.error:
        return b"".join(out) or data
    return b"".join(out)


def content(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A payload without its transfer and content codings (chunked, gzip, deflate); with another coding, as it stands."""
    values = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in values.get("transfer-encoding", ""):
        payload = unchunked(payload)
    kind = values.get("content-encoding", "").removeprefix("x-")
    return unzipped(payload, kind) if kind in ("gzip", "deflate") else payload


def derive(record_id: str, target_uri: str | None, date: str | None, block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response with this block. The payload's digest is that of the bytes as stored."""
    status, headers, payload = split_http(block)
    page = read_page(decoded(content(headers, payload), charset(headers)))
    fields = [("http-status", status)] if status else []
    fields += [(f"http-header-{k.lower()}", v) for k, v in headers]
    fields += [("title", page.title)] if page.title is not None else []
    fields += [("language", page.language)] if page.language else []
    fields += [("outlink", x) for x in page.links]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    out = []
    for kind, media, text in (("metadata", "application/warc-fields", lines), ("conversion", "text/plain", shown(page.text))):
        data = text.encode("utf-8", "replace")
        out.append({"warc_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>", "refers_to": record_id, "target_uri": target_uri, "date": date, "content_type": media, "content_length": len(data), "block_digest": digest(data), "payload_digest": digest(payload), "block": data.decode()})
    return out


def to_bytes(record: dict) -> bytes:
    """A record as it stands in a WARC file; absent headers are left out."""
    block = record["block"] if isinstance(record["block"], bytes) else record["block"].encode("utf-8", "replace")
    head = "".join(f"{name}: {record[key]}\r\n" for name, key in HEADERS if record.get(key) is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped. A record without a valid Content-Length is skipped up to the next record's
    first line; one that the file's end cuts short, in its header or its block, is left out."""
    data = unzipped(data, "gzip") if data[:2] == b"\x1f\x8b" else data
    names = {name.lower(): key for name, key in HEADERS}
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0 and (head := data.find(b"\r\n\r\n", start)) >= 0:
        pairs = [x.partition(":") for x in data[start:head].decode("utf-8", "replace").split("\r\n")[1:]]
        record = {names.get(k.strip().lower(), k.strip()): v.strip() for k, _, v in pairs}
        at = head + 4
        if not re.fullmatch(r"[0-9]{1,18}", record.get("content_length", "")):
            continue
        record["content_length"] = int(record["content_length"])
        end = at + record["content_length"]
        if end > len(data):
            return
        record["block"] = data[at:end]
        at = end
        yield record


FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "block")
RESULT = tuple((f, LongType() if f == "content_length" else StringType()) for f in FIELDS)


def responses(pages: DataFrame, key: str, url: str, page: str, first_date: str = "2024-01-01 00:00:00") -> DataFrame:
    """Response records (key, record_id, target_uri, date, block) of stored pages, which have no headers of their own.

    Ids are made from the key and the URL, dates from a key that is a whole number (others have the first date); so rows that repeat
    both are the same record. A null page has a null block.
    """
    number = whole_number(pages.schema[key].dataType)
    md5 = F.md5(F.concat_ws(" ", F.col(key).cast("string"), F.col(url)))
    part = lambda a, n: F.substring(md5, a, n)
    name: Column = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    seconds = F.unix_timestamp(F.lit(first_date)) + (F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(31_536_000)) if number else F.lit(0))
    body = F.encode(F.col(page), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(key).alias("key"),
        F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"),
        F.col(url).alias("target_uri"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def _kernel(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "block", 8_000_000):
                rows = [{"key": r["key"], **d} for r in part.to_pylist() if r["block"] is not None and r["record_id"] is not None for d in derive(r["record_id"], r["target_uri"], r["date"], r["block"])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows (key, warc_type, record_id, refers_to, ...) for every response record.

    `records` has key, record_id, target_uri, date and block (HTTP header and payload, bytes); other
    columns aren't read, and keys may be of any type. Rows with a null id or block give nothing, an empty block gives two records
    with empty blocks, a null target or date stays null and is left out of the written record,
    and repeated rows give repeated records, with the same ids. Chunked, gzipped and deflated payloads are decoded, a broken one as far
    as it is sound; time and memory grow with the size of the decoded page. An unknown charset, or one that isn't an encoding of text, is read as
    utf-8, and what isn't valid becomes U+FFFD, as does a numeric reference beyond the last character.
    """
    short_batches(records.sparkSession)
    result, schema = as_schema(("key", records.schema["key"].dataType), *RESULT)
    return records.select("key", "record_id", "target_uri", "date", "block").mapInArrow(_kernel(schema), result)


def read_warc(spark, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzipped, keyed by record id; a file is one row, so files should be of bounded size (1 GB is usual)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for r in parse(content.as_py()):
                    if r.get("warc_type") == "response":
                        yield pa.RecordBatch.from_pylist([{"key": r.get("record_id"), "record_id": r.get("record_id"), "target_uri": r.get("target_uri"), "date": r.get("date"), "block": r["block"]}], schema=pa.schema([(n, pa.string()) for n in ("key", "record_id", "target_uri", "date")] + [("block", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, record_id string, target_uri string, date string, block binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    pages = table(spark, sf_dir, "pages")
    return derivatives(responses(pages, "page_id", "url", "html")).withColumnRenamed("key", "page_id")
