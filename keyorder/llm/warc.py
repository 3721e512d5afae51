"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is its exact bytes, which may be one gzip member.  Each response gives
two records that refer to it: ``metadata`` (JSON of the record's and the HTTP
message's headers, a list of values where a name repeats, the page's title, meta
tags and links) and ``conversion`` (its text).  Both carry the source's target,
date and payload digest; their own blocks have digests too.  Chunked, gzip,
deflate and zstd bodies are unpacked before they are read; digests are those of
the bytes as stored.

A null page is an empty payload; a null address leaves out its header.  Null and
empty records, records of another type, broken ones and bodies that can't be
unpacked (or would exceed ``MAX_BODY_BYTES``) give a metadata record that says
so and an empty conversion.  Repeated rows give repeated records, an empty table
none.  Only the named columns are read, whatever others are called.  Markup is
read in one pass whose time is linear in the page, however broken it is; as in
browsers, a tag that never ends swallows the rest of the page.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import slices

CHUNK_BYTES = 2 << 20
VERSION = b"WARC/1.1"
#: Date of records made from a table that has none.
DATE = "1970-01-01T00:00:00Z"

# Elements that begin a new line of text, and those whose content isn't text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title "
    "tr ul".split()
)
HIDDEN = frozenset("script style template noscript".split())

# Charsets that pages on the web may name, as Python calls them.
CHARSETS = frozenset(
    "utf-8 utf-16 utf-16-le utf-16-be ascii iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 "
    "iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 cp866 cp874 "
    "koi8-r koi8-u mac-roman mac-cyrillic gb2312 gbk gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis cp932 euc_kr cp949".split()
)
#: Bytes that an unpacked body may have.
MAX_BODY_BYTES = 1 << 28

_NAME = re.compile(r"[a-z][a-z0-9:-]*", re.IGNORECASE)
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_EQUALS = re.compile(r"\s*=\s*")
_SPACE = re.compile(r"[ \t\r\f\v]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    """The same for the same content: a task that runs again makes the same records."""
    digest = bytearray(hashlib.sha1(b"\0".join(parts)).digest()[:16])
    digest[6] = digest[6] & 0x0F | 0x50
    digest[8] = digest[8] & 0x3F | 0x80
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(digest))}>"


def _clean(value: str) -> str:
    """A header's value is one line."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in data.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _values(pairs: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """The value of each name; a list of them, in order, where the name repeats."""
    found: dict[str, list[str]] = {}
    for name, value in pairs:
        found.setdefault(name, []).append(value)
    return {name: values if len(values) > 1 else values[0] for name, values in found.items()}


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record."""
    if record[:2] == b"\x1f\x8b":
        record = _inflated(record, 31)
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(head.partition(b"\r\n")[2])
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("the record's length is missing or wrong")
    return headers, rest[: int(length)]


def response(url: str | None, page: str | None, key: bytes = b"", date: str = DATE) -> bytes:
    """A response record of a page as it was served."""
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(b"response", key, (url or "").encode(), block)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return build(headers, block)


def _tag(page: str, at: int) -> tuple[int, dict[str, str]]:
    """(end, attributes) of a tag whose name ends at ``at``; the end of the page if it has none."""
    attributes: dict[str, str] = {}
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page):
            return at, attributes
        if page[at] == ">":
            return at + 1, attributes
        m = _ATTRIBUTE.match(page, at)
        name, at = m[1].lower(), m.end()
        value = next((v for v in m.groups()[1:] if v is not None), None)
        if value is None:
            begun = _EQUALS.match(page, at)
            at = begun.end() if begun else at
            if begun and page[at : at + 1] in ("'", '"'):  # a quotation that never ends
                return len(page), attributes
        attributes.setdefault(name, html.unescape(value or ""))


def _after_hidden(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
    return len(page) if end is None else _tag(page, end.end())[0]


def markup(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(text before it, name, attributes) of each tag; names of closing tags begin with "/", the last piece has none."""
    begun = at = 0  # where the text that is still to be given begins, and where to look for a tag
    while (at := page.find("<", at)) >= 0:
        start, mark = at, page[at + 1 : at + 2]
        named = _NAME.match(page, at + 1 + (mark == "/"))
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            yield page[begun:start], "", {}
        elif named:
            name = named[0].lower()
            at, attributes = _tag(page, named.end())
            if mark != "/" and name in HIDDEN:
                at = _after_hidden(page, name, at)
            yield page[begun:start], f"/{name}" if mark == "/" else name, attributes
        elif mark and mark in "!?/":
            end = page.find(">", at + 2)
            at = len(page) if end < 0 else end + 1
            yield page[begun:start], "", {}
        else:  # a sign like any other
            at += 1
            continue
        begun = at
    yield page[begun:], "", {}


def read_html(page: str) -> dict:
    """Text, title, meta tags and links of a page, in one pass over its markup."""
    text: list[str] = []
    links: list[dict] = []
    meta: list[tuple[str, str]] = []
    title: list[str] = []
    in_title, link = False, None
    for said, name, attributes in markup(page):
        if said:
            (title if in_title else text).append(said)
            if link is not None:
                link["text"].append(said)
        closing, bare = name.startswith("/"), name.lstrip("/")
        if bare in BLOCKS:
            text.append("\n")
        if bare == "title":
            in_title = not closing
        elif bare == "a":
            link = None
            if not closing and (url := attributes.get("href")) is not None:
                link = {"path": "A@/href", "url": url, "text": []}
                links.append(link)
        elif bare in ("img", "link", "iframe") and not closing:
            for a in ("src", "href"):
                if a in attributes:
                    links.append({"path": f"{bare.upper()}@/{a}", "url": attributes[a]})
        elif bare == "meta" and not closing:
            if (key := attributes.get("name") or attributes.get("property") or ("charset" if "charset" in attributes else None)) is not None:
                meta.append((key, attributes.get("content", attributes.get("charset", ""))))
    for x in links:
        if "text" in x:
            x["text"] = _SPACE.sub(" ", html.unescape("".join(x["text"])).replace("\n", " ")).strip()
    head = " ".join(html.unescape("".join(title)).split())
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape("".join(text)).split("\n"))
    body = "\n".join(line for line in lines if line)
    return {"title": head, "meta": _values(meta), "links": links, "text": "\n".join(x for x in (head, body) if x)}


def _named(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def _charset(headers: list[tuple[str, str]]) -> str:
    found = re.search(r"charset=[\"']?([\w-]+)", _named(headers, "content-type"), re.IGNORECASE | re.ASCII)
    try:
        name = codecs.lookup(found[1]).name if found else "utf-8"
    except LookupError:
        return "utf-8"
    return name if name in CHARSETS else "utf-8"


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,12}", size):
            raise ValueError("a chunk of the body has no size")
        n, at = int(size, 16), line + 2
        if not n:
            return b"".join(out)
        if at + n > len(body):
            raise ValueError("the last chunk of the body is cut off")
        out.append(body[at : at + n])
        at += n + 2


def _inflated(data: bytes, window: int) -> bytes:
    """All members of a gzip body, or a deflate one."""
    out, room = [], MAX_BODY_BYTES
    try:
        while data:
            reader = zlib.decompressobj(window)
            out.append(reader.decompress(data, room + 1))
            room -= len(out[-1])
            if room < 0 or reader.unconsumed_tail:
                raise ValueError("the body unpacks to too many bytes")
            if not reader.eof:
                raise ValueError("the packed body is cut off")
            data = reader.unused_data if window > 16 and reader.unused_data[:2] == b"\x1f\x8b" else b""
    except zlib.error as e:
        raise ValueError(f"the body can't be unpacked: {e}") from None
    return b"".join(out)


def _unzstd(data: bytes) -> bytes:
    out, room = [], MAX_BODY_BYTES
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    while part := reader.read(1 << 20):
        out.append(part)
        room -= len(part)
        if room < 0:
            raise ValueError("the body unpacks to too many bytes")
    return b"".join(out)


def unpacked(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The body of a message without its transfer and content codings."""
    if "chunked" in _named(http, "transfer-encoding").lower():
        payload = _unchunked(payload)
    for coding in reversed([c.strip().lower() for c in _named(http, "content-encoding").split(",")]):
        if coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31)
        elif coding == "deflate":
            payload = _inflated(payload, 15 if payload[:1] in (b"\x08", b"\x18", b"\x28", b"\x38", b"\x48", b"\x58", b"\x68", b"\x78") else -15)
        elif coding == "zstd":
            try:
                payload = _unzstd(payload)
            except zstandard.ZstdError as e:
                raise ValueError(f"the body can't be unpacked: {e}") from None
        elif coding not in ("", "identity"):
            raise ValueError(f"the body has an unknown coding: {coding}")
    return payload


def derive(record: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response."""
    error, source, http, status, payload, body = None, [], [], "", b"", b""
    try:
        source, block = parse(record or b"")
        if (kind := _named(source, "warc-type").lower()) != "response":
            raise ValueError(f"not a response but a record of type {kind!r}")
        head, _, payload = block.partition(b"\r\n\r\n")
        first, _, rest = head.partition(b"\r\n")
        status, http = first.decode("utf-8", "replace"), _headers(rest)
        body = unpacked(payload, http)
    except ValueError as e:
        error = str(e)
    named = {k.lower(): v for k, v in reversed(source)}
    page = read_html(body.decode(_charset(http), "replace"))
    refers = named.get("warc-record-id", "")
    payload_digest = named.get("warc-payload-digest") or sha1(payload)
    shared = [(k, named[k.lower()]) for k in ("WARC-Date", "WARC-Target-URI") if k.lower() in named]
    if refers:
        shared.append(("WARC-Refers-To", refers))
    about = {
        "Envelope": {
            "WARC-Header-Metadata": _values(source),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status, "Headers": _values(http), "Entity-Length": len(payload), "Entity-Digest": sha1(payload),
                    "HTML-Metadata": {"Head": {"Title": page["title"], "Metas": page["meta"]}, "Links": page["links"]},
                }
            },
        }
    }
    if error:
        about["Error"] = error
    out = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode()),
        ("conversion", "text/plain; charset=utf-8", page["text"].encode()),
    ):
        own = record_id(kind.encode(), refers.encode(), record or b"")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), *shared]
        # The digest of the payload that a record was made from; the block's is its own.
        headers += [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", sha1(block)), ("Content-Type", content)]
        out.append(
            {
                "record_type": kind, "record_id": own, "refers_to": refers or None, "target_uri": named.get("warc-target-uri"),
                "source_payload_digest": payload_digest, "block_digest": sha1(block), "n_links": len(page["links"]), "block": block,
                "record": build(headers, block),
            }
        )
    return out


def responses(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, record): a response record for each page of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(2), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                made = [response(url, page, str(key).encode()) for key, url, page in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], [id_col, "record"])

    source = pages.select(id_col, F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return source.mapInArrow(run, T.StructType([pages.schema[id_col], T.StructField("record", T.BinaryType())]))


FIELDS = [
    ("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("target_uri", T.StringType()),
    ("source_payload_digest", T.StringType()), ("block_digest", T.StringType()), ("n_links", T.LongType()),
    ("block", T.BinaryType()), ("record", T.BinaryType()),
]


def derivatives(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion record, with their main fields."""
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                kind = part.schema.field(0).type
                keys, made = [], []
                for key, record in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for x in derive(record):
                        keys.append(key)
                        made.append(x)
                columns = [pa.array(keys, kind), *(pa.array([x[n] for x in made], arrow[t]) for n, t in FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *(n for n, _ in FIELDS)])

    schema = T.StructType([records.schema[id_col], *(T.StructField(n, t) for n, t in FIELDS)])
    return records.select(id_col, record_col).mapInArrow(run, schema)
