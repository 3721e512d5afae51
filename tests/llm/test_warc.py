import base64
import gzip
import hashlib
import itertools
import json
import re
import time
import zlib
from html.parser import HTMLParser

import zstandard

from keyorder.llm import queries, warc

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><meta name=author content='A &amp; B'><title>T &amp;
 x</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="/a?b=1&amp;c">one <b>two</b></a>
<a name=x>none</a></nav><p title="a > b">First<br>second   line<p>1 &lt; 2 &eacute;<img src='i.png'><script>unclosed"""


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_html():
    found = warc.read_html(PAGE)
    assert found["title"] == "T & x"
    assert found["text"].split("\n") == ["T & x", "one two", "none", "First", "second line", "1 < 2 é"]
    assert found["meta"] == {"charset": "utf-8", "author": "A & B"}
    assert found["links"] == [{"path": "A@/href", "url": "/a?b=1&c", "text": "one two"}, {"path": "IMG@/src", "url": "i.png"}]


def test_odd_html():
    for page, text in [("", ""), ("a < b > c", "a < b > c"), ("<", "<"), ("<!-- open", ""), ("x <p", "x"), ("x <p title=\"y> z", "x"), ("<script>x", ""), ("x</3>y", "xy"), ("a <1> b", "a <1> b"), ("x" * 100_000, "x" * 100_000), ("<p>" * 20_000, "")]:
        assert warc.read_html(page)["text"] == text


def test_records_are_linked_and_round_trip():
    record = warc.response("http://x/é\r\nEvil: 1", PAGE, b"1")
    headers, block = warc.parse(record)
    source = dict(headers)
    assert source["WARC-Target-URI"] == "http://x/é Evil: 1" and source["WARC-Block-Digest"] == digest(block)
    metadata, conversion = warc.derive(record)
    for made in (metadata, conversion):
        own, body = warc.parse(made["record"])
        own = dict(own)
        assert own["WARC-Refers-To"] == source["WARC-Record-ID"] == made["refers_to"]
        assert own["WARC-Target-URI"] == source["WARC-Target-URI"] and own["WARC-Date"] == source["WARC-Date"]
        assert own["WARC-Block-Digest"] == digest(body) == made["block_digest"]
        assert own["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] == digest(PAGE.encode())
        assert int(own["Content-Length"]) == len(body)
    assert len({metadata["record_id"], conversion["record_id"], source["WARC-Record-ID"]}) == 3
    about = json.loads(metadata["block"])["Envelope"]
    assert about["WARC-Header-Metadata"] == source
    http = about["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"]["Content-Type"].startswith("text/html") and http["Entity-Digest"] == digest(PAGE.encode())


def test_bad_records():
    for record in (None, b"", b"nonsense", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        metadata, conversion = warc.derive(record)
        assert "Error" in json.loads(metadata["block"]) and conversion["block"] == b"" and metadata["refers_to"] is None


def test_charset_of_the_header():
    payload = "é".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + payload
    assert warc.derive(warc.build([("WARC-Type", "response")], block))[1]["block"].decode() == "é"
    block = block.replace(b"ISO-8859-1", b"no-such")
    assert warc.derive(warc.build([("WARC-Type", "response")], block))[1]["block"].decode() == "�"


class Reader(HTMLParser):
    """Another reading of pages, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.metas, self.links, self.inside, self.hidden = [""], "", [], [], None, 0
        self.in_title = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed([(k, v or "") for k, v in attrs]))
        self.hidden += tag in ("script", "style", "template", "noscript")
        self.in_title |= tag == "title"
        if tag in warc.BLOCKS:
            self.lines.append("")
        if tag == "a":
            self.inside = ["A@/href", attrs["href"], ""] if "href" in attrs else None
            self.links += [self.inside] if self.inside else []
        elif tag in ("img", "link", "iframe"):
            self.links += [[f"{tag.upper()}@/{a}", attrs[a], None] for a in ("src", "href") if a in attrs]
        elif tag == "meta":
            name = attrs.get("name") or attrs.get("property") or ("charset" if "charset" in attrs else None)
            self.metas += [(name, attrs.get("content", attrs.get("charset", "")))] if name is not None else []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "noscript")
        self.in_title &= tag != "title"
        if tag in warc.BLOCKS:
            self.lines.append("")
        if tag == "a":
            self.inside = None

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.title += data
            return
        first, *rest = data.split("\n")
        self.lines[-1] += first
        self.lines += rest
        if self.inside:
            self.inside[2] += data

    def read(self):
        tidy = lambda x: re.sub(r"[ \t\r\f\v]+", " ", x.replace("\n", " ")).strip()
        body = [t for t in map(tidy, self.lines) if t]
        title = " ".join(self.title.split())
        links = [{"path": p, "url": u} | ({} if t is None else {"text": tidy(t)}) for p, u, t in self.links]
        return title, self.metas, links, "\n".join([title] * bool(title) + body)


def flat(metas):
    return sorted((k, v) for k, vs in metas.items() for v in (vs if isinstance(vs, list) else [vs]))


def test_query_equals_another_reading(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.op3_warc_derivatives(spark, data).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for key, of in itertools.groupby(sorted(rows, key=lambda r: (r.page_id, r.record_type)), lambda r: r.page_id):
        conversion, metadata = of
        page = (pages[key].html or "").encode()
        _, _, links, text = Reader(page.decode()).read()
        assert conversion.block_sha256 == hashlib.sha256(text.encode()).hexdigest() and conversion.content_length == len(text.encode())
        assert conversion.block_digest == digest(text.encode())
        assert metadata.refers_to == conversion.refers_to and metadata.refers_to.startswith("<urn:uuid:")
        for r in (conversion, metadata):
            assert r.source_payload_digest == digest(page) and r.n_links == len(links) and r.target_uri == pages[key].url
        # The record, header by header.
        lines = ["WARC/1.1", "WARC-Type: conversion", f"WARC-Record-ID: {conversion.record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
        lines += [f"WARC-Target-URI: {pages[key].url}", f"WARC-Refers-To: {conversion.refers_to}", f"WARC-Source-Payload-Digest: {digest(page)}"]
        lines += [f"WARC-Block-Digest: {digest(text.encode())}", "Content-Type: text/plain; charset=utf-8", f"Content-Length: {len(text.encode())}", "", text, "", ""]
        assert conversion.record_sha256 == hashlib.sha256("\r\n".join(lines).encode()).hexdigest()


def test_pages_equal_another_reading(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        title, metas, links, text = Reader(r.html or "").read()
        found = warc.read_html(r.html or "")
        assert (found["title"], flat(found["meta"]), found["links"], found["text"]) == (title, sorted(metas), links, text)


def test_broken_markup_takes_linear_time():
    for bad in ("<a ", '<a "', "<script ", "<!--", "<", "<a b=", "</", "<a = ", "<a b='", "<script>", "&", "<!", "<a href='x'>y"):
        began = time.process_time()
        warc.read_html(bad * (1_000_000 // len(bad)))
        assert time.process_time() - began < 4, bad


def message(*headers, body=b"<p>caf\xc3\xa9"):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>")], block)


def test_charsets_that_arent_of_texts():
    for name in ("hex", "rot13", "zip", "base64", "idna", "punycode", "unicode_escape", "undefined", "mbcs", "é", "utf-7"):
        assert warc.derive(message(("Content-Type", f"text/html; charset={name}")))[1]["block"].decode() == "café"
    assert warc.derive(message(("Content-Type", "text/html; charset='utf-16le'"), body="hi".encode("utf-16le")))[1]["block"] == b"hi"


def test_packed_bodies():
    body = b"<p>caf\xc3\xa9" * 3
    raw = zlib.compressobj(wbits=-15)
    packings = {
        "gzip": gzip.compress(body[:12]) + gzip.compress(body[12:]), "deflate": zlib.compress(body), "zstd": zstandard.compress(body), "identity": body,
        "GZIP, zstd": zstandard.compress(gzip.compress(body)),
    }
    packed = [*packings.items(), ("deflate", raw.compress(body) + raw.flush())]
    for coding, data in packed:
        chunks = b"".join(b"%x;q=1\r\n%b\r\n" % (len(data[i : i + 7]), data[i : i + 7]) for i in range(0, len(data), 7)) + b"0\r\n\r\n"
        for headers, stored in (([], data), ([("Transfer-Encoding", "chunked")], chunks)):
            record = message(("Content-Encoding", coding), *headers, body=stored)
            for given in (record, gzip.compress(record)):
                metadata, conversion = warc.derive(given)
                assert conversion["block"].decode() == "café\ncafé\ncafé" and metadata["source_payload_digest"] == digest(stored)
                assert "Error" not in json.loads(metadata["block"])


def test_what_cant_be_unpacked_is_reported(monkeypatch):
    bad = [
        message(("Content-Encoding", "gzip")), message(("Content-Encoding", "br")), message(("Content-Encoding", "zstd")), message(("Content-Encoding", "deflate")),
        message(("Content-Encoding", "gzip"), body=gzip.compress(b"x" * 99)[:-9]), message(("Transfer-Encoding", "chunked")), message(("Transfer-Encoding", "chunked"), body=b"9\r\nshort"),
        b"\x1f\x8bnot gzip",
    ]
    monkeypatch.setattr(warc, "MAX_BODY_BYTES", 1000)
    bad += [message(("Content-Encoding", c), body=f(b"x" * 2000)) for c, f in (("gzip", gzip.compress), ("deflate", zlib.compress), ("zstd", zstandard.compress))]
    for record in bad:
        metadata, conversion = warc.derive(record)
        assert "Error" in json.loads(metadata["block"]) and conversion["block"] == b""


def test_other_types_arent_responses():
    record = warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:r>")], b"GET / HTTP/1.1\r\nHost: x\r\n\r\n")
    metadata, conversion = warc.derive(record)
    about = json.loads(metadata["block"])
    assert "request" in about["Error"] and about["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Response-Message"] == ""
    assert conversion["block"] == b"" and conversion["refers_to"] == "<urn:r>"


def test_nulls_repeated_rows_and_more_columns(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record", "2 AS block")
    found = warc.derivatives(warc.responses(df, "page_id", "url", "html"), "page_id", "record").collect()
    assert len(found) == 8
    assert {r.target_uri for r in found if r.page_id == 1} == {None} and all(r.refers_to for r in found)
    assert warc.derivatives(warc.responses(df.limit(0), "page_id", "url", "html"), "page_id", "record").collect() == []


def test_repeated_headers_and_metas_are_kept():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nVia: x\r\nSet-Cookie: b=2\r\n\r\n<meta name=k content=1><meta name=k content=2><meta name=l content=3>"
    source = [("WARC-Type", "response"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    about = json.loads(warc.derive(warc.build(source, block))[0]["block"])["Envelope"]
    assert about["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:a>", "<urn:b>"]
    http = about["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"] == {"Set-Cookie": ["a=1", "b=2"], "Via": "x"}
    assert http["HTML-Metadata"]["Head"]["Metas"] == {"k": ["1", "2"], "l": "3"}
