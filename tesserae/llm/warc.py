"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

Both kinds refer to the response by its record id, and carry its target URI, date, digests and HTTP headers along.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tesserae:warc")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag that isn't closed ends before the next one: broken pages are read once, not again from each of their tags.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<))|<[!?][^>]*(?:>|\Z)")
_BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANKS = re.compile(r"[ \t\f\v\xa0]+")

COLUMNS = "page_id {id}, record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_headers string, source_payload_digest string, block_digest string, content_type string, content_length bigint, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    """A record id that depends on the parts alone: a task that runs again makes the same one."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def convert(page: str) -> tuple[str, dict[str, list[str]]]:
    """The plain text of a page, and its title, language, charset, base address and links in order.

    Comments, scripts and styles go, block elements end lines, character references are resolved, blanks are collapsed.
    """
    facts: dict[str, list[str]] = {"title": [], "language": [], "charset": [], "outlink": [], "base": []}
    out, at, title = [], 0, None
    shown = _HIDDEN.sub(" ", page)
    for m in _TAG.finditer(shown):
        out.append(shown[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in _BLOCK:
            out.append("\n")
        if m[1]:
            if name == "title" and title is not None:
                facts["title"].append(" ".join(html.unescape("".join(out[title:])).split()))
                del out[title:]
                title = None
        elif name == "title":
            title = len(out)
        elif name in ("a", "area", "html", "meta", "link", "base"):
            attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3] or "")}
            for key, fact in (("lang", "language"), ("charset", "charset")) + ((("href", "base" if name == "base" else "outlink"),) if name != "html" else ()):
                if attrs.get(key):
                    facts[fact].append(attrs[key])
    out.append(shown[at:])
    if not facts["base"]:
        del facts["base"]
    text = _BLANKS.sub(" ", html.unescape("".join(out)))
    return "\n".join(filter(None, map(str.strip, text.split("\n")))), facts


def metadata(facts: dict[str, list[str]], uri: str, text: str) -> str:
    """A block of application/warc-fields: title, languages, charset, each link once against the page's base, and the text's size."""
    lines = [f"{k}: {' '.join(v.split())}" for k in ("title", "language", "charset") for v in facts[k][:1]]
    base = _address(uri, facts.get("base", [""])[0]) if facts.get("base") else uri
    links = dict.fromkeys(_address(base, link) for link in facts["outlink"])
    return "".join(f"{x}\r\n" for x in [*lines, *(f"outlink: {x}" for x in links), f"textLength: {len(text)}"])


def _address(base: str, link: str) -> str:
    """A link's address without its fragment; a link that has none stays as it is."""
    try:
        return urldefrag(urljoin(base, link.strip()))[0]
    except ValueError:
        return " ".join(link.split())


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages (page_id, url, html) as responses (page_id, record_id, target_uri, warc_date, http_headers, payload); null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response (page_id, record_id, target_uri, warc_date, http_headers, payload): metadata and conversion.

    A response without record_id gets one from its page_id, URI and payload; one with a payload_digest keeps it, else it is
    the payload's. A null URI, date, header or payload counts as empty. Repeated rows give repeated records, equal in all
    fields; an empty page gives an empty conversion, an empty table an empty result; a page of any length is read once, from
    its beginning to its end. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, rid, uri, date, headers, payload, sent in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                uri, date, headers, payload = uri or "", date or "", headers or "", payload or ""
                raw = payload.encode("utf-8", "surrogatepass")
                own = sent or digest(raw)
                rid = rid or record_id("response", page, uri, own)
                text, facts = convert(payload)
                for kind, mime, block in (("metadata", "application/warc-fields", metadata(facts, uri, text)), ("conversion", "text/plain; charset=utf-8", text)):
                    data = block.encode("utf-8", "surrogatepass")
                    rows.append((page, kind, record_id(kind, rid), rid, uri, date, headers, own, digest(data), mime, len(data), block))
            for k in range(0, len(rows), 64):
                cols = zip(*rows[k : k + 64], strict=True)
                kinds = [batch.schema.field(0).type, *[pa.string()] * 9, pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    bound_batches(source.sparkSession)
    sent = F.col("payload_digest") if "payload_digest" in source.columns else F.lit(None)
    wanted = source.select("page_id", *(F.col(c).cast("string") for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")), sent.cast("string").alias("payload_digest"))
    return wanted.mapInArrow(run, COLUMNS.format(id=source.schema["page_id"].dataType.simpleString()))


def serialise(r) -> bytes:
    """A derived record (a row of derive()) as one gzip member of a WARC file.

    The source's payload digest and HTTP headers have no fields in the standard; they stand in extension fields.
    """
    data = r["block"].encode("utf-8", "surrogatepass")
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]),
        ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["warc_date"]),
        ("WARC-Refers-To-Payload-Digest", r["source_payload_digest"]), ("WARC-Refers-To-HTTP-Headers", base64.b64encode(r["source_headers"].encode()).decode()),
        ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(len(data))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + data + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file's bytes, gzip members or plain."""
    plain = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        first, *lines = plain[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        at = end + 4 + int(fields["Content-Length"])
        yield fields, plain[end + 4 : at]
        at += 4


def http(block: bytes) -> tuple[str, bytes, str]:
    """(headers, payload as it was sent, text) of an HTTP response: chunks joined, compression undone, characters decoded.

    The charset is that of Content-Type, else of the page's own meta element, else UTF-8; what it can't decode is replaced.
    """
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("latin-1")
    field = lambda name: next((m[1].strip().lower() for m in re.finditer(rf"(?im)^{name}:([^\r\n]*)", headers)), "")
    if "chunked" in field("transfer-encoding"):
        parts, at = [], 0
        while m := re.compile(rb"\s*([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
            size = int(m[1], 16)
            parts.append(body[m.end() : m.end() + size])
            at = m.end() + size
            if not size:
                break
        body = b"".join(parts)
    plain = body
    if field("content-encoding") in ("gzip", "x-gzip", "deflate"):
        try:
            plain = zlib.decompressobj(47 if body[:2] == b"\x1f\x8b" or body[:1] == b"\x78" else -15).decompress(body)
        except zlib.error:
            plain = b""
    said = re.search(r"charset=[\"']?([\w.:-]+)", field("content-type")) or re.search(r"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", plain[:4096].decode("latin-1"), re.I)
    try:
        text = plain.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        text = plain.decode("utf-8", "replace")
    return headers + "\r\n", body, text


def read(spark, path: str) -> DataFrame:
    """The responses (page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest) of WARC files, a file to a task.

    page_id is the record's id. Other records, and responses that are no HTTP, are left out; a digest that a record has is
    kept, else it is that of the payload as it was sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for fields, block in parse(data.as_py()):
                    if fields.get("WARC-Type") != "response" or not block.startswith(b"HTTP/"):
                        continue
                    headers, body, text = http(block)
                    row = (fields.get("WARC-Record-ID"), fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields.get("WARC-Date"), headers, text, fields.get("WARC-Payload-Digest") or digest(body))
                    yield pa.record_batch([pa.array([v], pa.string()) for v in row], ["page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id string, record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string")


def with_bytes(records: DataFrame) -> DataFrame:
    """(record_id, record_type, data): each derived record as it stands in a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([batch.column("record_id"), batch.column("record_type"), pa.array([serialise(r) for r in rows], pa.binary())], ["record_id", "record_type", "data"])

    return records.mapInArrow(run, "record_id string, record_type string, data binary")
