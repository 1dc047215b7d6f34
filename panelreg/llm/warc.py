"""WARC derivatives: metadata and plain-text conversion records for response records.

``response_records`` turns pages into WARC/1.1 response records. ``derive`` parses response records
and makes two records for each: a ``metadata`` record (title, language, counts and outlinks as
warc-fields) and a ``conversion`` record with the plain text. Both refer to the response by
WARC-Refers-To and keep its target address, date and payload digest; each carries its own block
digest. Record identifiers are hashes of what the record is about, so a repeated task makes the same
records again.

All work is per record, without a shuffle; a task holds one Arrow batch of records.

Defined results: a null address is left out of the headers, a null page has an empty body; a record
that is no response, or that can't be parsed, gives no derivatives; repeated rows give repeated
records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelreg.llm.registry import register, table

VERSION = "WARC/1.1"
NO_DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for addresses, RFC 4122

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|"
    r"hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*about: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(about))}>"


def make_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """Headers by lower-case name, and the block of the stated length."""
    head, gap, rest = (record or b"").partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return headers, rest[: int(length)]


def one_line(value: str) -> str:
    return " ".join(value.split())


def plain_text(page: str) -> str:
    """Visible text: hidden parts out, block elements as line ends, entities resolved, blanks merged."""
    text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def response_record(url: str | None, page: str | None, key: str) -> bytes:
    body = (page or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    url = None if url is None else one_line(url)
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", key, url or "", digest(body))),
        ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(http + body)),
    ]
    return make_record(headers, http + body)


def derivatives(record: bytes | None) -> list[bytes]:
    """The metadata and the conversion record of a response record."""
    parsed = parse_record(record)
    if parsed is None or parsed[0].get("warc-type") != "response":
        return []
    source, block = parsed
    http, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    refers = source.get("warc-record-id", "")
    payload = source.get("warc-payload-digest") or digest(body)
    title, lang = _TITLE.search(page), _LANG.search(page)
    text = plain_text(page).encode("utf-8", "surrogatepass")
    links = [one_line(html.unescape(a or b or c)) for a, b, c in _LINK.findall(_HIDDEN.sub(" ", page))]
    status = http.split(b"\r\n", 1)[0].decode("utf-8", "replace")
    fields = [("status", status), ("title", one_line(html.unescape(title[1])) if title else None)]
    fields += [("language", lang[1] if lang else None), ("textBytes", str(len(text)))]
    fields += [("outlink", link) for link in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("utf-8", "surrogatepass")

    def made(kind: str, content: str, data: bytes) -> bytes:
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(kind, refers, payload)),
            ("WARC-Refers-To", refers),
            ("WARC-Date", source.get("warc-date")),
            ("WARC-Target-URI", source.get("warc-target-uri")),
            ("WARC-Source-Payload-Digest", payload),
            ("Content-Type", content),
            ("WARC-Block-Digest", digest(data)),
        ]
        return make_record(headers, data)

    return [made("metadata", "application/warc-fields", about), made("conversion", "text/plain; charset=utf-8", text)]


def response_records(pages: DataFrame) -> DataFrame:
    """page_id and ``record``, the WARC response record of the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["page_id"], batch["url"], batch["html"], strict=True)
            made = [response_record(url, page, str(key)) for key, url, page in rows]
            yield pd.DataFrame({"page_id": batch["page_id"], "record": made})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, record binary")


def derive(responses: DataFrame) -> DataFrame:
    """page_id, place (0 metadata, 1 conversion) and ``record`` for every response record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [derivatives(record) for record in batch["record"]]
            rows = [(k, i, r) for k, rs in zip(batch["page_id"], made, strict=True) for i, r in enumerate(rs)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "record"])

    kind = responses.schema["page_id"].dataType.simpleString()
    return responses.select("page_id", "record").mapInPandas(run, f"page_id {kind}, place int, record binary")


def headers_of(records: DataFrame) -> DataFrame:
    """The headers of records and the digest of their blocks, by Spark's own functions."""
    # a byte is a character, so positions and lengths are those of the bytes
    text = F.decode("record", "ISO-8859-1")
    head = F.substring_index(text, "\r\n\r\n", 1)
    length = F.regexp_extract(head, r"(?i)\r\nContent-Length: (\d+)", 1).cast("int")
    block = F.expr("substring(record, length(substring_index(decode(record, 'ISO-8859-1'), '\r\n\r\n', 1)) + 5)")

    def header(name: str, alias: str):
        found = F.regexp_extract(F.decode(F.encode(head, "ISO-8859-1"), "UTF-8"), rf"(?i)\r\n{name}: ([^\r\n]*)", 1)
        return F.nullif(found, F.lit("")).alias(alias)

    return records.select(
        "page_id",
        header("WARC-Type", "warc_type"),
        header("WARC-Record-ID", "record_id"),
        header("WARC-Refers-To", "refers_to"),
        header("WARC-Target-URI", "target_uri"),
        header("WARC-Date", "warc_date"),
        header("WARC-Source-Payload-Digest", "source_payload_digest"),
        header("WARC-Block-Digest", "block_digest"),
        length.cast("long").alias("content_length"),
        F.sha2(block.substr(F.lit(1), length), 256).alias("block_sha256"),
    )


@register()
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of all pages, described by their own headers."""
    return headers_of(derive(response_records(table(spark, sf_dir, "pages"))))
