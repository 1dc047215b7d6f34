"""WARC derivatives against an independent reading of their bytes."""

from __future__ import annotations

import base64
import hashlib
import io

from panelreg.llm.queries import QUERIES
from panelreg.llm.warc import derive, derivatives, headers_of, plain_text, response_record, response_records

SF = "/root/testdata/sf0.001"


def read_records(data: bytes):
    """Plain reader for a WARC stream: header lines to the blank line, then the stated bytes."""
    stream = io.BytesIO(data)
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        headers = []
        while (line := stream.readline()) != b"\r\n":
            headers.append(tuple(line.decode().rstrip("\r\n").split(": ", 1)))
        block = stream.read(int(dict(headers)["Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n"
        yield headers, block


def test_query(spark):
    rows = QUERIES["op6_warc_derivatives"](spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    assert len(rows) == 2 * len(pages) and rows["record_id"].is_unique
    for row in rows.itertuples():
        page = pages.loc[row.page_id]
        body = page["html"].encode()
        payload = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (row.target_uri, row.source_payload_digest) == (page["url"], payload)
        stream = list(read_records(response_record(page["url"], page["html"], str(row.page_id))))
        assert row.refers_to == dict(stream[0][0])["WARC-Record-ID"]
        if row.warc_type == "conversion":
            text = plain_text(page["html"]).encode()
            assert row.content_length == len(text) and row.block_sha256 == hashlib.sha256(text).hexdigest()


def test_records_can_be_read_as_a_file():
    page = "<html lang=de><title>A &amp; B</title><script>x<p></script><p>One<br>two <b>é</b><a href='/x y'>l</a>"
    made = derivatives(response_record("http://a/\nb", page, "7"))
    (meta, about), (conv, text) = read_records(b"".join(made))
    assert text.decode() == "A & B\nOne\ntwo él"
    assert about.decode() == "status: HTTP/1.1 200 OK\r\ntitle: A & B\r\nlanguage: de\r\ntextBytes: 17\r\noutlink: /x y\r\n"
    for headers, block in ((meta, about), (conv, text)):
        headers = dict(headers)
        assert headers["WARC-Target-URI"] == "http://a/ b"
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p" * 20_000, "x"), (4, "u", "<!-- open", "x")],
        "page_id long, url string, html string, record string",
    )
    found = headers_of(derive(response_records(rows))).toPandas()
    assert len(found) == 10 and set(found.loc[found["page_id"] < 3, "content_length"]) == {0, 39}
    assert found[found["page_id"] == 1]["target_uri"].isna().all()
    assert derive(response_records(rows.limit(0))).count() == 0
    assert derivatives(None) == derivatives(b"junk") == derivatives(b"WARC/1.1\r\nWARC-Type: request\r\n\r\n") == []
