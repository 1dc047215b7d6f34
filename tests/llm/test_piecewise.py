"""Piecewise hashing against a plain version, and the pairing with the next document."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from panelreg.llm import piecewise
from panelreg.llm.piecewise import LEAST_BLOCK, LENGTH, WINDOW, edit, fingerprint_documents, fingerprints, likeness, with_edits
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_cuts(data: bytes, block: int) -> list[bytes]:
    """Pieces by a byte-wise rolling hash."""
    pieces, start = [], 0
    for i in range(len(data)):
        h = 0
        for back in range(min(i + 1, WINDOW)):
            c = (data[i - back] + 1) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= ((c << 4 * back) | (c >> (32 - 4 * back))) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        if h % block == block - 1 and i + 1 < len(data):
            pieces.append(data[start : i + 1])
            start = i + 1
    return pieces + ([data[start:]] if data else [])


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(a: str, b: str) -> float:
    (ka, fa, ca), (kb, fb, cb) = a.split(":"), b.split(":")
    pairs = [(x, y) for i, x in ((int(ka), fa), (2 * int(ka), ca)) for j, y in ((int(kb), fb), (2 * int(kb), cb)) if i == j]
    scores = [1 - plain_distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in pairs]
    return 1.0 if a == b else max(scores, default=0.0)


def test_pieces_are_those_of_the_plain_version():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcde fgh") for _ in range(n)) for n in (0, 1, 6, 40, 300, 3000)] + [b"a" * 5000]
    letters: dict[bytes, str] = {}
    for text, found in zip(texts, fingerprints(texts), strict=True):
        block, fine, coarse = found.split(":")
        assert len(fine) <= 2 * LENGTH and (int(block) == LEAST_BLOCK or len(fine) >= LENGTH // 2 or b"aaa" in text)
        for size, signature in ((int(block), fine), (2 * int(block), coarse)):
            pieces = plain_cuts(text, size)
            assert len(pieces) == len(signature)
            assert all(letters.setdefault(p, c) == c for p, c in zip(pieces, signature, strict=True))


def test_query(spark, monkeypatch):
    monkeypatch.setattr(piecewise, "RANGE_ROWS", 30)
    rows = {r["doc_id"]: r for r in QUERIES["op9_piecewise_hash"](spark, SF).collect()}
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(docs)
    prints = dict(zip((k for k, _ in docs), fingerprints([t.encode() for _, t in docs]), strict=True))
    for i, (key, text) in enumerate(docs):
        after, following = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[key]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (prints[key], fingerprints([edited.encode()])[0])
        if i % 10 == 0:
            assert abs(row["near_edited"] - plain_likeness(row["fingerprint"], row["edited_fingerprint"])) < 1e-9
            assert abs(row["near_next"] - plain_likeness(row["fingerprint"], prints[after])) < 1e-9
    long_ones = [r for r in rows.values() if r["n_chars"] > 3000]
    assert sum(r["near_edited"] for r in long_ones) > 2 * sum(r["near_next"] for r in long_ones)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(2, "b", 1), (2, "a", 1), (None, "c", 1), (5, None, 1), (7, "z" * 300_000, 1)], "doc_id long, text string, part int")
    found = with_edits(rows).collect()
    assert sorted(str((r["doc_id"], r["n_chars"])) for r in found) == sorted(map(str, [(None, 1), (2, 1), (2, 1), (5, 0), (7, 300_000)]))
    sha = {r["edited_sha256"] for r in found if r["doc_id"] == 2}
    # "a" comes before "b", whose next text is empty; half of one character is none
    assert sha == {hashlib.sha256(t.encode()).hexdigest() for t in "ab"}
    (last,) = (r for r in found if r["doc_id"] == 7)
    assert last["edited_sha256"] == hashlib.sha256(edit("z" * 300_000, "c").encode()).hexdigest()
    assert with_edits(rows.where("doc_id = 5")).count() == 1
    assert with_edits(rows.limit(0)).count() == fingerprint_documents(rows.limit(0)).count() == 0
    pair = spark.createDataFrame([("4:ab:a", "64:x:y"), ("4::", "4::"), ("4:ab:cd", "8:cd:e")], "a string, b string")
    assert [r[0] for r in pair.select(likeness(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0]
