"""Alignment against the libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelreg.llm import alignment
from panelreg.llm.alignment import Aligner, align_documents, byte_level, digest_links
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
A, B = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
LEVEL = byte_level()
RULES = Aligner(*PATHS)


def plain_groups(text):
    """[(ids of A, ids of B), ...] of one text, from both libraries and a loop over the bytes."""
    if not text:
        return []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(LEVEL[c] for c in A.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in ids_b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            groups[-1][0].append(ids_a[i])
            end_a += len(bytes_a[i])
            i += 1
        else:
            groups[-1][1].append(ids_b[j])
            end_b += len(bytes_b[j])
            j += 1
        if end_a == end_b:
            groups.append(([], []))
    return groups[:-1]


def plain_rows(texts):
    """The query's columns but for doc_id."""
    every = [plain_groups(t) for t in texts]
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in every]
    count = Counter(pair for found in links for pair in set(found))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for groups, found in zip(every, links, strict=True):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append(
            (
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                len(found),
                sum(count[p] == best[p[0]] for p in found),
                sum(count[p] for p in found),
                hashlib.sha256(line.encode()).hexdigest() if line else "",
            )
        )
    return rows


def aligned_groups(texts):
    (a, cuts_a), (b, cuts_b), (sizes_a, cuts), (sizes_b, _) = RULES.align(texts)
    found = []
    for t in range(len(texts)):
        groups, i, j = [], cuts_a[t], cuts_b[t]
        for n, m in zip(sizes_a[cuts[t] : cuts[t + 1]], sizes_b[cuts[t] : cuts[t + 1]], strict=True):
            groups.append((a[i : i + n].tolist(), b[j : j + m].tolist()))
            i, j = i + n, j + m
        assert (i, j) == (cuts_a[t + 1], cuts_b[t + 1])
        found.append(groups)
    return found


ODD = ["x<|endoftext|>y", "<s> </s> <0x0A>", "a▁ b", "▁", " ", "  ", "a  b ", "a\n b\n  c", "日本 語。 ﬁ①", "x\u0085 y", "é é f", "\x00 \x1c \x1f a"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("'sret lda \n\té1.日▁"), max_size=60), st.text(max_size=30)), max_size=5))
def test_groups_are_those_of_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ODD
    assert aligned_groups(texts) == [plain_groups(t) for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(alignment, "JOINED_CHARS", 10)
    for _ in range(3):
        assert aligned_groups(ODD) == [plain_groups(t) for t in ODD]


@pytest.mark.parametrize("sent", [0, 500, 1_000_000])
def test_query(spark, sent, monkeypatch):
    monkeypatch.setattr(alignment, "PART_TOKENS", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    order = [tuple(r) for r in docs.collect()]
    kept = align_documents(docs, *PATHS).drop("text")
    found = digest_links(kept, sent) if sent < 1_000_000 else QUERIES["op13_end_alignment"](spark, SF)
    rows = {r["doc_id"]: tuple(r[1:]) for r in found.collect()}
    assert found.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = plain_rows([t for _, t in order])
    assert rows == {key: row for (key, _), row in zip(order, expected, strict=True)}


def test_large_groups_and_handing_on(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 20)
    texts = ["".join(chr(0x4E00 + (i * 37) % 900) for i in range(700)), "a" * 5_000, "ab" * 900 + "🙂" * 300, "b c d e f g"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for large in (4, 4_096):
        monkeypatch.setattr(alignment, "GROUP_LINKS", large)
        # worker processes don't see the patched number: the function itself is compared
        batch = align_documents(rows, *PATHS).toArrow().combine_chunks().to_batches()[0]
        row, pair, n = alignment.links_of(batch)
        links = [Counter(a * alignment.PAIR + b for x, y in plain_groups(t) for a in x for b in y) for t in texts]
        assert list(zip(row.tolist(), pair.tolist(), n.tolist(), strict=True)) == [(i, p, c[p]) for i, c in enumerate(links) for p in sorted(c)]
    assert [tuple(r[1:]) for r in digest_links(align_documents(rows, *PATHS).drop("text")).orderBy("doc_id").collect()] == plain_rows(texts)


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, 5), (None, "", 6), (2, "a b", None), (2, "a b", None), (None, "a▁b", 1), (3, "word " * 9_000, 2)], "doc_id long, text string, n_a int"
    ).withColumn("a_ids", F.lit("old"))
    aligned = align_documents(rows, *PATHS)
    assert aligned.columns == ["doc_id", "text", "n_a", "a_ids", "b_ids", "a_sizes", "b_sizes"]
    found = digest_links(aligned.select("doc_id", *alignment.ADDED)).collect()
    expected = plain_rows([None, "", "a b", "a b", "a▁b", "word " * 9_000])
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((k, *e)) for (k, *_), e in zip(rows.collect(), expected, strict=True))
    assert digest_links(align_documents(rows.limit(0), *PATHS).select("doc_id", *alignment.ADDED)).count() == 0
