"""Token files: the library's ids, an exact round trip, the index."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from panelreg.llm import token_files
from panelreg.llm.queries import QUERIES
from panelreg.llm.token_files import frame, piece_encoder, placed_index, read_frame, read_records, write_token_files

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_cuts_between_kinds_of_characters():
    """The table says what the rule says, and code points beyond it are glue that stays as it is."""
    for a in range(5):
        for b in range(5):
            rule = (a != b and a != token_files._GLUE and b != token_files._GLUE) or token_files._BLANK in (a, b) or a == b == token_files._DIGIT
            assert token_files._CUTS[a, b] == rule
    texts = ["\u024f\u0250\u0251 Ä1ß22 x-y", "日本 語a 12", "\U0010ffff b", ""]
    for text, ids in zip(texts, piece_encoder(PATH).encode(texts), strict=True):
        assert ids.tolist() == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("'sretAÉßİ日 \n ́é1².<|>"), max_size=60), st.text(max_size=30)), max_size=4))
def test_library_agrees(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["x<|endoftext|>y"]
    assert [i.tolist() for i in piece_encoder(PATH).encode(texts)] == [library_ids(t) for t in texts]


def test_words_that_share_polynomial_hashes():
    texts = ["".join(pair[bin(i).count("1") % 2] for i in range(n)) for n in (1024, 4096) for pair in ("ab", "ba", "éè", "èé")]
    assert [i.tolist() for i in piece_encoder(PATH).encode(texts)] == [library_ids(t) for t in texts]


def test_frames():
    data = frame(7, b"abcd") + b"\n" + frame(None, b"") + b"\n"
    assert read_frame(data, 0) == (7, b"abcd", len(frame(7, b"abcd")) + 1)
    assert read_frame(data, len(frame(7, b"abcd")) + 1) == (None, b"", len(data))
    broken = bytearray(data)
    broken[25] ^= 1
    with pytest.raises(ValueError, match="broken record"):
        read_frame(bytes(broken), 0)


def expected(rows):
    found, start = [], 0
    for key, text in rows:
        ids = [*library_ids(text or ""), 2]
        found.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_query_with_many_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 50_000)
    rows = [tuple(r) for r in QUERIES["op10_token_files"](spark, SF).orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert rows == expected(docs)


def test_odd_rows_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(3, "b", 1), (3, "a", 1), (None, "c", 1), (1, None, 1), (9, "z " * 90_000, 1)], "doc_id long, text string, offset int")
    write_token_files(rows, PATH, str(tmp_path / "f"))
    index = placed_index(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in index] == [(None, 0, 2), (1, 2, 1), (3, 3, 2), (3, 5, 2), (9, 7, 90_001)]
    for entry in index:
        with open(entry["path"].removeprefix("file:"), "rb") as file:
            file.seek(entry["offset"])
            key, ids, _ = read_frame(file.read(entry["length"]), 0)
        assert key == entry["doc_id"] and len(ids) == 2 * entry["n_tokens"] and ids[-2:] == b"\x02\0"
    assert read_records(spark, str(tmp_path / "f"), 2).count() == 5
