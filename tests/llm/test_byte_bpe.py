"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelreg.llm import batches
from panelreg.llm.batches import Recent
from panelreg.llm.byte_bpe import digest_tokens, encode_documents, encode_texts, merger, packed_ids
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = merger(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RULES.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("'sretvmldab \n\té1.日"), max_size=60), st.text(max_size=30)), max_size=4))
def test_library_agrees(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = encode_texts(texts, RULES, Recent(50))
    assert ids == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [RULES.decode(i) for i in ids] == [t.encode() for t in texts]


def test_what_a_task_keeps_of_a_word():
    """Four bytes an id and no object for each; ids of parts of a text are those of the whole."""
    known = Recent(10_000)
    texts = ["".join(f" w{i}é{i * i}" for i in range(2_000)), "", "it's 'tis"]
    ids, cuts = packed_ids(texts, RULES, known)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert all(isinstance(v, bytes) and len(v) == 4 * len(LIBRARY.encode_ordinary(w)) for w, v in known.new.items())


def test_earlier_stages_give_their_memory_back():
    """The stores that other stages filled in this process are emptied before texts are encoded."""
    import pyarrow as pa

    batches.worker_store("powers")["up"] = np.zeros(9)
    schema = pa.schema([("text", pa.string())])
    rows = pa.RecordBatch.from_pylist([{"text": t} for t in ("a b", None, "é" * 9, "")], schema)

    class Rows:
        columns = ["text"]
        schema = StructType([StructField("text", StringType())])

        def drop(self, _):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([rows])))

    (made,) = encode_documents(Rows(), PATH)
    assert made["token_ids"].to_pylist() == [LIBRARY.encode_ordinary(t) for t in ("a b", "", "é" * 9, "")]
    assert not batches.worker_store("powers") and batches.worker_store("words")


def test_long_words():
    texts = ["a" * 30_000, "ab" * 9_000, "é" * 700, "x" * 49 + "'s"]
    assert encode_texts(texts, RULES, Recent(50)) == [LIBRARY.encode_ordinary(t) for t in texts]


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_share_polynomial_hashes():
    texts = [thue_morse(n, pair) for n in (1024, 4096) for pair in ("ab", "ba", "cd", "dc")]
    assert encode_texts(texts, RULES, Recent(50)) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_equal_sums_are_compared_value_by_value(monkeypatch):
    monkeypatch.setattr(batches, "mixed", lambda x: x * np.uint64(0))
    values = np.array([1, 2, 1, 2, 2, 1, 1, 2, 3])
    first, group = batches.distinct_runs(values, np.array([0, 2, 4, 6, 6]), np.array([2, 4, 6, 8, 9]))
    assert group.tolist() == [0, 0, 1, 0, 2] and first.tolist() == [0, 2, 4]


def test_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = LIBRARY.encode_ordinary(doc["text"])
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(doc["text"].encode()).hexdigest()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, rank int").withColumn("token_ids", F.lit("old"))
    found = encode_documents(rows, PATH)
    assert found.columns == ["doc_id", "text", "rank", "token_ids"]
    assert sorted(map(str, (r["token_ids"] for r in found.collect()))) == sorted(["[]", "[]", "[64, 275]", "[64, 275]"])
    assert digest_tokens(encode_documents(rows.limit(0), PATH), PATH).count() == 0
