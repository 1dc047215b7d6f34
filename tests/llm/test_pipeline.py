"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from panelreg.llm.byte_bpe import merger
from panelreg.llm.decontamination import contaminated
from tests.llm.test_decontamination import brute
from tests.llm.test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_dedup", "decontamination", "byte_bpe"]
    extra = spark.createDataFrame([(10_000, "12 34 !!", "en", "s", 8), (10_001, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).cache()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = {r["doc_id"] for r in stages["language"](spark, docs, SF).collect()}
    assert set(whole) - kept == {10_000, 10_001}
    clean = {r["doc_id"] for r in stages["toxicity"](spark, docs, SF).collect()}
    assert len(clean) > 0.8 * len(whole)
    single = stages["near_dedup"](spark, docs, SF)
    classes = brute_classes(list(whole.items()))
    assert {r["doc_id"] for r in single.collect()} == {k for k, c in classes.items() if k == c}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    free = stages["decontamination"](spark, docs, SF)
    assert {r["doc_id"] for r in free.collect()} == set(whole) - {k for k, _ in brute(list(whole.items()), items)}
    assert single.columns == free.columns == columns


def test_rows_without_or_with_equal_ids(spark):
    stages = dict(corpus_pipeline.STAGES)
    near = [" ".join(f"w{i}" for i in range(100)) + end for end in ("", " x")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()["text"]
    texts = [(None, "one two three"), (None, "one two three"), (1, "a b c"), (1, "a b c"), (2, "p q r"), (3, "p q r"), (3, "own text")]
    docs = spark.createDataFrame([*texts, (None, near[0]), (None, near[1])], "doc_id long, text string")
    single = sorted(map(str, (tuple(r) for r in stages["near_dedup"](spark, docs, SF).collect())))
    left = [r for r in single if "w1 " not in r]
    assert left == sorted(map(str, [(None, "one two three"), (1, "a b c"), (2, "p q r"), (3, "own text")]))
    assert len(single) == len(left) + 1
    docs = spark.createDataFrame([(None, item), (None, "own text"), (1, item), (1, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, near[0])], "item_id long, text string")
    anonymous = spark.createDataFrame([(None, item), (None, near[0])], "doc_id long, text string")
    assert {r["item_id"] for r in contaminated(anonymous, items).collect()} == {1, 2}
    free = stages["decontamination"](spark, docs, SF).collect()
    assert sorted(map(str, (tuple(r) for r in free))) == sorted(map(str, [(None, "own text"), (1, "other")]))


def test_dropped_keys_are_sent_or_joined(spark, monkeypatch):
    rows = spark.range(50).withColumn("text", F.lit("t"))
    gone = spark.range(0, 50, 3).unionByName(spark.range(6))
    for most in (0, 1_000):
        monkeypatch.setattr(corpus_pipeline, "SENT_KEYS", most)
        kept = corpus_pipeline.without(rows, "id", gone).collect()
        assert sorted(r["id"] for r in kept) == [i for i in range(6, 50) if i % 3]


def test_extra_columns_come_out_as_they_went_in(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["score", "predicted", "lang_pred", "Parsed", "_row_key", "class_id", "kept", "node", "row", "size", "start", "item_id", "_own_score"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, SF)
        assert kept.columns == wide.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_texts_without_labels_stay(spark):
    docs = spark.createDataFrame([(1, "der die das", None), (2, "12 !!", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).collect()] == [1]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merger(path).ranks, special_tokens={})
    found = rows.collect()
    assert found and all(r["token_ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in found)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
