"""The corpus pipeline: documents without toxic, unreadable, repeated and benchmark texts, as token ids.

Each stage works on what its predecessor kept; ``run`` writes a stage's rows as Parquet in the shared
folder and reads them again, so a lost executor costs at most one stage. Stages 1 to 4 return the columns
of documents, the last adds the token ids and their number. A stage reads the other tables it needs from
``sf_dir``.

Every row is a document, also those with a repeated doc_id or none: the stages that drop by name write their
rows with a key first, and drop by that key. Extra columns come out as they went in, whatever their names:
those that a stage's operator would replace are set aside meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelreg.llm.byte_bpe import encode_documents
from panelreg.llm.decontamination import contaminated
from panelreg.llm.language import held_out, labelled_texts, predict_language
from panelreg.llm.near_dedup import near_classes, written
from panelreg.llm.registry import table
from panelreg.llm.toxicity import fit, score_toxicity, with_labels
from panelreg.session import new_path


#: Keys, of eight bytes each, that are sent to every task; more are joined by a shuffle of the rows.
SENT_KEYS = 4_000_000


def unused(docs: DataFrame, name: str) -> str:
    """The name, or the first one made longer that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with columns of these names called otherwise, and what restores the columns of a result."""
    moved = {c: unused(docs, f"_own_{c}") for c in docs.columns if c.lower() in names}

    def restored(result: DataFrame) -> DataFrame:
        return result.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))

    return docs.withColumnsRenamed(moved), restored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, learned from the labelled ones among them, doesn't call toxic."""
    params = fit(with_labels(docs, table(spark, sf_dir, "labels")))
    rows, restored = set_aside(docs, "score", "predicted")
    return restored(score_toxicity(rows, params).where("predicted = 0"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, whether or not a language could be learned."""
    texts = labelled_texts(docs.where(~held_out()))
    rows, restored = set_aside(docs, "lang_pred", "score", "parsed")
    return restored(predict_language(rows, texts).where("parsed > 0"))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of each row, written, so that it is the same whenever it is read; and the key's name."""
    key = unused(docs, "_row_key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """key (as doc_id) and text."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among the gone ones, which are sent to the tasks up to SENT_KEYS: the texts stay where they are."""
    gone = written(gone.distinct(), "gone")
    if gone.count() <= SENT_KEYS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate class; those without doc_id come last."""
    rows, key = keyed(docs)
    classes = near_classes(by_key(rows, key)).where("class_size > 1").select(F.col("doc_id").alias("row"), "class_id")
    named = written(rows.select(F.col(key).alias("row"), "doc_id").join(classes, "row"), "classes")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = named.groupBy("class_id").agg(best["row"].alias("kept"))
    gone = named.join(kept, "class_id").where("row <> kept").select(F.col("row").alias(key))
    return without(rows, key, gone).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = keyed(docs)
    found = contaminated(by_key(rows, key), table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias(key))
    return without(rows, key, gone).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(docs, path).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte_bpe", tokenize),
]

#: Learned networks and automata have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
