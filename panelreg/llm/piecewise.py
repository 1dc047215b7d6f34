"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it is -1 modulo the block size; each
piece gives one character of the signature, taken from a hash of its bytes. Block sizes are powers of
two from ``LEAST_BLOCK`` on; the one in use is the smallest that is expected to give at most ``LENGTH``
pieces, made smaller while it gives fewer than half of that. A fingerprint is
``block:signature:signature at twice the block``. An insertion changes the pieces around it and leaves
the others, so likeness is one minus the edit distance of the signatures over the longer length, at
a block size that both fingerprints have; fingerprints without a common one are unlike (0).

A signature stays below 2 * LENGTH pieces: a text that ends pieces more often, as repetitions do, takes a
larger block. Boundaries and piece hashes come from array operations over all bytes of a batch. ``with_edits`` pairs
every document with the next one: doc_id ranges of about ``RANGE_ROWS`` rows are dealt to tasks, each with
a copy of the first document of the range that follows, and read in order, two rows at a time. The
texts are shuffled once; boundaries are percentiles of the keys alone.

Defined results: a null text is an empty one; equal texts have equal fingerprints; equal doc_ids are
neighbours, in the order of their texts; null doc_ids come first; a single document is its own next
one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.llm.batches import mixed, parts, powers
from panelreg.llm.registry import register, table

WINDOW = 7
LEAST_BLOCK = 4
MOST_BLOCK = 1 << 30
LENGTH = 64
#: Ranges are sized by RANGE_ROWS up to MOST_RANGES ranges, which then grow; a task streams its ranges.
RANGE_ROWS = 1_000
MOST_RANGES = 20_000
#: The 64 signature characters.
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every byte; bytes before a text count as zero."""
    code = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    place = np.arange(len(data)) - np.repeat(begins[:-1], np.diff(begins))
    total = code.copy()
    for back in range(1, WINDOW):
        shifted = (code[:-back] << np.uint32(4 * back)) | (code[:-back] >> np.uint32(32 - 4 * back))
        total[back:] ^= np.where(place[back:] >= back, shifted, np.uint32(0))
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return total ^ (total >> np.uint32(13))


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(texts), np.uint8)
    # every boundary of a block size is one of all smaller block sizes
    roll = rolling(data, begins) if len(data) else np.zeros(0, np.uint32)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    triggers = np.flatnonzero(~roll & np.uint32(LEAST_BLOCK - 1) == 0)
    tail = ~roll[triggers]
    cuts = np.searchsorted(triggers, begins)
    made = []
    for i, size in enumerate(sizes.tolist()):
        first, stop = int(begins[i]), int(begins[i + 1])
        own, low = triggers[cuts[i] : cuts[i + 1]] + 1, tail[cuts[i] : cuts[i + 1]]

        def signature(block: int) -> str:
            at = own[(low & np.uint32(block - 1)) == 0]
            edges = np.concatenate(([first], at[at < stop], [stop] if stop > first else []))
            a, b = edges[:-1].astype(np.int64), edges[1:].astype(np.int64)
            pieces = mixed((sums[b] - sums[a]) * down[a])
            return LETTERS[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()

        block = LEAST_BLOCK
        while block * LENGTH < size:
            block *= 2
        found = signature(block)
        while len(found) > 2 * LENGTH and block < MOST_BLOCK:
            block *= 2
            found = signature(block)
        while block > LEAST_BLOCK and len(found) < LENGTH // 2 and len(finer := signature(block // 2)) <= 2 * LENGTH:
            block, found = block // 2, finer
        made.append(f"{block}:{found}:{signature(2 * block)}")
    return made


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 by the edit distance of signatures at a common block size."""

    def split(fingerprint: Column) -> tuple[Column, Column, Column]:
        fields = F.split(fingerprint, ":")
        return F.get(fields, 0).cast("long"), F.get(fields, 1), F.get(fields, 2)

    def ratio(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)

    (block_a, fine_a, coarse_a), (block_b, fine_b, coarse_b) = split(a), split(b)
    return (
        F.when(a == b, 1.0)
        .when(block_a == block_b, F.greatest(ratio(fine_a, fine_b), ratio(coarse_a, coarse_b)))
        .when(block_a == 2 * block_b, ratio(fine_a, coarse_b))
        .when(block_b == 2 * block_a, ratio(coarse_a, fine_b))
        .otherwise(0.0)
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and ``fingerprint`` of every whole text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch["doc_id"], [(t or "").encode() for t in batch["text"].to_pylist()]
            for part in parts([len(t) for t in texts]):
                made = pa.array(fingerprints(texts[part]), pa.string())
                yield pa.RecordBatch.from_arrays([keys[part], made], ["doc_id", "fingerprint"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last half of the text replaced by as many characters from the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(documents: DataFrame) -> DataFrame:
    """part (doc_id ranges in ascending order), guest, key, doc_id and text. Each range ends with a guest: the
    first document of the next range, or for the last one the first of all."""
    spark = documents.sparkSession
    keyed = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ranges = min(MOST_RANGES, max(1, documents.count() // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = keyed.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0] or [] if shares else []
    splits = [float("-inf"), *sorted(set(map(float, bounds))), float("inf")]
    if len(splits) > 2:
        keyed = keyed.withColumn("_place", F.col("key").cast("double"))
        bucketizer = Bucketizer(splits=splits, inputCol="_place", outputCol="_part")
        dealt = bucketizer.transform(keyed).withColumn("part", F.col("_part").cast("int")).drop("_place", "_part")
    else:
        dealt = keyed.withColumn("part", F.lit(0))
    firsts = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("key")).collect())
    guests_of = [(part, key, firsts[i - 1][0]) for i, (part, key) in enumerate(firsts)]
    heads = spark.createDataFrame(guests_of, "part int, key long, host int")
    guests = (
        dealt.join(F.broadcast(heads), ["part", "key"])
        .groupBy("host", "key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
        .select(F.col("host").alias("part"), F.lit(1).alias("guest"), "key", "doc_id", "text")
    )
    own = dealt.select("part", F.lit(0).alias("guest"), "key", "doc_id", "text")
    return own.unionByName(guests).repartition("part").sortWithinPartitions("part", "guest", "key", "text")


def with_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the fingerprints of the text, the edited text and the next text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            keys, texts = batch["doc_id"], batch["text"].to_pylist()
            hosts, guests, ids = batch["part"].to_pylist(), batch["guest"].to_pylist(), keys.to_pylist()
            for part in parts([len(t) for t in texts]):
                prints = fingerprints([t.encode() for t in texts[part]])
                rows = list(zip(hosts[part], guests[part], ids[part], texts[part], prints, strict=True))
                if held:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if x[0] == y[0] and not x[1]]
                edited = [edit(x[3], y[3]).encode() for x, y in pairs]
                shas = [hashlib.sha256(e).hexdigest() for e in edited]
                columns = [
                    pa.array([x[2] for x, _ in pairs], keys.type),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array([x[4] for x, _ in pairs], pa.string()),
                    pa.array(fingerprints(edited), pa.string()),
                    pa.array([y[4] for _, y in pairs], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = in_ranges(documents).select("part", "guest", "doc_id", "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return rows.mapInArrow(run, f"{schema}, next_fingerprint string")


@register()
def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    found = with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
