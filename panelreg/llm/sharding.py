"""Shards by a weighted hash tree: region, rack, shard.

Every shard draws an exponential number from a hash of (row key, shard), divided by the shard's
weight. A rack's draw is the least draw of its shards, a region's the least of its racks; by the
rule for the least of exponentials both are themselves weighted hash draws, with the summed weight
of the subtree. A row descends to the region, then the rack, then the shard with the least draw.

A change of one shard's weight changes no draw outside its path, so rows only move into that
subtree when it grows and only out of it when it shrinks. A new shard takes rows only into itself.

Only built-in column functions are used. A row costs one hash per shard and no shuffle; slots add
one shuffle of the narrow columns.

Defined results: a null key hashes like a missing value, so all rows without key share a shard; equal
keys share a shard; a null text has no bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelreg.llm.registry import register, table

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
#: A shard is numbered in so many parts, whatever the cluster, so that slots don't depend on it.
BLOCKS = 128
#: Offsets are sent to every task up to so many rows, joined by a shuffle above.
SENT_OFFSETS = 200_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """Exponential with rate ``weight`` from the top 53 bits of the hash of (key, shard), and the shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.struct((-F.log((bits + 0.5) / float(1 << 53)) / weight).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a row: the least draw of each rack, of each region and of all regions.

    The place of a shard in the tree depends on its number alone, ties go to the lower number."""
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights: at least one positive, none negative")
    level = [[draw(key, s, w)] if w > 0 else [] for s, w in enumerate(weights)]
    for width in (SHARDS_PER_RACK, RACKS_PER_REGION, len(level)):
        groups = [sum(level[i : i + width], []) for i in range(0, len(level), width)]
        level = [[F.array_min(F.array(*draws))] if draws else [] for draws in groups]
    return level[0][0]["shard"]


def with_slots(
    rows: DataFrame, shard: str, shards: int, order: Sequence[str], blocks: int, out: str = "slot"
) -> DataFrame:
    """Gapless numbers from 0 within each shard. A shard is numbered in ``blocks`` parts by hash, each
    shifted by the counts of the parts before it, so no task holds a shard."""
    if not 0 < blocks:
        raise ValueError("blocks must be positive")
    block = "_slot_block"
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(F.lit("slot"), *(F.col(c) for c in order)), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(shard, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, block).orderBy(*order)
    numbered = dealt.withColumn("_place", F.row_number().over(within) - 1)
    if shards * blocks <= SENT_OFFSETS:
        offsets = F.broadcast(offsets)
    joined = numbered.join(offsets, [shard, block])
    return joined.withColumn(out, (F.col("_place") + F.col("_before")).cast("long")).drop(block, "_place", "_before")


@register()
def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by their key; ``grown_shard`` is the place among 25."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * 24).alias("shard"),
        shard_of(F.col("doc_id"), [1.0] * 25).alias("grown_shard"),
    )
    return with_slots(rows, "shard", 24, ("doc_id", "text_crc32", "size"), BLOCKS)
