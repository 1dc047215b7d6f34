"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words are the lower-case runs of letters and digits; shingles are five of them (items of fewer words are
one shingle of their own length). Steps, all of them built-in column functions:

1. Windows. An item-sized window can only be similar to an item if they share a shingle, so a window is
   laid at every place where a shared shingle puts the item's first word (a shorter text is one window); runs of shared shingles lay one
   window. Moving a window off all these places never raises the number of shared shingles in it. The
   shingles of the items are broadcast, in slices of at most ``SENT_ROWS`` rows, one pass over the documents
   for each slice; texts are never shuffled.
2. Fingerprints. 64 bits per window and item; a bit is set if most of its shingles have it set, each repeat
   of a shingle having a hash of its own. Counts are added up in 32-bit lanes of long integers.
3. Candidates. Fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most ``RADIUS`` bits differ
   in at most RADIUS // BLOCKS bits of some block, so items are indexed under all values of a block that are
   so near, and a window is looked up under its own: every pair of the same size within the radius is found.
   A window that has a similarity of 0.8 differs in 9.7 bits in the mean, 23 are 4.6 deviations more; with four
   shingles of five in common (the fewest that reach 0.8 unequal) it is 12 bits, and 3.5 deviations.
4. Verification. Shared shingles over all shingles, both counted with repeats, of at least ``NEAR``.

The only shuffles are of windows. Defined results: a null or wordless text or item matches nothing; repeated
doc_ids count as one document; repeated item_ids are compared one by one; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.llm.registry import register, table

SHINGLE = 5
NEAR = 0.8
RADIUS, BLOCKS = 23, 8
SENT_ROWS = 400_000
_BLOCK_BITS = 64 // BLOCKS
_LANES = 0x0000_0001_0000_0001


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingle_at(words: Column, place: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, place + i) for i in range(width)))


def shingles_of(words: Column, width: Column) -> Column:
    """All shingles of some words; ``width`` words each, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - width + 1),
        lambda i: F.aggregate(F.slice(words, i, width), F.lit(42).cast("long"), lambda h, w: F.xxhash64(h, w)),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def numbered(shingles: Column) -> Column:
    """Shingles with the number of the repeat mixed in, so that sets count repeats."""

    def mix(ordered: Column) -> Column:
        return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x).cast("int")))

    return let(F.sort_array(shingles), mix)


def fingerprint_of(shingles: Column) -> Column:
    """64 bits, each set where more than half of the shingles have it set."""

    def lane(k: int) -> Column:
        def add(total: Column, shingle: Column) -> Column:
            return total + F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(_LANES))

        return F.aggregate(shingles, F.lit(0).cast("long"), add)

    def join(lanes: Column) -> Column:
        def bit(b: int) -> Column:
            count = F.shiftrightunsigned(F.get(lanes, F.lit(b % 32)), 32 * (b // 32)).bitwiseAND(F.lit(0xFFFF_FFFF))
            return F.when(count * 2 > F.size(shingles), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long"))

        bits = F.array_compact(F.array(*map(bit, range(64))))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return let(F.array(*map(lane, range(32))), join)


def described(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, the fingerprint of ``words`` and ``elements``, their shingles as a set."""

    def both(elements: Column) -> Column:
        return F.struct(fingerprint_of(elements).alias("fingerprint"), elements.alias("elements"))

    shingles = shingles_of(F.col("words"), F.least(F.size("words"), F.lit(SHINGLE)))
    return rows.select(*keep, F.inline(F.array(let(numbered(shingles), both))))


def blocks_of(fingerprint: str) -> Column:
    mask = F.lit((1 << _BLOCK_BITS) - 1)
    return F.array(*(F.shiftrightunsigned(fingerprint, b * _BLOCK_BITS).bitwiseAND(mask).cast("int") for b in range(BLOCKS)))


def near_masks() -> list[int]:
    """All changes of a block by at most RADIUS // BLOCKS bits."""
    places = range(_BLOCK_BITS)
    return [sum(1 << p for p in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(places, n)]


def item_rows(benchmark: DataFrame) -> DataFrame:
    """item_id, size, width of shingles, and words of the items that have words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.select("item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(SHINGLE)).alias("width"), "words")


def windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, size, start, words: the item-sized windows at shared shingles."""
    words = F.col("words")
    counted = items.groupBy("width").agg(F.sum(F.col("size") - F.col("width") + 1).alias("n")).collect()
    laid = []
    for width, rows in sorted(tuple(r) for r in counted):
        places = items.where(F.col("width") == width).select("size", "words", F.posexplode(F.sequence(F.lit(0), F.col("size") - width)).alias("_", "at"))
        index = places.select(
            "size",
            "at",
            shingle_at(words, F.col("at"), width).alias("shingle"),
            F.when(F.col("at") > 0, shingle_at(words, F.col("at") - 1, width)).alias("before"),
        ).distinct()
        slices = -(-rows // SENT_ROWS)
        for part in range(slices):
            sent = F.broadcast(index.where(F.pmod("shingle", F.lit(slices)) == part))
            docs = documents.select("doc_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= width)
            placed = docs.select("doc_id", "words", F.posexplode("words").alias("place", "_")).where(
                F.col("place") <= F.size("words") - width
            )
            found = placed.withColumn("shingle", shingle_at(words, F.col("place"), width)).join(sent, "shingle")
            same_before = (F.col("place") > 0) & (shingle_at(words, F.col("place") - 1, width) == F.col("before"))
            start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("at"), F.size("words") - F.col("size")))
            begun = found.where(~F.coalesce(same_before, F.lit(False)))
            window = F.slice(words, start + 1, F.col("size"))
            laid.append(begun.select("doc_id", "size", start.alias("start"), window.alias("words")))
    if not laid:
        return documents.select("doc_id", F.lit(0).alias("size"), F.lit(0).alias("start"), words_of(F.col("text")).alias("words")).limit(0)
    together = laid[0]
    for more in laid[1:]:
        together = together.unionByName(more)
    return together.dropDuplicates(["doc_id", "size", "start", "words"])


def contaminated(documents: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, item_id, start (in words), size and similarity: each item a document holds, at its most similar window."""
    items = item_rows(benchmark)
    mine = described(windows(documents, items), "doc_id", "size", "start")
    theirs = described(items, "item_id", "size").withColumnsRenamed(
        {"fingerprint": "item_fingerprint", "elements": "item_elements"}
    )
    masks = F.array(*map(F.lit, near_masks()))
    index = theirs.select("*", F.posexplode(blocks_of("item_fingerprint")).alias("block", "_exact"))
    index = index.withColumn("value", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("_exact"))))).drop("_exact")
    asked = mine.select("*", F.posexplode(blocks_of("fingerprint")).alias("block", "value"))
    if benchmark.count() * BLOCKS * len(near_masks()) <= SENT_ROWS:
        index = F.broadcast(index)
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    shared = F.size(F.array_intersect("elements", "item_elements"))
    pairs = (
        asked.join(index, ["size", "block", "value"])
        .where(apart <= RADIUS)
        .withColumn("_shared", shared)
        .withColumn("similarity", F.col("_shared") / (F.size("elements") + F.size("item_elements") - F.col("_shared")))
        .where(F.col("similarity") >= near)
    )
    best = F.max_by(F.struct("start", "size", "similarity"), F.struct("similarity", -F.col("start"), "size"))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.size", "b.similarity")


@register()
def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
