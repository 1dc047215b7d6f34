"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Targets. A source's size is its number of words. The sources share ``BUDGET`` of all words by weight; a
source stops at ``MOST_EPOCHS`` times its size, and what it can't take goes to the others by weight, until
none is above its cap. Each round is one aggregate over the table of sources: those at their cap under the
present water level are clamped, and the level of the others follows from what is left. The level only
rises, so it ends when no further source is clamped.

Repetitions. A target is a whole number of epochs of the source and a rest of less than one. Every document
is taken as often as there are whole epochs; the rest goes to the documents in the order of a seeded hash of
doc_id and text, once each, until it is used up; the document at the edge gives only the words still missing.
So a source takes its rounded target. Documents that share the edge's hash (the same row repeated) share the
words that are missing, rounded down.

The edge of a source is found without a sort of its rows: sizes are added up by the first ``BUCKET_BITS`` bits
of the hash, before any shuffle, then by whole hashes inside the one bucket that holds the edge. Rows meet
one line for their source, broadcast up to ``SENT_BYTES`` and joined by a shuffle above; only lines of sources,
never rows, are numbered or searched.

Defined results: a null text has no words; a null source is a source, the last; documents without doc_id, and
repeated rows, are documents; a source without words has target 0; an empty table gives no rows. Columns
named like the added ones (size, source_size, target, taken) are replaced, others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelreg.llm.near_dedup import written
from panelreg.llm.registry import register, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for all words there are, as (numerator, denominator).
BUDGET = (3, 2)
MOST_EPOCHS = 2
SEED = "mix-1"
HASH_BITS, BUCKET_BITS = 60, 16
SENT_BYTES = 32 << 20
ADDED = ("size", "source_size", "target", "taken")

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column, seed: str) -> Column:
    """A hash of ``HASH_BITS`` bits that orders a source's documents."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def by_source(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows with the line of their source; null sources meet."""
    lines = lines.withColumnRenamed("source", "_line_source")
    count, names = lines.agg(F.count(F.lit(1)), F.sum(F.octet_length("_line_source"))).first()
    if 64 * count + (names or 0) <= SENT_BYTES:
        lines = F.broadcast(lines)
    return rows.join(lines, F.col("source").eqNullSafe(F.col("_line_source"))).drop("_line_source")


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Add ``weight``, repeating over the sources in code point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, starts = 0, {}
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.count(F.lit(1))).collect()):
        starts[part], before = before, before + n
    # one entry for each partition
    start = F.lit(0)
    for part, n in starts.items():
        start = F.when(F.col("part") == part, F.lit(n)).otherwise(start)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + start
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return ranged.withColumn("weight", weight.cast("long")).drop("part")


def water_filled(sources: DataFrame, budget: tuple[int, int], most: int) -> DataFrame:
    """Add ``target`` to rows of source, size and weight."""
    up, down = budget
    size, weight = F.col("size"), F.col("weight")
    total, all_weight = (x or 0 for x in sources.agg(F.sum("size"), F.sum("weight")).first())
    clamped, clamped_weight = 0, 0
    while True:
        # the level is what is left for each unit of weight, level / (down * open_weight)
        level, open_weight = up * total - down * clamped, all_weight - clamped_weight
        if not open_weight:
            return sources.withColumn("target", (most * size).cast("double"))
        full = size.cast("double") / weight.cast("double") <= F.lit(float(level) / (most * down * open_weight))
        found = sources.where(full).agg(F.sum(most * size), F.sum("weight")).first()
        if (found[0] or 0, found[1] or 0) == (clamped, clamped_weight):
            share = (weight * F.lit(level).cast("long")).cast("double") / F.lit(float(down * open_weight))
            return sources.withColumn("target", F.when(full, (most * size).cast("double")).otherwise(share))
        clamped, clamped_weight = found[0] or 0, found[1] or 0


def edges(rows: DataFrame, buckets: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source its size, target, whole epochs, and the hash (null: none) and share at the edge of the rest."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    lines = targets.withColumn("whole", whole.cast("long"))
    lines = lines.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("size"))
    lines = written(lines.withColumnRenamed("size", "source_size").drop("weight"), "mix-targets")

    def edge(groups: DataFrame, key: str) -> DataFrame:
        """The first group of each source at whose end the rest is used up, and what is taken before it."""
        ordered = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        placed = groups.withColumn("before", F.coalesce(F.sum("words").over(ordered), F.lit(0)) + F.col("base"))
        over = placed.where(F.col("before") + F.col("words") > F.col("rest"))
        return over.groupBy("source").agg(F.min_by(F.struct(key, "before", "rows", "rest"), key).alias("e")).select("source", "e.*")

    rest = lines.select("source", "rest")
    first = edge(by_source(buckets, rest).withColumn("base", F.lit(0)), "bucket")
    first = written(first.select("source", F.col("bucket").alias("edge_bucket"), F.col("before").alias("base"), "rest"), "mix-buckets")
    inside = by_source(rows, first).where("bucket = edge_bucket")
    hashes = inside.groupBy("source", "place", "base", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    last = edge(hashes, "place").select(
        F.col("source").alias("_edge_source"),
        F.col("place").alias("edge"),
        F.floor((F.col("rest") - F.col("before")) / F.col("rows")).cast("long").alias("share"),
    )
    return written(lines.join(last, F.col("source").eqNullSafe(F.col("_edge_source")), "left").drop("_edge_source"), "mix-edges")


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The documents with size, source_size, target (both of their source) and taken (words, repeats counted)."""
    kept = [c for c in documents.columns if c not in ADDED]
    sized = documents.select(
        F.struct(*kept).alias("document"),
        "source",
        words_of(F.col("text")).alias("size"),
        place_of(F.col("doc_id"), F.col("text"), seed).alias("place"),
    )
    bucket = F.shiftright("place", HASH_BITS - BUCKET_BITS)
    rows = written(sized.select("source", "size", "place", bucket.alias("bucket")), "mix-rows")
    buckets = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sources = weighted(buckets.groupBy("source").agg(F.sum("words").alias("size")), weights)
    lines = edges(rows, buckets, water_filled(written(sources, "mix-weights"), budget, most))
    extra = (
        F.when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), F.col("size"))
        .when(F.col("place") == F.col("edge"), F.least("size", "share"))
        .otherwise(0)
    )
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    return by_source(sized, lines).select("document.*", "size", "source_size", "target", taken.alias("taken"))


def repetitions(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken: repetition (from 1), n_words and the text, cut after these words."""
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.col("taken") - full * F.col("size")
    times = (full + (rest > 0).cast("long")).cast("int")
    one = mixed.withColumn("repetition", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    n_words = F.when(F.col("repetition") <= full, F.col("size")).otherwise(rest)
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), n_words.cast("int")), "")
    return one.withColumn("n_words", n_words).withColumn("text", F.when(F.col("n_words") == F.col("size"), F.col("text")).otherwise(cut))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, source_size / weight AS ratio, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i,
         sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT *, 3 * total - 2 * (coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
         sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ratios
), water AS (
  SELECT level, open_weight FROM levels WHERE ratio > CAST(level AS DOUBLE) / CAST(4 * open_weight AS DOUBLE) ORDER BY i LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN NOT EXISTS (FROM water) OR ratio <= (SELECT CAST(level AS DOUBLE) / CAST(4 * open_weight AS DOUBLE) FROM water)
         THEN CAST(2 * source_size AS DOUBLE)
         ELSE (SELECT CAST(weight * level AS DOUBLE) / CAST(2 * open_weight AS DOUBLE) FROM water) END AS target
  FROM ratios
), rests AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets
), placed AS (
  SELECT d.*, source_size, target, whole, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY substr(place, 1, 15)) AS until,
         sum(size) OVER (PARTITION BY d.source, substr(place, 1, 15)) AS words,
         count(*) OVER (PARTITION BY d.source, substr(place, 1, 15)) AS rows_
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN until <= rest THEN size
            WHEN until - words < rest THEN least(size, (rest - (until - words)) // rows_) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""


@register(SQL)
def op12_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *ADDED)
