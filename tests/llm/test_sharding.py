"""Sharding against its law and against hand counts."""

from __future__ import annotations

import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from panelreg.llm.queries import QUERIES
from panelreg.llm.sharding import shard_of, with_slots

SF = "/root/testdata/sf0.001"


def placed(spark, weights, rows=4000):
    frame = spark.range(rows).withColumn("shard", shard_of(F.col("id"), weights))
    return {r["id"]: r["shard"] for r in frame.collect()}


def test_query(spark):
    rows = QUERIES["op1_shard_tree"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(rows["doc_id"]) == sorted(docs.index)
    for row in rows.itertuples():
        data = docs[row.doc_id].encode()
        assert (row.size, row.text_crc32, row.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert row.grown_shard in (row.shard, 24)
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_movement_stays_in_the_changed_subtree(spark):
    for n in (1, 4, 11, 12, 24, 25, 30):
        before, after = placed(spark, [1.0] * n), placed(spark, [1.0] * (n + 1))
        moved = [k for k in before if before[k] != after[k]]
        assert moved and all(after[k] == n for k in moved)
    before, after = placed(spark, [1.0] * 24), placed(spark, [1.0] * 5 + [3.0] + [1.0] * 18)
    assert all(after[k] == 5 for k in before if before[k] != after[k])


def test_weights_are_met(spark):
    counts = [0] * 8
    for shard in placed(spark, [1, 1, 2, 4, 0, 1, 1, 2], 24_000).values():
        counts[shard] += 1
    assert counts[4] == 0
    for count, weight in zip(counts, [1, 1, 2, 4, 0, 1, 1, 2], strict=True):
        assert abs(count - 2000 * weight) < 400


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, ""), (1, ""), (2, "x")], "doc_id long, shard_x string")
    frame = with_slots(rows.withColumn("shard", shard_of(F.col("doc_id"), [1.0] * 3)), "shard", 3, ("doc_id", "shard_x"), 4)
    found = frame.collect()
    assert len(found) == 5 and len({r["shard"] for r in found if r["doc_id"] is None}) == 1
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert with_slots(rows.limit(0).withColumn("shard", shard_of(F.col("doc_id"), [1.0])), "shard", 1, ("doc_id",), 4).count() == 0


def test_draws_by_hand(spark):
    """Every shard's draw from the library's hash, and the least one."""

    def draw(key, shard, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    weights = [1.0, 2.0, 0.5] * 8
    keys = [None, *range(-50, 400)]
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long").select("doc_id", shard_of(F.col("doc_id"), weights).alias("shard")).collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {k: min(range(24), key=lambda s: draw(k, s, weights[s])) for k in keys}
