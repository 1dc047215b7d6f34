"""Decontamination against a brute force over every window of every item's size."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from panelreg.llm.decontamination import RADIUS, contaminated, described, fingerprint_of, words_of
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, items, near=0.8):
    found = {}
    for item, text in items:
        words = plain_words(text)
        if not words:
            continue
        width, size = min(5, len(words)), len(words)
        theirs = shingles(words, width)
        for doc, body in docs:
            mine = plain_words(body)
            if not shingles(mine, width) & theirs:
                continue
            for start in range(max(1, len(mine) - size + 1)):
                ours = shingles(mine[start : start + size], width)
                shared = sum((ours & theirs).values())
                if shared and shared / (ours.total() + theirs.total() - shared) >= near:
                    score = shared / (ours.total() + theirs.total() - shared)
                    found[doc, item] = max(score, found.get((doc, item), 0))
    return found


def test_query(spark):
    rows = QUERIES["op5_simhash_windows"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    expected = brute(docs, items)
    assert expected and {(r["doc_id"], r["item_id"]) for r in rows} == set(expected)
    assert all(abs(r["similarity"] - expected[r["doc_id"], r["item_id"]]) < 1e-9 for r in rows)


def test_edited_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((20, 35, 60))))) for i in range(12)] + [(50, "a b"), (51, None), (52, "x y x y x y x y x y x y")]
    docs = []
    for i in range(48):
        words = items[i % 12][1].split()
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + 1] = [[], ["new"], [words[at], "new"]][kind]
        noise = rng.choices(vocabulary, k=80)
        at = rng.choice((0, 40, 80))
        docs.append((i, " ".join(noise[:at]) + "!\n" + " ".join(words).upper() + ".\n" + " ".join(noise[at:])))
    docs += [(499, " ".join(items[1][1].split()[:-1])), (500, "q a, B c"), (501, "y x y x y x y x y x y x y"), (502, None), (503, ""), (504, items[0][1] + " x" * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x"))
    found = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute(docs[:-1], items) | {(504, 0): 1.0}
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(expected)


def test_items_that_repeat_their_shingles(spark):
    items = [(0, "x y " * 6 + "x"), (1, "a b " * 20 + "a"), (2, "p q r " * 9), (3, "k " * 40), (4, "m n " * 8 + "o")]
    docs = [
        (0, "y x " * 6 + "y"),
        (1, "b a " * 20 + "b"),
        (2, "before q r p " * 1 + "q r p " * 8 + "after"),
        (3, "k " * 34 + "end"),
        (4, "m n " * 8 + "m n o"),
        (5, "x y " * 3),
    ]
    expected = brute(docs, items)
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)} <= set(expected)
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == set(expected)


def test_bits_are_counted_beyond_sixteen_bits(spark):
    element = F.lit(-1).cast("long")
    rows = spark.range(1).select(fingerprint_of(F.array_repeat(element, 70_000)).alias("all"), fingerprint_of(F.concat(F.array_repeat(element, 70_000), F.array_repeat(F.lit(0).cast("long"), 69_999))).alias("most"))
    assert tuple(rows.first()) == (-1, -1)


def test_fingerprints_and_empty_tables(spark):
    rows = spark.createDataFrame([("a b c d e f g",), ("a b c d e f g",), ("a b c d e f h",)], "text string")
    frame = described(rows.select(words_of(F.col("text")).alias("words")))
    one, two, three = frame.collect()
    assert one == two != three and len(one["elements"]) == 3
    assert bin((one["fingerprint"] ^ three["fingerprint"]) & (1 << 64) - 1).count("1") <= RADIUS
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs, items).count() == 1
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0
