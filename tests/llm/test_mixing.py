"""Mixing against a plain loop over the sources, and the laws of the mix."""

from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelreg.llm.mixing import mix, repetitions
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), budget=Fraction(3, 2), most=2):
    """Clamp one round after the other, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def check(rows):
    """Targets as by the loop, and what each source takes."""
    sizes, taken, targets, repeats = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        repeats[r["source"], r["doc_id"], r["text"]] += 1
        assert 0 <= r["taken"] <= 2 * r["size"]
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
    expected = plain_targets(sizes)
    assert targets == pytest.approx({s: float(t) for s, t in expected.items()}, rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5 + max(n for (source, _, _), n in repeats.items() if source == s)


def test_query_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mix(docs)
    check(mixed.collect())
    assert mixed.columns[: len(docs.columns)] == docs.columns
    first, again = (sorted(map(tuple, QUERIES["op12_water_filling"](spark, SF).collect())) for _ in range(2))
    assert first == again == sorted(tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", "taken").collect())


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [sorted(map(str, mix(docs.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("shape", [(100, 1, 1), (1, 1, 1, 1, 1, 1, 1), (1, 50, 2, 50, 0, 3), (3, 0, 0), (0,)])
def test_shapes(spark, shape):
    rows = [(i * 100 + j, "w " * (j + 1), f"s{i}") for i, n in enumerate(shape) for j in range(n)] + [(-1, "", f"s{i}") for i in range(len(shape))]
    check(mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_odd_rows(spark):
    rows = [(None, "a b c", None, 1.5)] * 40 + [(1, None, "x", 2.5), (2, "", "x", None), (3, "    \x1c", "é", 1.0), (4, "w\n" * 70_000, "z", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double").withColumn("place", F.lit(7)).withColumn("edge", F.lit("e"))
    found = mix(docs)
    assert found.columns == ["doc_id", "text", "source", "place", "edge", "size", "source_size", "target", "taken"]
    check(found.collect())
    assert len(found.collect()) == len(rows)
    assert mix(docs.limit(0)).count() == 0


def test_many_sources(spark):
    rows = spark.range(3_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 13 AS int)) AS text", "concat('s', id % 500) AS source")
    check(mix(rows).collect())


def test_repetitions_hold_the_taken_words(spark):
    mixed = mix(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = repetitions(mixed).collect()
    words = defaultdict(int)
    for r in rows:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) == r["n_words"]
        words[r["doc_id"]] += r["n_words"]
    assert {k: n for k, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}
