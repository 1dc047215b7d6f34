"""BagMinHash estimates, and classes against a brute force over all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelreg.llm.batches import mixed
from panelreg.llm.near_dedup import components, near_classes, shingle_bags, signatures
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def bag(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return Counter([text or ""])
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(docs, near=0.8):
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(k, bag(t)) for k, t in docs]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            shared = sum((x & y).values())
            if shared and shared / (x.total() + y.total() - shared) >= near:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in root}


def test_words_that_share_polynomial_hashes(spark):
    texts = ["".join(pair[bin(i).count("1") % 2] for i in range(n)) for n in (1024, 4096) for pair in ("ab", "ba")]
    docs = [(i, t + " and one two three four") for i, t in enumerate(texts)] + [(9, "".join(".!"[bin(i).count("1") % 2] for i in range(1024))), (10, "".join("!."[bin(i).count("1") % 2] for i in range(1024)))]
    rows = near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["class_size"] == 1 for r in rows)


def test_estimates_are_weighted_jaccard():
    plain = [f"w{i}" for i in range(200)]
    pairs = [
        (plain, plain[:100] + ["x"] + plain[101:]),
        (["p", "q", "r", "s", "t"] * 50 + plain, ["p", "q", "r", "s", "t"] * 30 + plain),
        (plain, plain[:100]),
        (["a"] * 900, ["a"] * 500),
    ]
    for x, y in pairs:
        a, b = bag(" ".join(x)), bag(" ".join(y))
        truth = sum((a & b).values()) / sum((a | b).values())
        owner, code, weight = shingle_bags([" ".join(x), " ".join(y)])
        assert weight.sum() == a.total() + b.total()
        same = []
        for seed in range(60):
            one, two = signatures(owner, mixed(code ^ np.uint64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)), weight, 2)
            same.append((one == two).mean())
        assert abs(np.mean(same) - truth) < 0.03


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op2_bag_min_hash"](spark, SF).collect()
    expected = brute_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in rows} == expected
    sizes = Counter(expected.values())
    assert max(sizes.values()) > 1 and all(r["class_size"] == sizes[r["class_id"]] for r in rows)


def test_groups_and_odd_rows(spark):
    rng = random.Random(9)
    docs, key = [], 0
    common = [f"c{i}" for i in range(60)]
    for group in range(12):
        base = [f"g{group}x{i}" for i in range(150)]
        for copy in range(40 if group == 0 else 4):
            words = list(base) + common
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(150)] = f"n{rng.random()}"
            docs.append((key, " ".join(words)))
            key += 1
    docs += [(900, None), (901, ""), (902, "?!"), (903, "?!"), (904, "One two"), (905, "one, TWO"), (906, "z " * 40_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1))
    found = {r["doc_id"]: r["class_id"] for r in near_classes(frame).collect()}
    assert found == brute_classes(docs)
    assert near_classes(frame.limit(0)).count() == 0


def test_pairs_that_share_a_passage(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(150)]
    docs = []
    for pair in range(150):
        own = [f"o{pair}x{i}" for i in range(30)]
        docs.append((2 * pair, " ".join(passage + own)))
        for at in (4, 14, 22):
            own[at + rng.randrange(3)] = f"n{pair}x{at}"
        docs.append((2 * pair + 1, " ".join(passage + own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_classes(frame).collect()}
    x, y = bag(docs[0][1]), bag(docs[1][1])
    assert sum((x & y).values()) / sum((x | y).values()) >= 0.8
    assert [k for k, c in found.items() if c != k - k % 2] == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(100, i) for i in range(101, 140)]
    edges += [tuple(rng.sample(range(200, 240), 2)) for _ in range(30)]
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: found.get(n, n) for n in root} == root
