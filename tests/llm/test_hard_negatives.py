"""Hard negatives against plain loops over whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelreg.llm import hard_negatives
from panelreg.llm.hard_negatives import Tree, mine, spanning_tree
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows):
    """Rows of (vec_id, embedding, label, ...) by the definition."""
    kept = []
    for key, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        kept.append((key, [math.floor(256 * x) for x in vector], moved))
    found = []
    for i, (anchor, vector, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [
            (-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(vector, other)))), key is None, key or 0, key, same == label)
            for j, (key, other, same) in enumerate(kept)
            if j != i
        ]
        scored.sort(key=lambda s: s[:3])
        for score, _, _, positive, _ in [s for s in scored if s[4]][:5]:
            window = [s for s in scored if not s[4] and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            found += [(anchor, positive, rank, s[3], -score, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(found, key=repr)


def mined(frame):
    return sorted((tuple(r) for r in mine(frame).collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op11_anchor_tree"](spark, SF)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def clustered(n, seed):
    """Vectors in tight groups, with many copies and ties, so that the bounds leave rows out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(0, 12, n)] + 0.02 * np.round(rng.normal(size=(n, 8)), 1)
    vectors[: n // 3] = centres[0]
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4)), "r") for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("block", "sent"), [(1024, 1 << 22), (4, 100)])
def test_clusters_in_several_lots(spark, block, sent, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SENT_NUMBERS", sent)
    rows = clustered(1_500, 5)
    assert mined(spark.createDataFrame(rows, KIND).repartition(5)) == plain(rows)


def test_bounds_leave_candidates_out():
    rows = np.floor(256 * np.array([v for _, v, _, _ in clustered(900, 6)]))
    anchors = rows[::30]
    order, parent, edge = spanning_tree(anchors)
    block = {"row": range(len(anchors)), "vec_id": range(len(anchors)), "label": [0] * len(anchors), "vector": anchors.ravel()}
    tree = Tree(block | {"order": order.tolist(), "parent": parent, "edge": edge})
    exact = rows @ anchors.T
    scored = 0
    for node, found, score in tree.walk(rows, lambda node, low, high: high >= exact[:, node].max()):
        assert (score == exact[found, node]).all() and exact[:, node].argmax() in found
        scored += len(found)
    assert sorted(order.tolist()) == list(range(len(anchors)))
    assert scored < 0.8 * exact.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1, "a"),
        (0, [1.0, 2.0], 1, "a"),
        (None, [1.0, 2.0], 2, "b"),
        (None, [1.0, 1.5], 2, "b"),
        (1, [1.0], 2, None),
        (2, [1.0, 1.9, 0.5], 3, "c"),
        (3, None, 2, "c"),
        (4, [1.0, None], 2, "c"),
        (5, [1.0, nan], 2, "c"),
        (6, [1.0, inf], 2, "c"),
        (8, [1.0, 2.0], None, "c"),
        (7, [1.0, 1.9], 0, "moved"),
        (9, [1.0, 1.95], 1, "d"),
        (10, [], 1, "d"),
        (100, [-1.0, -2.0], 1, "d"),
        (200, [2e6, 4e6], 4, "large"),
        (201, [1.8e6, 4e6], 4, "large"),
        (202, [1.9e6, 3.4e6], 5, "large"),
        (203, [1e30, -1.0], 5, "beyond 64 bits"),
    ]
    # shorter vectors go on with zeros
    padded = [(k, None if v is None else [*v, *[0.0] * (3 - len(v))], label, x) for k, v, label, x in rows]
    padded = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, x) for k, v, label, x in padded]
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    assert mined(frame) == plain(padded)
    assert mined(frame) != []
    assert mine(frame.limit(0)).count() == 0
    assert mine(frame.where("vec_id = 5")).count() == 0
