"""Finishing small nodes in a task gives the trees that histograms give."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from panelreg.operators import subtrees, trees
from panelreg.operators.boosting import BoostSettings, fit_boosting
from panelreg.operators.forest import ForestSettings, fit_forest
from panelreg.operators.preprocess import PrepSettings, fit_preparation
from panelreg.operators.subtrees import lots
from panelreg.sources.roles import FeatureColumns


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    n = 4_000
    pdf = pd.DataFrame(
        {
            "key": np.arange(n),
            "a": rng.normal(size=n).round(1),
            "b": rng.integers(0, 30, n) / 10.0,
            "c": rng.choice(["u", "v", "w", "z"], n, p=[0.5, 0.3, 0.15, 0.05]),
            "d": rng.integers(0, 40, n).astype(str),
        }
    )
    pdf["label"] = 0.5 * pdf.a + np.sin(2 * pdf.b) + 2.0 * (pdf.c == "w") + (pdf.d.astype(int) % 3) + rng.normal(0, 0.2, n)
    frame = spark.createDataFrame(pdf)
    preparation = fit_preparation(frame, FeatureColumns(("a", "b"), ("c", "d")), PrepSettings(drop_first=True))
    return preparation.apply(frame).persist(), preparation


def shape(tree):
    """Splits and leaves from the root on, whatever the nodes' numbers."""

    def below(node):
        if tree.feature[node] < 0:
            return (round(tree.value[node], 9), round(tree.weight[node], 6))
        return (tree.feature[node], tree.bin[node], tree.cut[node], round(tree.gain[node], 6), tree.name[node], below(tree.left[node]), below(tree.right[node]))

    return below(0), tree.depth


@pytest.mark.parametrize(
    "settings",
    [
        ForestSettings(n_trees=3, max_depth=5, min_rows_leaf=7, max_features=1.0, seed=9),
        ForestSettings(n_trees=3, max_depth=4, min_rows_leaf=3, max_features=2, seed=1),
        ForestSettings(n_trees=2, min_rows_leaf=60, max_features="sqrt", seed=4, max_bins=16),
    ],
)
def test_forests_do_not_depend_on_where_nodes_are_finished(sample, settings, monkeypatch):
    prepared, preparation = sample
    grown = []
    for rows, sorted_rows in ((0, 512), (700, 512), (100_000, 512), (100_000, 10**9), (100_000, 0)):
        monkeypatch.setattr(subtrees, "SORTED_ROWS", sorted_rows)
        forest, binned = fit_forest(prepared, preparation, replace(settings, local_rows=rows))
        binned.unpersist()
        grown.append([shape(t) for t in forest.trees])
    assert all(g == grown[0] for g in grown[1:])


def test_boosting_with_column_masks_and_held_rows(sample):
    prepared, preparation = sample
    rows = prepared.withColumn("fold", (prepared["key"] % 5 == 0).cast("int"))
    settings = BoostSettings(n_rounds=4, learning_rate=0.5, max_depth=5, subsample=0.8, column_share=0.5, alpha=0.5, gamma=0.5, min_child_weight=4, refresh_rounds=2)
    grown = []
    for limit in (0, 900, 100_000):
        model = fit_boosting(rows, preparation, replace(settings, local_rows=limit), fold="fold")
        grown.append(([shape(t) for t in model.trees], [round(e, 9) for e in model.curve]))
    assert len(grown[0][1]) == 4 and grown[0] == grown[1] == grown[2]


def test_few_scans_for_many_deep_trees(sample, monkeypatch):
    """Scans of the table: one for each level that has a large node, and one for all small nodes."""
    prepared, preparation = sample
    scans = []
    monkeypatch.setattr(trees, "histogram_cells", lambda *a, real=trees.histogram_cells: scans.append("level") or real(*a))
    monkeypatch.setattr(trees, "finish_subtrees", lambda *a, real=trees.finish_subtrees: scans.append("lot") or real(*a))
    settings = ForestSettings(n_trees=12, max_depth=9, max_features=1.0)
    fit_forest(prepared, preparation, replace(settings, local_rows=1_500))
    with_lots = list(scans)
    assert with_lots.count("level") <= 6 and with_lots.count("lot") == 1
    scans.clear()
    fit_forest(prepared, preparation, replace(settings, local_rows=0))
    assert scans == ["level"] * 9


def test_of_two_siblings_one_is_summed(sample, monkeypatch):
    """Rows that enter a level's histograms: all of them at the root, at most half of them below."""
    prepared, preparation = sample
    asked = []

    def spy(source, space, rule, growing, chosen=None, real=trees.histogram_cells):
        asked.append({t: (tree, list(nodes)) for t, (tree, nodes) in growing.items()})
        return real(source, space, rule, growing, chosen)

    monkeypatch.setattr(trees, "histogram_cells", spy)
    forest, binned = fit_forest(prepared, preparation, ForestSettings(n_trees=2, max_depth=4, max_features=1.0, local_rows=0))
    table = binned.select(*forest.space.columns).toPandas().to_numpy()
    assert len(asked) == 4
    for level, growing in enumerate(asked):
        for tree, nodes in growing.values():
            share = np.isin(tree.leaves(table, binned=True), nodes).mean()
            assert share == 1.0 if level == 0 else share <= 0.55, (level, share)


def test_siblings_by_subtraction(spark):
    kind = "tree int, node long, feature int, bin int, g double, h double, c double"
    parents = spark.createDataFrame([(0, 7, -1, 0, 10.0, 9.0, 9.0), (0, 7, 2, 1, 4.0, 5.0, 5.0), (0, 7, 2, 3, 6.0, 4.0, 4.0), (1, 7, 2, 1, 1.0, 1.0, 1.0)], kind)
    cells = spark.createDataFrame([(0, 15, -1, 0, 3.0, 4.0, 4.0), (0, 15, 2, 1, 3.0, 1.0, 1.0), (0, 15, 2, 3, 0.0, 4.0, 4.0)], kind)
    rows = {tuple(r)[:4]: tuple(r)[4:] for r in trees.with_siblings(cells, parents, [(0, 7, 15, 16)]).collect()}
    assert rows[0, 16, -1, 0] == (7.0, 5.0, 5.0) and rows[0, 16, 2, 1] == (1.0, 4.0, 4.0)
    assert (0, 16, 2, 3) not in rows and len(rows) == 5


def test_a_task_holds_a_bounded_part_however_many_rows_are_asked_for(sample, monkeypatch):
    """Handed nodes stay within LOCAL_CELLS; the trees are those of one pass."""
    prepared, preparation = sample
    settings = BoostSettings(n_rounds=2, learning_rate=0.5, max_depth=4, min_child_weight=4, local_rows=10**9)
    whole = fit_boosting(prepared, preparation, settings)
    handed = []

    def spy(given, limit=subtrees.HANDED_ROWS, real=trees.lots):
        handed.extend(rows for _, _, rows in given)
        return real(given, limit)

    monkeypatch.setattr(trees, "lots", spy)
    monkeypatch.setattr(subtrees, "LOCAL_CELLS", 9_000)
    bounded = fit_boosting(prepared, preparation, settings)
    assert handed and max(handed) <= 9_000 // (4 + subtrees.ROW_NUMBERS)
    assert [shape(t) for t in bounded.trees] == [shape(t) for t in whole.trees]
    # four columns are worth five more numbers a row, and a task may hold no more than four million
    monkeypatch.undo()
    assert subtrees.most_local_rows(10**9, 3) == 500_000 and subtrees.most_local_rows(100_000, 35) == 100_000


def test_lots():
    nodes = [(0, 3, 5), (0, 4, 6), (1, 1, 20), (2, 0, 1), (2, 5, 1)]
    assert list(lots(nodes, 10)) == [{0: [3]}, {0: [4]}, {1: [1]}, {2: [0, 5]}]
    assert list(lots([], 10)) == []


def test_rows_that_cannot_be_split(spark):
    frame = spark.createDataFrame([(i, 1.0, "x", 3.0) for i in range(20)], "key long, a double, c string, label double")
    preparation = fit_preparation(frame, FeatureColumns(("a",), ("c",)), PrepSettings())
    forest, _ = fit_forest(preparation.apply(frame), preparation, ForestSettings(n_trees=2))
    assert [t.feature for t in forest.trees] == [[-1], [-1]] and all(t.value[0] == pytest.approx(3.0) for t in forest.trees)
