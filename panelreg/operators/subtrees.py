"""Finishing the small nodes of growing trees, each in one task.

Histograms pay as long as a node has more rows than bins; below that every further level would scan the
whole table for a few rows. A node of at most ``LOCAL_ROWS`` rows is handed over instead: one scan
sends the rows of all such nodes to a task for each (tree, node), once, and the task grows the node's
whole subtree with the rules that the histograms follow. A task holds the rows of one node; the rows of a
lot of nodes, ``HANDED_ROWS`` at most, are shuffled at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from panelreg.operators.trees import FeatureSpace, PackedTree, RowRule, SplitRules

LOCAL_ROWS = 100_000
#: Numbers that a task holds at most, the bins of a row and ``ROW_NUMBERS`` more for its gradient, weight and
#: order: nodes of fewer rows are handed over where there are many columns, whatever ``local_rows`` says.
LOCAL_CELLS = 4_000_000
ROW_NUMBERS = 5
HANDED_ROWS = 100_000_000
#: Nodes with fewer rows are searched by sorting them, larger ones by sums per bin.
SORTED_ROWS = 512

#: A row for each finished node; the lists hold its subtree's splits in the order they were made.
FINISHED = {"tree": pa.int32(), "node": pa.int64(), "g": pa.float64(), "h": pa.float64()}
FINISHED |= dict.fromkeys(("parent", "depth", "feature", "bin"), pa.list_(pa.int32()))
FINISHED |= dict.fromkeys(("gain", "g_all", "h_all", "g_right", "h_right"), pa.list_(pa.float64()))
FINISHED_SCHEMA = (
    "tree int, node long, g double, h double, parent array<int>, depth array<int>, feature array<int>, bin array<int>, "
    "gain array<double>, g_all array<double>, h_all array<double>, g_right array<double>, h_right array<double>"
)


@dataclass(frozen=True)
class Split:
    """The chosen split of a node: the feature, its bin, the gain, and the sums of all rows and of those to the right."""

    feature: int
    bin: int
    gain: float
    g_all: float
    h_all: float
    g_right: float
    h_right: float


class NodeSearch:
    """The best split of a set of rows held in memory, by the rules of the histograms.

    Rows are (rows x slots) bins, codes being shifted by one, with gradient and weight."""

    def __init__(self, space: FeatureSpace, rules: SplitRules):
        self.rules = rules
        self.offsets = space.offsets
        self.numeric = np.array([slot for slot in range(len(space.sizes)) if slot in space.cuts], dtype=np.int64)
        self.coded = np.array([slot for slot in range(len(space.sizes)) if slot not in space.cuts], dtype=np.int64)
        self.bins = max((space.sizes[slot] for slot in self.numeric), default=0)
        self.features = space.features
        self.feature_of = np.full(int(self.offsets[-1]), -1)
        feature, _, position = space.cells()
        self.feature_of[position] = feature

    def _numeric_cells(self, bins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, bin, sums of the bin and all later ones) of the bins that hold rows; ``values`` are rows of g, h and one."""
        n, slots = len(bins), self.numeric
        table = bins[:, slots]
        if n >= SORTED_ROWS:
            cell = (np.arange(len(slots)) * self.bins + table).ravel()
            shape = (len(slots), self.bins)
            sums = np.stack([np.bincount(cell, np.repeat(v, len(slots)), len(slots) * self.bins).reshape(shape) for v in values])
            later = np.cumsum(sums[:, :, ::-1], axis=2)[:, :, ::-1]
            slot, found = np.nonzero(sums[2] > 0)
            return slots[slot], found, later[:, slot, found]
        order = np.argsort(table, axis=0, kind="stable")
        ranked = np.take_along_axis(table, order, 0)
        later = np.cumsum(values[:, order][:, ::-1], axis=1)[:, ::-1]
        first = np.ones(ranked.shape, bool)
        first[1:] = ranked[1:] != ranked[:-1]
        row, slot = np.nonzero(first)
        return slots[slot], ranked[row, slot], later[:, row, slot]

    def _coded_cells(self, bins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, sums) of the levels that rows have."""
        position = (bins[:, self.coded] + self.offsets[self.coded]).ravel()
        found, place = np.unique(position, return_inverse=True)
        return found, np.stack([np.bincount(place, np.repeat(v, len(self.coded)), len(found)) for v in values])

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        rules = self.rules
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h + rules.lambda_ != 0, np.maximum(np.abs(g) - rules.alpha, 0.0) ** 2 / (h + rules.lambda_), np.nan)

    def best(self, tree: int, name: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, mask: np.ndarray | None) -> Split | None:
        rules = self.rules
        least = max(rules.min_rows, 1)
        if len(bins) < 2 * least:
            return None
        values = np.stack([g, h, np.ones(len(g))])
        whole = values.sum(axis=1)
        features, found, sums = [], [], []
        if len(self.numeric):
            slot, at, later = self._numeric_cells(bins, values)
            # nothing lies left of the first bin
            inner = at > 0
            features.append(self.feature_of[self.offsets[slot[inner]] + at[inner]])
            found.append(at[inner])
            sums.append(later[:, inner])
        if len(self.coded):
            position, own = self._coded_cells(bins, values)
            features.append(self.feature_of[position])
            found.append(np.ones(len(position), dtype=np.int64))
            sums.append(own)
        if not features:
            return None
        feature, at, right = np.concatenate(features), np.concatenate(found), np.concatenate(sums, axis=1)
        left = whole[:, None] - right
        gain = self.score(left[0], left[1]) + self.score(right[0], right[1]) - self.score(whole[:1], whole[1:2])
        valid = (feature >= 0) & (right[2] >= least) & (left[2] >= least) & (gain > rules.gamma)
        valid &= (right[1] >= rules.min_weight) & (left[1] >= rules.min_weight)
        if mask is not None:
            valid &= mask[np.maximum(feature, 0)]
        if not valid.any():
            return None
        if rules.tried is not None:
            admitted = np.unique(feature[valid]).tolist()
            turns = sorted(admitted, key=lambda f: hashlib.md5(f"{tree}:{name}:{f}:{rules.seed}".encode()).hexdigest())
            valid &= np.isin(feature, turns[: rules.tried])
        kept = np.flatnonzero(valid)
        close = np.round(gain[kept] / gain[kept].max(), 9)
        kept = kept[close == close.max()]
        i = kept[np.lexsort((at[kept], feature[kept]))[0]]
        return Split(int(feature[i]), int(at[i]), float(gain[i]), *map(float, (whole[0], whole[1], right[0, i], right[1, i])))

    def goes_right(self, bins: np.ndarray, split: Split) -> np.ndarray:
        spec = self.features[split.feature]
        return bins[:, spec.slot] >= split.bin if spec.level is None else bins[:, spec.slot] == spec.level + 1

    def grow(
        self, tree: int, name: int, depth: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, mask: np.ndarray | None
    ) -> list[tuple[int, int, Split]]:
        """(node, depth, split) level by level: node 0 is the given one, each split adds its left and its right one."""
        made, count = [], 1
        open_ = [(0, name, np.arange(len(g)))]
        while open_ and (self.rules.max_depth is None or depth < self.rules.max_depth):
            following = []
            for node, known_as, rows in open_:
                split = self.best(tree, known_as, bins[rows], g[rows], h[rows], mask)
                if split is None:
                    continue
                made.append((node, depth, split))
                right = self.goes_right(bins[rows], split)
                for side, kept in enumerate((rows[~right], rows[right])):
                    following.append((count + side, child_name(known_as, side), kept))
                count += 2
            open_, depth = following, depth + 1
        return made


#: Names of nodes grow like those of a heap up to here; they only decide the order in which a node tries its features.
MOST_NAME = 1 << 61


def child_name(name: int, side: int) -> int:
    return (2 * name + 1 + side) % MOST_NAME


def most_local_rows(local_rows: int, slots: int) -> int:
    """The rows of the largest node that is handed over."""
    return min(local_rows, LOCAL_CELLS // (slots + ROW_NUMBERS))


def handed_rows(source: DataFrame, space: FeatureSpace, rule: RowRule, handed: dict[int, tuple[PackedTree, list[int]]]) -> DataFrame:
    """tree, node, g, h and the bins of the drawn rows of the handed nodes; and of each task the errors, under the tree TOTALS."""
    from panelreg.operators.trees import TOTALS, drawn_rows

    names = ["tree", "node", "g", "h", *(f"s{i}" for i in range(len(space.sizes)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = np.zeros(2)

        def report(columns: dict[str, np.ndarray], gradient: np.ndarray) -> None:
            error[:] += rule.errors(columns, gradient)

        def made(columns: list, bins: np.ndarray) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64())
            fixed = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*fixed, *(pa.array(bins[:, i].astype(np.int32)) for i in range(len(space.sizes)))], names)

        for batch in batches:
            for t, nodes, at, g, h, bins in drawn_rows(batch, space, rule, handed, report if rule.errors is not None else None):
                yield made([np.full(len(at), t), np.array(nodes)[at], g, h], bins)
        if rule.errors is not None:
            yield made([[TOTALS], [0], error[:1], error[1:]], np.zeros((1, len(space.sizes)), int))

    kinds = ["int", "long", "double", "double", *["int"] * len(space.sizes)]
    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def finish_subtrees(
    source: DataFrame,
    space: FeatureSpace,
    rule: RowRule,
    rules: SplitRules,
    handed: dict[int, tuple[PackedTree, list[int]]],
    places: dict[tuple[int, int], tuple[int, int]],
    masks: dict[tuple[int, int], np.ndarray] | None = None,
) -> DataFrame:
    """A row for each handed (tree, node): its sums, and the splits of its subtree in the order they were made.

    ``places`` has each node's name and depth. Errors come as the sums of a row of the tree TOTALS."""

    def finish(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        g, h = (table[c].to_numpy() for c in "gh")
        made = []
        if (tree, node) in places:
            slots = [table[f"s{i}"].to_numpy() for i in range(len(space.sizes))]
            bins = np.column_stack(slots) if slots else np.zeros((len(g), 0), np.int64)
            mask = masks[tree, node] if masks else None
            made = NodeSearch(space, rules).grow(tree, *places[tree, node], bins, g, h, mask)
        columns = {"tree": [tree], "node": [node], "g": [g.sum()], "h": [h.sum()]}
        columns |= {"parent": [[n for n, _, _ in made]], "depth": [[d for _, d, _ in made]]}
        columns |= {f: [[getattr(s, f) for _, _, s in made]] for f in FINISHED if f not in columns}
        return pa.table([pa.array(columns[f], kind) for f, kind in FINISHED.items()], list(FINISHED))

    return handed_rows(source, space, rule, handed).groupBy("tree", "node").applyInArrow(finish, FINISHED_SCHEMA)


def lots(handed: Sequence[tuple[int, int, int]], limit: int = HANDED_ROWS) -> Iterator[dict[int, list[int]]]:
    """(tree, node, rows) as {tree: nodes} with at most ``limit`` rows together, or a single node."""
    group: dict[int, list[int]] = {}
    total = 0
    for tree, node, rows in handed:
        if group and total + rows > limit:
            yield group
            group, total = {}, 0
        group.setdefault(tree, []).append(node)
        total += rows
    if group:
        yield group
