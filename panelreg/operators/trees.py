"""Growing regression trees level by level over a binned table.

One scan per level serves every tree that is growing: each task reduces its rows to sums per
(tree, node, feature, bin), those cells are added up in one shuffle whose size does not depend
on the number of rows, and the best split per node is picked with window functions. Only the
chosen splits, one row per growing node, reach the driver. Of two siblings only the smaller one is summed: the
cells of the other are those of their parent, kept from the level before, without it. Nodes that have become small leave this
scheme: their subtrees are finished by ``subtrees``, so the table is scanned for the upper levels only.

Boosting and forests share this: with gradient g and hessian h per row the split gain is the
second-order one; with g = -w*y and h = w it is variance reduction and a leaf is a mean.

A category is stored once as a code, not as dummies. The dummy of a level is the test
"code == level", whose two sides follow from the level's sums and the node's totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from panelreg.operators.preprocess import Preparation
from panelreg.operators.subtrees import LOCAL_ROWS, child_name, finish_subtrees, lots, most_local_rows

MAX_BINS = 256
SKETCH_ACCURACY = 10_000
CELL_BUDGET = 4_000_000
TOTALS = -1
ERRORS = -2
CELL_SCHEMA = "tree int, node long, feature int, bin int, g double, h double, c double"


@dataclass(frozen=True)
class Feature:
    """An encoded feature: a binned numeric column, or one level of a coded category."""

    name: str
    slot: int
    level: int | None = None


@dataclass(frozen=True)
class FeatureSpace:
    """Binned columns (slots), the features over them, and the cut points of numeric slots.

    A value falls right of every cut it reaches: bin b holds cuts[b-1] <= x < cuts[b].
    """

    columns: tuple[str, ...]
    features: tuple[Feature, ...]
    cuts: dict[int, tuple[float, ...]]
    sizes: tuple[int, ...]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, position) of all right sides a split can start with.

        The position is that of the bin among all slots' bins. A dummy has one such cell, its level.
        """
        feature, bins, position = [], [], []
        for number, spec in enumerate(self.features):
            own = np.arange(1, self.sizes[spec.slot]) if spec.level is None else np.array([1])
            feature.append(np.full(len(own), number))
            bins.append(own)
            position.append(self.offsets[spec.slot] + (own if spec.level is None else spec.level + 1) + np.zeros(len(own), dtype=int))
        parts = (feature, bins, position)
        return tuple(np.concatenate(p) if p else np.zeros(0, dtype=int) for p in parts)


@dataclass
class Tree:
    """A binary tree as parallel lists; node 0 is the root, a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    slot: list[int] = field(default_factory=lambda: [0])
    level: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    #: What a node is called where its features are drawn, whichever way it was grown.
    name: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def add_leaf(self, value: float, weight: float, name: int) -> int:
        node = len(self.feature)
        self.name.append(name)
        for name, item in (("feature", -1), ("slot", 0), ("level", -1), ("bin", 0), ("cut", 0.0), ("gain", 0.0)):
            getattr(self, name).append(item)
        self.left.append(node)
        self.right.append(node)
        self.value.append(value)
        self.weight.append(weight)
        return node

    def packed(self) -> "PackedTree":
        return PackedTree(
            *[np.array(v) for v in (self.slot, self.level, self.bin, self.cut, self.left, self.right, self.value, self.name)],
            self.depth,
        )


@dataclass(frozen=True)
class PackedTree:
    """What tasks need of a tree."""

    slot: np.ndarray
    level: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    name: np.ndarray
    depth: int

    def leaves(self, table: np.ndarray, binned: bool) -> np.ndarray:
        """Leaf of each row of a (rows x slots) table of bins, or of prepared values."""
        node = np.zeros(len(table), dtype=np.int64)
        rows = np.arange(len(table))
        threshold = self.bin if binned else self.cut
        for _ in range(self.depth):
            x = table[rows, self.slot[node]]
            level = self.level[node]
            goes_right = np.where(level >= 0, x == level, x >= threshold[node])
            node = np.where(goes_right, self.right[node], self.left[node])
        return node

    def predict(self, table: np.ndarray, binned: bool) -> np.ndarray:
        return self.value[self.leaves(table, binned)]


def feature_space(prepared: DataFrame, preparation: Preparation, max_bins: int = MAX_BINS) -> FeatureSpace:
    """Cut points of the prepared training rows.

    A column with few distinct values is cut at each of them; others at sketch quantiles. The
    sketches have a fixed size, and the distinct values are listed only where a count sketch
    says they are few.
    """
    numeric = preparation.numeric_columns
    cuts: dict[int, tuple[float, ...]] = {}
    if numeric:
        grid = [i / max_bins for i in range(1, max_bins)]
        sketch = prepared.agg(
            *[F.approx_count_distinct(c, 0.02).alias(f"n_{c}") for c in numeric],
            *[F.min(c).alias(f"min_{c}") for c in numeric],
            *[F.percentile_approx(c, grid, SKETCH_ACCURACY).alias(f"q_{c}") for c in numeric],
        ).first()
        few = [c for c in numeric if sketch[f"n_{c}"] <= max_bins * 1.1]
        listed: dict[str, list[float]] = {c: [] for c in few}
        if few:
            pairs = prepared.select(*few).unpivot([], few, "name", "value").distinct()
            for name, value in pairs.collect():
                listed[name].append(value)
        for slot, c in enumerate(numeric):
            values = sorted(listed[c]) if c in listed and len(listed[c]) <= max_bins else sorted(set(sketch[f"q_{c}"]))
            cuts[slot] = tuple(v for v in values if v is not None and v > sketch[f"min_{c}"])
    features = [Feature(step.column, slot) for slot, step in enumerate(preparation.numeric)]
    sizes = [len(cuts[slot]) + 1 for slot in range(len(numeric))]
    for slot, step in enumerate(preparation.categories, start=len(numeric)):
        features += [Feature(name, slot, code) for code, name in enumerate(step.dummies, start=step.first)]
        sizes.append(len(step.levels) + 1)
    return FeatureSpace(tuple(preparation.prepared_columns), tuple(features), cuts, tuple(sizes))


def bin_columns(prepared: DataFrame, space: FeatureSpace, keep: Sequence[str | Column]) -> DataFrame:
    """The binned table: ``keep`` and one smallint/int per slot, under the prepared names."""
    cut_slots = [slot for slot in space.cuts if space.cuts[slot]]
    names = [space.columns[slot] for slot in cut_slots]
    if names:
        prepared = Bucketizer(
            splitsArray=[[-float("inf"), *space.cuts[slot], float("inf")] for slot in cut_slots],
            inputCols=names,
            outputCols=[f"bin_{n}" for n in names],
            handleInvalid="keep",
        ).transform(prepared)
    bins = []
    for slot, name in enumerate(space.columns):
        if slot in space.cuts:
            source = F.col(f"bin_{name}").cast("int") if space.cuts[slot] else F.lit(0)
        else:
            source = F.col(name)
        bins.append(source.cast("int").alias(name))
    return prepared.select(*keep, *bins)


@dataclass(frozen=True)
class SplitRules:
    """When a split counts. ``alpha``/``lambda_`` are L1/L2 on leaf values, ``gamma`` the least gain.

    With ``tried`` a node looks at its features in an order drawn by a digest of (tree, node, feature,
    ``seed``) and takes the best split of the first so many that admit one, however many don't.
    """

    lambda_: float = 0.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_weight: float = 0.0
    min_rows: int = 1
    max_depth: int | None = None
    tried: int | None = None
    seed: int = 0

    def visited(self, candidates: str) -> str:
        """The candidates with the gain of features that their node doesn't get to set to NULL, as SQL."""
        if self.tried is None:
            return candidates
        order = f"md5(concat_ws(':', tree, node, feature, {self.seed}))"
        turn = f"dense_rank() OVER (PARTITION BY tree, node ORDER BY gain IS NULL, {order})"
        return (
            f"SELECT * EXCEPT (gain, turn), CASE WHEN turn <= {self.tried} THEN gain END AS gain "
            f"FROM (SELECT *, {turn} AS turn FROM ({candidates}))"
        )

    def leaf(self, g: float, h: float) -> float:
        pulled = np.sign(g) * max(abs(g) - self.alpha, 0.0)
        return float(-pulled / (h + self.lambda_)) if h + self.lambda_ > 0 else 0.0

    def score(self, g: str, h: str) -> str:
        """T(G)^2 / (H + lambda) with the soft threshold T, as SQL."""
        return f"try_divide(pow(greatest(abs({g}) - {self.alpha!r}D, 0D), 2), {h} + {self.lambda_!r}D)"


def candidates_sql(rules: SplitRules) -> str:
    """Gain of every admissible split from the summed ``{cells}``.

    The right side of a cell's split is the cell and all later bins of its feature. A totals
    row per node (feature -1) stays in with a NULL gain, so that no node is lost.
    """
    rows, weight = max(rules.min_rows, 1), rules.min_weight
    gain = (
        f"{rules.score('g_left', 'h_left')} + {rules.score('g_right', 'h_right')} - {rules.score('g_all', 'h_all')}"
    )
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
        WITH sums AS (
          SELECT tree, node, feature, bin,
                 sum(g) OVER later AS g_right, sum(h) OVER later AS h_right, sum(c) OVER later AS c_right,
                 max(CASE WHEN feature = {TOTALS} THEN g END) OVER whole AS g_all,
                 max(CASE WHEN feature = {TOTALS} THEN h END) OVER whole AS h_all,
                 max(CASE WHEN feature = {TOTALS} THEN c END) OVER whole AS c_all
          FROM {{cells}}
          WINDOW later AS (PARTITION BY tree, node, feature ORDER BY bin DESC {running}),
                 whole AS (PARTITION BY tree, node)
        ), sides AS (
          SELECT *, g_all - g_right AS g_left, h_all - h_right AS h_left, c_all - c_right AS c_left FROM sums
        ), gains AS (
          SELECT *, {gain} AS gain_any FROM sides
        )
        SELECT tree, node, feature, bin, g_right, h_right, c_right, g_all, h_all, c_all,
               CASE WHEN feature >= 0 AND c_right >= {rows} AND c_left >= {rows}
                     AND h_right >= {weight!r}D AND h_left >= {weight!r}D AND gain_any > {rules.gamma!r}D
                    THEN gain_any END AS gain
        FROM gains"""


def split_candidates(cells: DataFrame, rules: SplitRules) -> DataFrame:
    return cells.sparkSession.sql(candidates_sql(rules), cells=cells)


def best_splits(cells: DataFrame, rules: SplitRules) -> DataFrame:
    """One row per node. Gains within one part in 10^9 are a tie: lowest feature, then lowest bin."""
    return cells.sparkSession.sql(
        f"""
        SELECT tree, node, feature, bin, g_right, h_right, c_right, g_all, h_all, c_all, gain FROM (
          SELECT *, row_number() OVER (PARTITION BY tree, node
                                       ORDER BY round(gain / top, 9) DESC NULLS LAST, feature, bin) AS place
          FROM (SELECT *, max(gain) OVER (PARTITION BY tree, node) AS top FROM ({rules.visited(candidates_sql(rules))}))
        ) WHERE place = 1
        """,
        cells=cells,
    )


@dataclass(frozen=True)
class RowRule:
    """How a task turns a batch into per-row numbers; both run on numpy arrays.

    ``weights(tree, key)`` gives the row weights of a tree, None for all ones.
    ``gradient(columns, table)`` gives g for weight one (h is the weight). ``errors(columns, g)``
    gives (sum, count) of what should be reported back once per tree.
    """

    inputs: tuple[str, ...]
    weights: Callable[[int, np.ndarray], np.ndarray | None]
    gradient: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]
    errors: Callable[[dict[str, np.ndarray], np.ndarray], tuple[float, float]] | None = None


def _table(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]])


def drawn_rows(
    batch: pa.RecordBatch,
    space: FeatureSpace,
    rule: RowRule,
    growing: dict[int, tuple[PackedTree, list[int]]],
    report: Callable[[dict[str, np.ndarray], np.ndarray], None] | None = None,
) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, nodes, place among the nodes, g, h, bins) of a batch's rows in each tree's growing nodes.

    Codes start at -1 for an unknown level, so bins of a coded slot are shifted by one."""
    columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(rule.inputs)}
    table = _table(batch, len(rule.inputs)) if space.columns else np.zeros((batch.num_rows, 1), dtype=int)
    gradient = rule.gradient(columns, table)
    if report is not None:
        report(columns, gradient)
    bins = table + np.array([0 if slot in space.cuts else 1 for slot in range(len(space.sizes))]) if space.columns else table
    for t, (tree, nodes) in growing.items():
        place = np.full(len(tree.slot), -1)
        place[nodes] = np.arange(len(nodes))
        at = place[tree.leaves(table, binned=True)]
        weight = rule.weights(t, columns["key"])
        if "fold" in columns:
            weight = (columns["fold"] == 0) * (1.0 if weight is None else weight)
        used = at >= 0 if weight is None else (at >= 0) & (weight > 0)
        at = at[used]
        h = np.ones(len(at)) if weight is None else weight[used].astype(float)
        yield t, nodes, at, gradient[used] * h, h, bins[used]


def scan_source(binned: DataFrame, space: FeatureSpace, rule: RowRule) -> DataFrame:
    """The columns a level scan reads."""
    return binned.select(*rule.inputs, *space.columns)


def histogram_cells(
    source: DataFrame,
    space: FeatureSpace,
    rule: RowRule,
    growing: dict[int, tuple[PackedTree, list[int]]],
    chosen: Callable[[int, int], np.ndarray] | None = None,
) -> DataFrame:
    """Sums per (tree, node, feature, bin) of the growing nodes, with one totals row per node.

    ``source`` comes from ``scan_source``. ``growing`` maps a tree number to the tree so far and its open nodes; ``chosen(tree, node)``
    is the boolean mask of features that node may split on.
    """
    sizes, offsets = space.sizes, space.offsets
    width = int(offsets[-1])
    cell_feature, cell_bin, cell_position = space.cells()
    masks = {
        (t, node): chosen(t, node) if chosen else np.ones(len(space.features), dtype=bool)
        for t, (_, nodes) in growing.items()
        for node in nodes
    }

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, len(nodes), width)) for t, (_, nodes) in growing.items()}
        totals = {t: np.zeros((3, len(nodes))) for t, (_, nodes) in growing.items()}
        error = np.zeros(2)

        def report(columns: dict[str, np.ndarray], gradient: np.ndarray) -> None:
            error[:] += rule.errors(columns, gradient)

        for batch in batches:
            for t, nodes, at, g, h, drawn in drawn_rows(batch, space, rule, growing, report if rule.errors is not None else None):
                for k, w in enumerate((g, h, None)):
                    totals[t][k] += np.bincount(at, weights=w, minlength=len(nodes))
                for slot, size in enumerate(sizes):
                    cell = at * size + drawn[:, slot]
                    for k, w in enumerate((g, h, None)):
                        counted = np.bincount(cell, weights=w, minlength=len(nodes) * size)
                        sums[t][k, :, offsets[slot] : offsets[slot + 1]] += counted.reshape(len(nodes), size)
        for t, (_, nodes) in growing.items():
            yield _batch(_tree_cells(t, nodes, sums[t], totals[t]))
        if rule.errors is not None:
            yield _batch([[TOTALS], [TOTALS], [ERRORS], [0], [error[0]], [error[1]], [0.0]])

    def _tree_cells(t: int, nodes: list[int], sums: np.ndarray, totals: np.ndarray) -> list[np.ndarray]:
        allowed = np.array([masks[t, node] for node in nodes])[:, cell_feature]
        values = sums[:, :, cell_position]
        place, cell = np.nonzero((values[2] > 0) & allowed)
        seen = np.flatnonzero(totals[2] > 0)
        node_id = growing[t][0].name[nodes][np.concatenate([seen, place])]
        feature_id = np.concatenate([np.full(len(seen), TOTALS), cell_feature[cell]])
        bin_id = np.concatenate([np.zeros(len(seen), dtype=int), cell_bin[cell]])
        return [np.full(len(node_id), t), node_id, feature_id, bin_id, *np.hstack([totals[:, seen], values[:, place, cell]])]

    def _batch(columns) -> pa.RecordBatch:
        names = ["tree", "node", "feature", "bin", "g", "h", "c"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.float64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, type=ty) for c, ty in zip(columns, types)], names=names)

    partial = source.mapInArrow(cells, CELL_SCHEMA)
    return partial.groupBy("tree", "node", "feature", "bin").agg(*[F.expr(f"sum({v}) AS {v}") for v in "ghc"])


def with_siblings(cells: DataFrame, parents: DataFrame, pairs: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """The cells of summed nodes and those of their siblings, which are the parents' cells without them.

    ``pairs`` are (tree, parent, summed node, sibling). Row counts are whole, so a cell without rows is known exactly."""
    lines = F.broadcast(cells.sparkSession.createDataFrame(list(pairs), "tree int, parent long, summed long, sibling long"))
    place = ["tree", F.col("sibling").alias("node"), "feature", "bin"]
    whole = parents.join(lines.withColumnRenamed("parent", "node"), ["tree", "node"]).select(*place, "g", "h", "c")
    own = cells.join(lines.withColumnRenamed("summed", "node"), ["tree", "node"])
    rest = whole.unionByName(own.select(*place, *((-F.col(v)).alias(v) for v in "ghc")))
    left = rest.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(v).alias(v) for v in "ghc"]).where("c > 0.5")
    return cells.unionByName(left)


def _passes(open_nodes: dict[int, list[int]], width: int) -> Iterator[dict[int, list[int]]]:
    """Groups of growing nodes whose sums fit a task's memory together."""
    limit = max(CELL_BUDGET // (3 * max(width, 1)), 1)
    group: dict[int, list[int]] = {}
    room = limit
    for tree, nodes in open_nodes.items():
        while nodes:
            if room == 0:
                yield group
                group, room = {}, limit
            group[tree], nodes = nodes[:room], nodes[room:]
            room -= len(group[tree])
    if group:
        yield group


def grow_trees(
    binned: DataFrame,
    space: FeatureSpace,
    rule: RowRule,
    rules: SplitRules,
    tree_ids: Sequence[int],
    chosen: Callable[[int, int], np.ndarray] | None = None,
    on_errors: Callable[[float, float], None] | None = None,
    rows: int | None = None,
    local_rows: int = LOCAL_ROWS,
) -> list[Tree]:
    """Grow all the given trees together, one level at a time, and finish all nodes of up to ``local_rows`` rows in the end.

    ``rows`` is the number of rows a tree's root can have, if known. Tasks that finish a node hold at most
    LOCAL_CELLS numbers, so nodes of more rows than that allows are split by histograms, whatever ``local_rows`` is."""
    trees = {t: Tree() for t in tree_ids}
    local_rows = most_local_rows(local_rows, len(space.sizes))
    # the rows of each open node
    open_nodes = {t: {0: np.inf if rows is None else rows} for t in tree_ids}
    # (tree, node) of nodes to be finished: their rows and depth
    small: dict[tuple[int, int], tuple[int, int]] = {}
    depth = 0
    source = scan_source(binned, space, rule)
    most_tasks = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the cells of the level before, and for a summed node its sibling and parent
    kept: list[DataFrame] = []
    twins: dict[tuple[int, int], tuple[int, int]] = {}
    while open_nodes:
        for t, nodes in open_nodes.items():
            small |= {(t, node): (int(n), depth) for node, n in nodes.items() if n <= local_rows}
        derived = {(t, other) for (t, _), (other, _) in twins.items()}
        large = {t: [node for node, n in nodes.items() if n > local_rows and (t, node) not in derived] for t, nodes in open_nodes.items()}
        grown: dict[int, dict[int, float]] = {}
        parents = reduce(DataFrame.unionByName, kept) if kept else None
        before, kept = kept, []
        splitting = rules.max_depth is None or depth < rules.max_depth
        for group in _passes({t: nodes for t, nodes in large.items() if nodes}, int(space.offsets[-1])):
            packed = {t: (trees[t].packed(), nodes) for t, nodes in group.items()}
            summed = [(t, node) for t, nodes in group.items() for node in nodes]
            cells = histogram_cells(source, space, rule, packed, chosen)
            pairs = [(t, node, *twins[t, node]) for t, node in summed if (t, node) in twins]
            if pairs or rules.max_depth is None or depth + 1 < rules.max_depth:
                kept.append(cells.persist())
            if pairs:
                named = [(t, trees[t].name[parent], trees[t].name[node], trees[t].name[other]) for t, node, other, parent in pairs]
                before.append(kept.pop())
                cells = with_siblings(cells, parents, named).persist()
                kept.append(cells)
            by_name = {(t, trees[t].name[node]): node for t, node in [*summed, *((t, other) for t, _, other, _ in pairs)]}
            # all cells of a node meet in one task; there are as many tasks as open nodes, up to the default
            tasks = min(len(by_name), most_tasks)
            # added up by cell first: the partial sums of the root would crowd the task of its node
            for row in sorted(best_splits(cells.repartition(tasks, "tree", "node"), rules).collect(), key=lambda r: (r["tree"], r["node"])):
                if row["tree"] == TOTALS:
                    if on_errors is not None:
                        on_errors(row["g_right"], row["h_right"])
                    continue
                tree, node = trees[row["tree"]], by_name[row["tree"], row["node"]]
                if depth == 0:
                    tree.value[0], tree.weight[0] = rules.leaf(row["g_all"], row["h_all"]), row["h_all"]
                if row["gain"] is None or not splitting:
                    continue
                left, right = _split(tree, node, row, space, rules, depth)
                grown.setdefault(row["tree"], {}).update({left: row["c_all"] - row["c_right"], right: row["c_right"]})
            on_errors = None
        for cells in before:
            cells.unpersist()
        depth += 1
        at_limit = rules.max_depth is not None and depth >= rules.max_depth
        open_nodes = {} if at_limit else dict(sorted(grown.items()))
        twins = _twins(trees, open_nodes, local_rows, chosen)
    for cells in kept:
        cells.unpersist()
    for lot in lots([(t, node, n) for (t, node), (n, _) in sorted(small.items())]):
        _finish(source, space, rule, rules, trees, lot, {pair: level for pair, (_, level) in small.items()}, chosen, on_errors)
        on_errors = None
    return [trees[t] for t in tree_ids]


def _twins(
    trees: dict[int, Tree],
    open_nodes: dict[int, dict[int, float]],
    local_rows: int,
    chosen: Callable[[int, int], np.ndarray] | None,
) -> dict[tuple[int, int], tuple[int, int]]:
    """For each pair of large siblings that may split on the features of their parent: the smaller one to the other and the parent."""
    found = {}
    for t, nodes in open_nodes.items():
        tree = trees[t]
        for parent, (left, right) in enumerate(zip(tree.left, tree.right, strict=True)):
            if left not in nodes or right not in nodes or min(nodes[left], nodes[right]) <= local_rows or tree.feature[parent] < 0:
                continue
            if chosen is None or all(np.array_equal(chosen(t, parent), chosen(t, node)) for node in (left, right)):
                summed, other = (left, right) if nodes[left] <= nodes[right] else (right, left)
                found[t, summed] = other, parent
    return found


def _finish(
    source: DataFrame,
    space: FeatureSpace,
    rule: RowRule,
    rules: SplitRules,
    trees: dict[int, Tree],
    lot: dict[int, list[int]],
    depths: dict[tuple[int, int], int],
    chosen: Callable[[int, int], np.ndarray] | None,
    on_errors: Callable[[float, float], None] | None,
) -> None:
    """Hang the finished subtrees of a lot of nodes into their trees."""
    handed = {t: (trees[t].packed(), nodes) for t, nodes in lot.items()}
    pairs = [(t, node) for t, nodes in lot.items() for node in nodes]
    places = {(t, node): (trees[t].name[node], depths[t, node]) for t, node in pairs}
    masks = {pair: chosen(*pair) for pair in pairs} if chosen else None
    for found in finish_subtrees(source, space, rule, rules, handed, places, masks).collect():
        if found["tree"] == TOTALS:
            if on_errors is not None:
                on_errors(found["g"], found["h"])
            continue
        tree, node = trees[found["tree"]], found["node"]
        if node == 0:
            tree.value[0], tree.weight[0] = rules.leaf(found["g"], found["h"]), found["h"]
        nodes = [node]
        fields = ("feature", "bin", "gain", "g_all", "h_all", "g_right", "h_right")
        for i, (parent, level) in enumerate(zip(found["parent"], found["depth"], strict=True)):
            nodes += _split(tree, nodes[parent], {f: found[f][i] for f in fields}, space, rules, level)


def _split(tree: Tree, node: int, row, space: FeatureSpace, rules: SplitRules, depth: int) -> list[int]:
    feature = space.features[row["feature"]]
    tree.feature[node], tree.slot[node], tree.gain[node] = row["feature"], feature.slot, row["gain"]
    if feature.level is None:
        tree.bin[node], tree.cut[node] = row["bin"], space.cuts[feature.slot][row["bin"] - 1]
    else:
        tree.level[node] = feature.level
    sides = (
        (row["g_all"] - row["g_right"], row["h_all"] - row["h_right"]),
        (row["g_right"], row["h_right"]),
    )
    tree.left[node], tree.right[node] = (
        tree.add_leaf(rules.leaf(g, h), h, child_name(tree.name[node], side)) for side, (g, h) in enumerate(sides)
    )
    tree.depth = max(tree.depth, depth + 1)
    return [tree.left[node], tree.right[node]]


def split_gains(trees: Sequence[Tree]) -> list[tuple[int, float, float]]:
    """(feature, gain, node weight) of every split, for importances."""
    return [
        (f, gain, weight)
        for tree in trees
        for f, gain, weight in zip(tree.feature, tree.gain, tree.weight)
        if f >= 0
    ]


def prediction_column(columns: Sequence[str], predict: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A vectorized prediction over prepared columns."""
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(predict(np.column_stack([s.to_numpy() for s in series])))

    return run(*[F.col(c) for c in columns])
