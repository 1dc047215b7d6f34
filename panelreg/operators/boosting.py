"""Second-order gradient boosting on histograms, with early stopping and gain importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from panelreg.functions.hashing import stream_word, uniform_array
from panelreg.operators.preprocess import Preparation
from panelreg.operators.subtrees import LOCAL_ROWS
from panelreg.operators.trees import (
    MAX_BINS, FeatureSpace, PackedTree, RowRule, SplitRules, Tree,
    bin_columns, feature_space, grow_trees, prediction_column, split_gains,
)
from panelreg.session import StoredTable

ROWS, COLUMNS = 3, 4


@dataclass(frozen=True)
class BoostSettings:
    n_rounds: int = 1500
    learning_rate: float = 0.03
    max_depth: int = 6
    subsample: float = 0.9
    column_share: float = 0.9
    lambda_: float = 2.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    seed: int = 42
    patience: int = 0
    max_bins: int = MAX_BINS
    #: Nodes of so many rows are finished in one task.
    local_rows: int = LOCAL_ROWS
    refresh_rounds: int = 5

    @property
    def rules(self) -> SplitRules:
        return SplitRules(self.lambda_, self.alpha, self.gamma, self.min_child_weight, 1, self.max_depth)


@dataclass(frozen=True)
class Boosted:
    preparation: Preparation
    space: FeatureSpace
    base: float
    learning_rate: float
    trees: tuple[Tree, ...]
    curve: tuple[float, ...] = ()

    def score(self) -> Column:
        trees, base, rate = [t.packed() for t in self.trees], self.base, self.learning_rate
        return prediction_column(
            self.preparation.prepared_columns,
            lambda table: base + rate * sum((t.predict(table, binned=False) for t in trees), np.zeros(len(table))),
        )

    def prefix(self, rounds: int) -> "Boosted":
        return replace(self, trees=self.trees[:rounds])

    def importances(self) -> list[tuple[str, float]]:
        """Average gain of a feature's splits, normalized over features."""
        gains = np.zeros(len(self.space.features))
        uses = np.zeros(len(gains))
        for f, gain, _ in split_gains(self.trees):
            gains[f] += gain
            uses[f] += 1
        mean = np.divide(gains, uses, out=np.zeros_like(gains), where=uses > 0)
        share = mean / mean.sum() if mean.sum() > 0 else mean
        named = [(f.name, float(v)) for f, v in zip(self.space.features, share)]
        return sorted(named, key=lambda item: -item[1])


def stop_round(curve: Sequence[float], patience: int) -> int | None:
    """How many trees to keep once ``patience`` rounds brought no improvement; None to go on."""
    best = int(np.argmin(curve))
    return best + 1 if patience > 0 and len(curve) - 1 - best >= patience else None


def fit_boosting(
    prepared: DataFrame,
    preparation: Preparation,
    settings: BoostSettings,
    label: str = "label",
    key: str = "key",
    fold: str | None = None,
) -> Boosted:
    """Boost on the prepared rows; rows with ``fold`` 1 only measure the validation error.

    The growing prediction is written back to a table in the shared folder every few rounds, so
    a lost executor costs one scan of that table and not the history of all rounds.
    """
    rows = prepared.select(
        F.col(key).alias("key"),
        F.col(label).cast("double").alias("y"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
        *preparation.prepared_columns,
    ).persist()
    training = rows.filter("fold = 0")
    space = feature_space(training, preparation, settings.max_bins)
    base, count = training.agg(F.avg("y"), F.count(F.lit(1))).first()
    base = float(base)
    table = StoredTable(bin_columns(rows, space, ["key", "y", "fold", F.lit(base).alias("pred")]), "boost")
    rows.unpersist()
    trees: list[Tree] = []
    pending: list[PackedTree] = []
    curve: list[float] = []
    try:
        for number in range(settings.n_rounds):
            mask = column_mask(settings, number, len(space.features))
            (tree,) = grow_trees(
                table.frame,
                space,
                _row_rule(settings, tuple(pending), bool(fold)),
                settings.rules,
                [number],
                chosen=None if mask is None else lambda _tree, _node, mask=mask: mask,
                on_errors=lambda total, held: curve.append((total / held) ** 0.5) if held else None,
                rows=count,
                local_rows=settings.local_rows,
            )
            # the error that comes back with a round is that of the trees before it
            kept = stop_round(curve[1:], settings.patience) if fold and len(curve) > 1 else None
            if kept is not None:
                return Boosted(preparation, space, base, settings.learning_rate, tuple(trees[:kept]), tuple(curve[1:]))
            trees.append(tree)
            pending.append(tree.packed())
            if len(pending) >= settings.refresh_rounds and number + 1 < settings.n_rounds:
                fresh = StoredTable(_advance(table.frame, space, settings.learning_rate, tuple(pending)), "boost")
                table.drop()
                table, pending = fresh, []
        if fold:
            curve.append(_validation_error(table.frame, space, settings.learning_rate, tuple(pending)))
            if settings.patience > 0:
                trees = trees[: int(np.argmin(curve[1:])) + 1]
        return Boosted(preparation, space, base, settings.learning_rate, tuple(trees), tuple(curve[1:]))
    finally:
        table.drop()


def column_mask(settings: BoostSettings, number: int, count: int) -> np.ndarray | None:
    if settings.column_share >= 1.0 or count == 0:
        return None
    stream = stream_word(settings.seed, COLUMNS, number)
    drawn = np.argsort(uniform_array(np.arange(count), stream), kind="stable")
    mask = np.zeros(count, dtype=bool)
    mask[drawn[: max(1, int(settings.column_share * count))]] = True
    return mask


def _row_rule(settings: BoostSettings, pending: tuple[PackedTree, ...], has_fold: bool) -> RowRule:
    rate, seed, subsample = settings.learning_rate, settings.seed, settings.subsample

    def weights(tree: int, keys: np.ndarray) -> np.ndarray | None:
        if subsample >= 1.0:
            return None
        return (uniform_array(keys, stream_word(seed, ROWS, tree)) < subsample).astype(float)

    def gradient(columns: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
        return columns["pred"] + rate * _sum_trees(pending, bins) - columns["y"]

    def errors(columns: dict[str, np.ndarray], gradient: np.ndarray) -> tuple[float, float]:
        held = gradient[columns["fold"] == 1]
        return float(held @ held), float(len(held))

    return RowRule(("key", "y", "fold", "pred"), weights, gradient, errors if has_fold else None)


def _sum_trees(trees: Sequence[PackedTree], bins: np.ndarray) -> np.ndarray:
    return sum((t.predict(bins, binned=True) for t in trees), np.zeros(len(bins)))


def _step_column(space: FeatureSpace, rate: float, trees: tuple[PackedTree, ...]) -> Column:
    if not trees or not space.columns:
        return F.lit(0.0)
    return prediction_column(space.columns, lambda bins: rate * _sum_trees(trees, bins))


def _advance(frame: DataFrame, space: FeatureSpace, rate: float, trees: tuple[PackedTree, ...]) -> DataFrame:
    return frame.withColumn("pred", F.col("pred") + _step_column(space, rate, trees))


def _validation_error(frame: DataFrame, space: FeatureSpace, rate: float, trees: tuple[PackedTree, ...]) -> float:
    held = _advance(frame.filter("fold = 1"), space, rate, trees)
    return held.agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("y"), 2)))).first()[0]


def fit_ml_boosting(
    prepared: DataFrame, preparation: Preparation, settings: BoostSettings, label: str = "label"
) -> GBTRegressionModel:
    """Spark ML's boosting on the feature vector: a quick path without L1/L2 or gain threshold."""
    estimator = GBTRegressor(
        labelCol=label,
        maxIter=settings.n_rounds,
        stepSize=settings.learning_rate,
        maxDepth=settings.max_depth,
        subsamplingRate=settings.subsample,
        minInstancesPerNode=max(1, int(np.ceil(settings.min_child_weight))),
        maxBins=settings.max_bins,
        seed=settings.seed,
        cacheNodeIds=True,
    )
    # of each row the fit keeps a count, a node, a prediction and its error
    with preparation.spread_vectors(prepared, label, 4) as rows:
        return estimator.fit(rows)
