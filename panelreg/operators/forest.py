"""Random forest on bootstrap multiplicities, with out-of-bag scores and importances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from panelreg.functions.hashing import poisson_array, stream_word
from panelreg.operators.preprocess import Preparation
from panelreg.operators.subtrees import LOCAL_ROWS
from panelreg.operators.trees import (
    MAX_BINS, FeatureSpace, PackedTree, RowRule, SplitRules, Tree,
    bin_columns, feature_space, grow_trees, prediction_column, split_gains,
)

# Fixed value: the deepest tree Spark ML grows; it stands for "unlimited" there.
ML_MAX_DEPTH = 30
BAG = 1


@dataclass(frozen=True)
class ForestSettings:
    n_trees: int = 1000
    max_depth: int | None = None
    min_rows_leaf: int = 3
    max_features: str | int | float = "sqrt"
    seed: int = 42
    #: Rows are drawn with replacement for each tree; without, trees differ by their tried features alone.
    bootstrap: bool = True
    max_bins: int = MAX_BINS
    #: Nodes of so many rows are finished in one task.
    local_rows: int = LOCAL_ROWS

    @property
    def depth_limit(self) -> int | None:
        return self.max_depth if self.max_depth and self.max_depth > 0 else None


def feature_share(max_features: str | int | float, count: int) -> int:
    """How many features a node may try: sqrt, log2, a share in (0, 1], or a number."""
    if isinstance(max_features, str):
        if max_features in ("sqrt", "log2"):
            return max(1, int(np.sqrt(count) if max_features == "sqrt" else np.log2(count)))
        max_features = float(max_features) if "." in max_features else int(max_features)
    if isinstance(max_features, float):
        if not 0.0 < max_features <= 1.0:
            raise ValueError("a share of features must lie in (0, 1]")
        return max(1, int(max_features * count))
    return min(max(1, max_features), count)


def bag_stream(seed: int, tree: int) -> int:
    return stream_word(seed, BAG, tree)


@dataclass(frozen=True)
class Forest:
    preparation: Preparation
    space: FeatureSpace
    trees: tuple[Tree, ...]
    seed: int

    def packed(self) -> list[PackedTree]:
        return [t.packed() for t in self.trees]

    def score(self) -> Column:
        trees = self.packed()
        return prediction_column(
            self.preparation.prepared_columns,
            lambda table: sum(t.predict(table, binned=False) for t in trees) / len(trees),
        )

    def importances(self) -> list[tuple[str, float]]:
        """Impurity importance: each tree's gains per feature are normalized, then averaged."""
        total = np.zeros(len(self.space.features))
        for tree in self.trees:
            gains = np.zeros(len(total))
            for f, gain, _ in split_gains([tree]):
                gains[f] += gain
            if gains.sum() > 0:
                total += gains / gains.sum()
        if total.sum() > 0:
            total /= total.sum()
        named = [(f.name, float(v)) for f, v in zip(self.space.features, total)]
        return sorted(named, key=lambda item: -item[1])

    def out_of_bag(self, binned: DataFrame, output: str = "oob") -> DataFrame:
        """Add the mean prediction of the trees that did not draw the row; NULL if all drew it."""
        trees, seed = self.packed(), self.seed

        @F.pandas_udf("double")
        def run(key: pd.Series, *bins: pd.Series) -> pd.Series:
            keys = key.to_numpy()
            table = np.column_stack([b.to_numpy() for b in bins]) if bins else np.zeros((len(keys), 1))
            total, count = np.zeros(len(keys)), np.zeros(len(keys))
            for number, tree in enumerate(trees):
                out = poisson_array(keys, bag_stream(seed, number)) == 0
                total[out] += tree.predict(table[out], binned=True)
                count[out] += 1
            with np.errstate(invalid="ignore"):
                return pd.Series(total / count).where(pd.Series(count > 0))

        return binned.withColumn(output, run("key", *self.space.columns))


def fit_forest(
    prepared: DataFrame, preparation: Preparation, settings: ForestSettings, label: str = "label", key: str = "key"
) -> tuple[Forest, DataFrame]:
    """(forest, binned training table). ``key`` is a bigint that identifies a row across scans."""
    rows = prepared.select(
        F.col(key).alias("key"), F.col(label).cast("double").alias("y"), *preparation.prepared_columns
    ).persist()
    space = feature_space(rows, preparation, settings.max_bins)
    binned = bin_columns(rows, space, ["key", "y"]).persist()
    seed = settings.seed
    share = feature_share(settings.max_features, max(len(space.features), 1))

    def bag(tree: int, keys: np.ndarray) -> np.ndarray | None:
        return poisson_array(keys, bag_stream(seed, tree)) if settings.bootstrap else None

    rule = RowRule(("key", "y"), bag, lambda columns, table: -columns["y"])
    rules = SplitRules(min_rows=settings.min_rows_leaf, max_depth=settings.depth_limit, gamma=1e-12, tried=share, seed=seed)
    trees = grow_trees(binned, space, rule, rules, range(settings.n_trees), rows=binned.count(), local_rows=settings.local_rows)
    rows.unpersist()
    return Forest(preparation, space, tuple(trees), seed), binned


def fit_ml_forest(
    prepared: DataFrame, preparation: Preparation, settings: ForestSettings, label: str = "label"
) -> RandomForestRegressionModel:
    """Spark ML's forest on the feature vector: the quick path where no out-of-bag score is wanted."""
    strategy = settings.max_features
    if not isinstance(strategy, str):
        strategy = str(strategy)
    estimator = RandomForestRegressor(
        labelCol=label,
        numTrees=settings.n_trees,
        maxDepth=settings.depth_limit or ML_MAX_DEPTH,
        minInstancesPerNode=settings.min_rows_leaf,
        featureSubsetStrategy=strategy,
        seed=settings.seed,
        maxBins=settings.max_bins,
        cacheNodeIds=True,
    )
    # of each row and tree the fit keeps a count and a node
    with preparation.spread_vectors(prepared, label, 2 * settings.n_trees) as rows:
        return estimator.fit(rows)
