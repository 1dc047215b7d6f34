"""Linear models: least squares by a tall-skinny QR decomposition, and Huber regression.

Cross products square the condition number of a design, so that nearly collinear columns lose all digits
of their coefficients. Here every task reduces its rows to the triangular factor of [1, features, label],
factors are stacked and reduced again in a tree, and the last one, which has the singular values of the
design, is solved. A factor has as many cells as the cross products, whatever the number of rows. Designs with
more columns than that allows, as categories with thousands of levels make them, are solved by conjugate
gradients over rows of codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from panelreg.operators.preprocess import Preparation
from panelreg.session import StoredTable

# Partial sums are added up in so many parts first, then the parts.
SUM_PARTS = 64
# Features whose square a task can hold.
DENSE_FEATURES = 1_000
# Cells of the dense block that a task reduces at once.
DENSE_CELLS = 2_000_000
# Singular values below this share of the largest, for each of them, are rounding.
RANK_TOLERANCE = 1e-14


@dataclass(frozen=True)
class LinearFit:
    name: str
    preparation: Preparation
    intercept: float
    coefficients: tuple[float, ...]
    scale: float | None = None

    def score(self) -> Column:
        return self.preparation.linear_score(self.intercept, self.coefficients)

    def rows(self) -> list[tuple[str, float]]:
        """(feature, coefficient), the intercept first."""
        return [("intercept", self.intercept), *zip(self.preparation.feature_names(), self.coefficients)]


def cross_products(prepared: DataFrame, preparation: Preparation, label: str = "label") -> DataFrame:
    """(i, j, value) with i <= j: sums of products over [1, features..., label].

    Each task reduces its rows to one small matrix; only those cells are shuffled, and added up
    in two steps, so that no task reads more than the square root of all tasks' cells.
    """
    inputs = prepared.select(*preparation.prepared_columns, F.col(label).cast("double"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            *columns, y = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            design = preparation.design_array(columns) if columns else np.empty((len(y), 0))
            block = np.column_stack([np.ones(len(y)), design, y])
            product = block.T @ block
            total = product if total is None else total + product
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = inputs.mapInArrow(partial, "i long, j long, v double")
    share = (F.spark_partition_id() % SUM_PARTS).alias("part")
    parts = cells.groupBy("i", "j", share).agg(F.sum("v").alias("v"))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("value"))


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of the blocks below each other, always square."""
    stacked = np.vstack(blocks)
    size = stacked.shape[1]
    if len(stacked) < size:
        stacked = np.vstack([stacked, np.zeros((size - len(stacked), size))])
    return np.linalg.qr(stacked, mode="r")


def triangular_factor(prepared: DataFrame, preparation: Preparation, label: str = "label") -> np.ndarray | None:
    """The triangular factor of [1, features, label] over all rows; None for no rows."""
    inputs = prepared.select(*preparation.prepared_columns, F.col(label).cast("double"))
    size = len(preparation.feature_names()) + 2

    def reduced(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = None
        for block in blocks:
            held = triangle([block] if held is None else [held, block])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["factor"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                # few rows at a time: the block is dense
                step = max(size, DENSE_CELLS // size)
                for piece in (batch.slice(at, step) for at in range(0, len(batch), step)):
                    *columns, y = [c.to_numpy(zero_copy_only=False) for c in piece.columns]
                    design = preparation.design_array(columns) if columns else np.empty((len(y), 0))
                    yield np.column_stack([np.ones(len(y)), design, y])

        yield from reduced(blocks())

    def of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(np.frombuffer(f, float).reshape(size, size) for batch in batches for f in batch["factor"].to_pylist())

    factors = inputs.mapInArrow(of_rows, "factor binary")
    for parts in (SUM_PARTS, SUM_PARTS // 8):
        factors = factors.repartition(parts).mapInArrow(of_factors, "factor binary")
    last = factors.coalesce(1).mapInArrow(of_factors, "factor binary").collect()
    return np.frombuffer(last[0]["factor"], float).reshape(size, size) if last else None


def solve_triangular(factor: np.ndarray) -> np.ndarray:
    """Least-squares solution [intercept, coefficients...]; the shortest one if features are collinear."""
    design, moment = factor[:, :-1], factor[:, -1]
    unit = np.sqrt((design * design).sum(0))
    unit[unit == 0] = 1.0
    left, values, right = np.linalg.svd(design / unit, full_matrices=False)
    solid = values > values.max(initial=0.0) * len(values) * RANK_TOLERANCE
    beta = right[solid].T @ ((left[:, solid].T @ moment) / values[solid]) / unit
    if not solid.all():
        null = right[~solid].T / unit[:, None]
        beta = beta - null @ np.linalg.lstsq(null, beta, rcond=None)[0]
    return beta


class CodedDesign:
    """The design [1, features] of batches of prepared columns, as products with vectors: a category stays a code."""

    def __init__(self, preparation: Preparation, means: np.ndarray | None = None):
        self.numeric = len(preparation.numeric)
        self.means = np.zeros(self.numeric) if means is None else means
        self.firsts = [step.first for step in preparation.categories]
        sizes = [len(step.dummies) for step in preparation.categories]
        self.begins = (1 + self.numeric + np.cumsum([0, *sizes])).tolist()
        self.size = int(self.begins[-1])

    def parts(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Centred numeric columns, and for each category the place of the row's dummy, ``size`` if it has none."""
        numbers = np.stack(columns[: self.numeric]) - self.means[:, None] if self.numeric else np.zeros((0, len(columns[0]) if columns else 0))
        places = []
        for codes, first, begin in zip(columns[self.numeric :], self.firsts, self.begins):
            places.append(np.where(codes >= first, codes - first + begin, self.size))
        return numbers, places

    def times(self, parts: tuple[np.ndarray, list[np.ndarray]], vector: np.ndarray, rows: int) -> np.ndarray:
        numbers, places = parts
        padded = np.append(vector, 0.0)
        total = np.full(rows, vector[0]) + vector[1 : 1 + self.numeric] @ numbers
        for place in places:
            total = total + padded[place]
        return total

    def transposed(self, parts: tuple[np.ndarray, list[np.ndarray]], weight: np.ndarray) -> np.ndarray:
        numbers, places = parts
        total = np.zeros(self.size + 1)
        total[0] = weight.sum()
        total[1 : 1 + self.numeric] = numbers @ weight
        for place in places:
            total += np.bincount(place, weight, self.size + 1)
        return total[:-1]


def summed(rows: DataFrame, work: Callable[[list[np.ndarray], np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a vector made of the prepared columns and the label, which comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            *columns, y = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            total += work(columns, y)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["i", "v"])

    found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    made = np.zeros(size)
    made[found["i"].to_numpy()] = found["v"].to_numpy()
    return made


def fit_by_gradients(rows: DataFrame, preparation: Preparation, tolerance: float, rounds: int) -> np.ndarray:
    """[intercept, coefficients...] by conjugate gradients on the normal equations, one pass over the rows a round.

    Memory of a task and of the driver grows with the number of features, not with its square. Numeric columns
    are centred and all columns scaled to length one; of several solutions it is the shortest one in that scale.
    """
    plain = CodedDesign(preparation)
    first = summed(rows, lambda columns, y: plain.transposed(plain.parts(columns), np.ones(len(y))), plain.size)
    if not first[0]:
        return np.zeros(plain.size)
    means = first[1 : 1 + plain.numeric] / first[0]
    design = CodedDesign(preparation, means)

    def moments(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        numbers, places = parts = design.parts(columns)
        squares = design.transposed((numbers * numbers, places), np.ones(len(y)))
        return np.concatenate([squares, design.transposed(parts, y)])

    both = summed(rows, moments, 2 * design.size)
    unit = np.sqrt(both[: design.size])
    unit[unit == 0] = 1.0
    gradient = both[design.size :] / unit
    beta, step = np.zeros(design.size), gradient.copy()
    start = size = float(gradient @ gradient)
    for _ in range(rounds):
        if size <= start * tolerance**2:
            break
        sent = step / unit

        def product(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
            parts = design.parts(columns)
            return design.transposed(parts, design.times(parts, sent, len(y)))

        moved = summed(rows, product, design.size) / unit
        length = size / float(step @ moved)
        beta += length * step
        gradient -= length * moved
        before, size = size, float(gradient @ gradient)
        step = gradient + size / before * step
    beta /= unit
    beta[0] -= means @ beta[1 : 1 + design.numeric]
    return beta


def fit_ols(
    prepared: DataFrame,
    preparation: Preparation,
    label: str = "label",
    *,
    dense_features: int = DENSE_FEATURES,
    tolerance: float = 1e-12,
    rounds: int = 500,
) -> LinearFit:
    """Least squares: by a triangular factor up to ``dense_features``, whose square a task holds, by gradients above."""
    size = len(preparation.feature_names()) + 1
    if size > dense_features:
        stored = StoredTable(prepared.select(*preparation.prepared_columns, F.col(label).cast("double").alias("label")), "linear")
        beta = fit_by_gradients(stored.frame, preparation, tolerance, rounds)
        stored.drop()
    else:
        factor = triangular_factor(prepared, preparation, label)
        beta = np.zeros(size) if factor is None else solve_triangular(factor)
    return LinearFit("OLS", preparation, float(beta[0]), tuple(map(float, beta[1:])))


def fit_huber(
    prepared: DataFrame,
    preparation: Preparation,
    label: str = "label",
    *,
    epsilon: float = 1.35,
    alpha: float = 1e-4,
    max_iter: int = 1000,
    tolerance: float = 1e-6,
) -> LinearFit:
    """Huber loss with jointly estimated scale. Spark averages the loss, hence alpha / n."""
    rows = prepared.count()
    estimator = LinearRegression(
        labelCol=label,
        loss="huber",
        epsilon=epsilon,
        regParam=alpha / rows,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
        aggregationDepth=2,
    )
    model = estimator.fit(preparation.with_vector(prepared).select("features", label))
    return LinearFit("Huber", preparation, model.intercept, tuple(map(float, model.coefficients.toArray())), model.scale)


def huber_objective(residual: Column, scale: Column, epsilon: float) -> Column:
    """One row's share of the Huber objective: sigma + H(residual / sigma) * sigma."""
    z = F.abs(residual / scale)
    return scale + F.when(z < epsilon, z * z).otherwise(2 * epsilon * z - epsilon * epsilon) * scale


def huber_gradient(prepared: DataFrame, fit: LinearFit, epsilon: float, alpha: float, label: str = "label") -> DataFrame:
    """(feature, gradient): derivative of the summed objective at the fit, one aggregate pass."""
    z = (fit.score() - F.col(label)) / F.lit(fit.scale)
    slope = F.when(F.abs(z) < epsilon, 2 * z).otherwise(2 * epsilon * F.signum(z))
    share = F.when(F.abs(z) < epsilon, 1 - z * z).otherwise(F.lit(1 - epsilon * epsilon))
    design = [F.lit(1.0), *fit.preparation.design_columns()]
    penalty = [0.0, *(2 * alpha * w for w in fit.coefficients)]
    names = ["intercept", *fit.preparation.feature_names(), "scale"]
    sums = [F.sum(slope * x) + p for x, p in zip(design, penalty)] + [F.sum(share)]
    wide = prepared.agg(F.array(*[F.struct(F.lit(n).alias("feature"), s.alias("gradient")) for n, s in zip(names, sums)]).alias("g"))
    return wide.select(F.inline("g"))
