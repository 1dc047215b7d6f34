"""Learned preprocessing: fitted on training rows, applied as column expressions.

Numeric columns are imputed, then winsorized, then scaled; the later statistics are those of
the already treated column. Categories are imputed, then rare levels are grouped, then coded.
The fitted object is a handful of scalars and level lists. ``apply`` adds one double column per
numeric feature and one code column per category; dummies are derived from the codes where a
model wants them, so no wide table is ever stored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from panelreg.operators.levels import OTHER_LEVEL, sort_levels, summarize_levels
from panelreg.operators.quantiles import filled_quantiles
from panelreg.sources.roles import FeatureColumns

UNKNOWN = -1
#: Numbers that a partition of a fit by Spark ML's trees holds, of about eight bytes with their share of objects.
TASK_NUMBERS = 10_000_000
#: What an object for a row takes beside its numbers.
ROW_OVERHEAD = 50


@dataclass(frozen=True)
class PrepSettings:
    winsor_lower: float = 0.0
    winsor_upper: float = 1.0
    scale_numeric: bool = False
    drop_first: bool = False
    rare_min_count: int = 0

    @property
    def winsorizes(self) -> bool:
        return self.winsor_lower > 0.0 or self.winsor_upper < 1.0


@dataclass(frozen=True)
class NumericStep:
    column: str
    median: float
    low: float | None = None
    high: float | None = None
    mean: float = 0.0
    deviation: float = 1.0

    def imputed(self) -> Column:
        return F.coalesce(F.col(self.column), F.lit(self.median))

    def clipped(self) -> Column:
        if self.low is None:
            return self.imputed()
        return F.least(F.greatest(self.imputed(), F.lit(self.low)), F.lit(self.high))

    def expression(self) -> Column:
        if self.mean == 0.0 and self.deviation == 1.0:
            return self.clipped()
        return (self.clipped() - F.lit(self.mean)) / F.lit(self.deviation)


@dataclass(frozen=True)
class CategoryStep:
    column: str
    mode: str
    levels: tuple[str, ...]
    drop_first: bool = False
    frequent: tuple[str, ...] | None = None

    @property
    def first(self) -> int:
        """Code of the first level that has a dummy."""
        return 1 if self.drop_first else 0

    @property
    def dummies(self) -> tuple[str, ...]:
        return tuple(f"{self.column}_{level}" for level in self.levels[self.first :])

    def imputed(self) -> Column:
        return F.coalesce(F.col(self.column), F.lit(self.mode))

    def code(self) -> Column:
        """The place of the row's level: one look-up in a constant hash table, whatever its size.

        No row is moved, so a level that holds a third of them is like any other.
        """
        size = 1 << len(self.levels).bit_length()
        table: list[dict[str, int]] = [{} for _ in range(size)]
        for code, level in enumerate(self.levels):
            table[zlib.crc32(level.encode()) % size][level] = code
        constant = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")
        level = self.imputed()
        slot = F.crc32(level.cast("binary")).bitwiseAND(F.lit(size - 1)).cast("int")
        unseen = UNKNOWN
        if self.frequent is not None and OTHER_LEVEL in self.levels:
            unseen = self.levels.index(OTHER_LEVEL)
        return F.coalesce(F.try_element_at(F.get(constant, slot), level), F.lit(unseen))


@dataclass(frozen=True)
class Preparation:
    numeric: tuple[NumericStep, ...]
    categories: tuple[CategoryStep, ...]
    dropped: tuple[str, ...] = ()

    @property
    def numeric_columns(self) -> list[str]:
        return [f"num_{i}" for i in range(len(self.numeric))]

    @property
    def code_columns(self) -> list[str]:
        return [f"code_{i}" for i in range(len(self.categories))]

    @property
    def prepared_columns(self) -> list[str]:
        return self.numeric_columns + self.code_columns

    @property
    def source_columns(self) -> list[str]:
        return [step.column for step in (*self.numeric, *self.categories)]

    def feature_names(self) -> list[str]:
        return [s.column for s in self.numeric] + [name for s in self.categories for name in s.dummies]

    def apply(self, df: DataFrame) -> DataFrame:
        """Add the prepared columns; nothing here aggregates, so it works on streams as well."""
        lost = [c for c in self.source_columns if c not in df.columns]
        if lost:
            raise ValueError(f"column(s) used in training are absent here: {', '.join(lost)}")
        added = dict(zip(self.numeric_columns, (s.expression() for s in self.numeric)))
        added |= dict(zip(self.code_columns, (s.code() for s in self.categories)))
        return df.withColumns(added) if added else df

    def design_columns(self) -> list[Column]:
        """The design matrix over prepared columns, one aliased double column per feature."""
        columns = [F.col(p).alias(s.column) for p, s in zip(self.numeric_columns, self.numeric)]
        for name, step in zip(self.code_columns, self.categories):
            for code, dummy in enumerate(step.dummies, start=step.first):
                columns.append(F.when(F.col(name) == code, 1.0).otherwise(0.0).alias(dummy))
        return columns

    def linear_score(self, intercept: float, coefficients: Sequence[float]) -> Column:
        """Linear prediction over prepared columns: a dummy block is one lookup by code."""
        score = F.lit(float(intercept))
        weights = list(map(float, coefficients))
        for name in self.numeric_columns:
            score = score + F.col(name) * weights.pop(0)
        for name, step in zip(self.code_columns, self.categories):
            block = [0.0] * step.first + [weights.pop(0) for _ in step.dummies]
            table = F.array(*[F.lit(w) for w in block])
            score = score + F.coalesce(F.when(F.col(name) >= 0, F.get(table, F.col(name))), F.lit(0.0))
        return score

    def design_array(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """The same design matrix for one batch of prepared columns inside a task."""
        blocks = [np.asarray(c, dtype=float)[:, None] for c in columns[: len(self.numeric)]]
        for codes, step in zip(columns[len(self.numeric) :], self.categories):
            wanted = np.arange(step.first, len(step.levels))
            blocks.append((np.asarray(codes)[:, None] == wanted).astype(float))
        return np.hstack(blocks) if blocks else np.empty((0, 0))

    @property
    def width(self) -> int:
        """Entries of a feature vector."""
        return len(self.numeric) + sum(len(step.dummies) for step in self.categories)

    @contextmanager
    def spread_vectors(self, prepared: DataFrame, label: str, numbers: int) -> Iterator[DataFrame]:
        """``features`` and the label for ML's tree fits, which keep their rows in the partitions they come in.

        ``numbers`` is how many the fit keeps of a row beside its features: a partition gets rows for TASK_NUMBERS.
        The narrow prepared columns are kept meanwhile, and dealt before they become vectors."""
        rows = prepared.select(*self.prepared_columns, label).persist()
        try:
            tasks = -(-rows.count() * (self.width + ROW_OVERHEAD + numbers) // TASK_NUMBERS)
            dealt = rows.repartition(tasks) if tasks > 1 else rows
            yield self.with_vector(dealt).select("features", label)
        finally:
            rows.unpersist()

    def with_vector(self, prepared: DataFrame, output: str = "features") -> DataFrame:
        """Add the (sparse) feature vector ML estimators take; attribute names travel along."""
        inputs, encoded = list(self.numeric_columns), []
        for name, step in zip(self.code_columns, self.categories):
            if not step.dummies:
                continue
            size = len(step.dummies)
            slot = F.col(name) - step.first
            # levels without a dummy and unknown ones get the index past the end, which encodes as zeros
            index = F.when(slot >= 0, slot).otherwise(size).cast("double")
            attributes = {"ml_attr": {"type": "nominal", "name": step.column, "vals": list(step.levels[step.first :])}}
            prepared = prepared.withColumn(f"{name}_index", index.alias(f"{name}_index", metadata=attributes))
            encoded.append(name)
        if encoded:
            encoder = OneHotEncoder(
                inputCols=[f"{n}_index" for n in encoded],
                outputCols=[f"{n}_dummies" for n in encoded],
                dropLast=True,
                handleInvalid="keep",
            )
            prepared = encoder.fit(prepared).transform(prepared).drop(*[f"{n}_index" for n in encoded])
            inputs += [f"{n}_dummies" for n in encoded]
        assembled = VectorAssembler(inputCols=inputs, outputCol=output).transform(prepared)
        return assembled.drop(*[f"{n}_dummies" for n in encoded])


def fit_preparation(
    train: DataFrame, features: FeatureColumns, settings: PrepSettings = PrepSettings(), *, persist: bool = True
) -> Preparation:
    """Learn all parameters from the typed training rows.

    The passes are few but each scans the rows, so the feature columns are kept meanwhile;
    ``persist=False`` is for rows that already come from a kept table.
    """
    rows = train.select(*features.all) if features.all else train
    if persist:
        rows.persist()
    try:
        numeric, empty_numeric = _fit_numeric(rows, features.numeric, settings)
        categories, empty_categories = _fit_categories(rows, features.categorical, settings)
    finally:
        if persist:
            rows.unpersist()
    return Preparation(tuple(numeric), tuple(categories), (*empty_numeric, *empty_categories))


def _fit_numeric(
    train: DataFrame, columns: Sequence[str], settings: PrepSettings
) -> tuple[list[NumericStep], list[str]]:
    if not columns:
        return [], []
    shape = train.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    counts = {c: shape[f"c{i}"] for i, c in enumerate(columns)}
    used = {c: counts[c] for c in columns if counts[c]}
    bounds = [max(settings.winsor_lower, 0.0), min(settings.winsor_upper, 1.0)] if settings.winsorizes else []
    found = filled_quantiles(train, used, shape["n"], bounds)
    steps = [NumericStep(c, median, *((low_high[0], max(low_high[1], low_high[0] + 1e-12)) if low_high else ())) for c, (median, low_high) in found.items()]
    if settings.scale_numeric and steps:
        moments = train.agg(
            *[F.avg(s.clipped()).alias(f"m{i}") for i, s in enumerate(steps)],
            *[F.stddev_pop(s.clipped()).alias(f"d{i}") for i, s in enumerate(steps)],
        ).first()
        steps = [
            NumericStep(s.column, s.median, s.low, s.high, moments[f"m{i}"], _nonzero(moments[f"d{i}"], moments[f"m{i}"]))
            for i, s in enumerate(steps)
        ]
    return steps, [c for c in columns if not counts[c]]


def _nonzero(deviation: float, mean: float) -> float:
    """A constant column divides by one; rounding noise of its sum does not count as spread."""
    return deviation if deviation > 1e-14 * max(abs(mean), 1.0) else 1.0


def _fit_categories(
    train: DataFrame, columns: Sequence[str], settings: PrepSettings
) -> tuple[list[CategoryStep], list[str]]:
    found = summarize_levels(train, columns, settings.rare_min_count)
    steps = []
    for column in [c for c in columns if c in found]:
        summary = found[column]
        frequent = None
        levels = list(summary.counts)
        if settings.rare_min_count > 0:
            frequent = tuple(sorted(levels))
            levels = list(dict.fromkeys([*frequent, *([OTHER_LEVEL] if summary.rare else [])]))
        steps.append(
            CategoryStep(
                column, summary.mode, tuple(sort_levels(levels, as_text=frequent is not None)), settings.drop_first, frequent
            )
        )
    return steps, [c for c in columns if c not in found]
