"""What the three jobs share: settings, the typed split, scoring, evaluation and reports."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.functions.target import fit_smearing, invert, to_learning_scale, to_raw_prediction
from panelreg.operators.evaluate import group_mae_lines, metric_columns
from panelreg.operators.preprocess import Preparation, PrepSettings
from panelreg.session import StoredTable
from panelreg.sources.roles import (
    DEFAULT_TARGET, GROUP_COLUMNS, HOUSEHOLD_ID, YEAR_COLUMN, YEAR_FEATURE,
    FeatureColumns, RoleSchema, cast_roles, select_features,
)
from panelreg.sources.sinks import write_rows, write_small
from panelreg.sources.years import require_years, split_years


#: Columns that a job adds to the rows.
RESERVED = {"label", "key", "yhat", "y_true", "y_pred"}


@dataclass(frozen=True)
class RunSettings:
    train_years: tuple[int, ...]
    test_year: int
    target: str = DEFAULT_TARGET
    scale: str = "log1p"
    smearing: bool = False
    prep: PrepSettings = PrepSettings()
    exclude_related: bool = False
    geography: str | None = None
    year_feature: bool = False
    group_columns: tuple[str, ...] = GROUP_COLUMNS
    id_column: str = HOUSEHOLD_ID
    year_column: str = YEAR_COLUMN
    check_years: bool = True

    @property
    def transforms(self) -> bool:
        return self.scale != "none"

    @property
    def train_label(self) -> str:
        return ",".join(map(str, self.train_years))


@dataclass(frozen=True)
class SplitPanel:
    """Typed rows: training rows with a label, and all test rows (label NULL where unknown)."""

    settings: RunSettings
    features: FeatureColumns
    train: DataFrame
    test: DataFrame

    @property
    def known_test(self) -> DataFrame:
        return self.test.filter(F.col("label").isNotNull())


def type_rows(rows: DataFrame, roles: RoleSchema, settings: RunSettings, categorical: Sequence[str]) -> DataFrame:
    """Type the columns as the job does, areas and the year feature included; for batches and streams."""
    areas = [c for c in categorical if c not in roles.categorical and c != YEAR_FEATURE]
    typed = cast_roles(rows, roles, numbers=(settings.target,), levels=tuple(areas))
    if settings.year_feature:
        typed = typed.withColumn(YEAR_FEATURE, F.col(settings.year_column).cast("string"))
    return typed


def prepare_split(panel: DataFrame, roles: RoleSchema, settings: RunSettings) -> SplitPanel:
    """Type the panel, cut it by year and put the target on its learning scale.

    Lazy but for the check that every year has rows, which reads the year column.
    """
    if settings.check_years:
        require_years(panel, (*settings.train_years, settings.test_year), settings.year_column)
    if settings.target not in panel.columns:
        raise ValueError(f"target column {settings.target!r} is not in the table")
    features = select_features(
        panel.columns,
        roles,
        settings.target,
        exclude_related=settings.exclude_related,
        geography=settings.geography,
        year_feature=settings.year_feature,
    )
    if features.missing:
        warnings.warn(f"the table lacks column(s) of the schema: {', '.join(features.missing)}", stacklevel=2)
    if taken := sorted(RESERVED & set(panel.columns)):
        raise ValueError(f"column name(s) that results use: {', '.join(taken)}")
    typed = type_rows(panel, roles, settings, features.categorical)
    # a household answers in several years, so its row is named by both; without an id by its content
    named = [settings.id_column, settings.year_column] if settings.id_column in panel.columns else panel.columns
    label = to_learning_scale(F.col(settings.target), settings.scale)
    typed = typed.withColumns({"label": label, "key": F.xxhash64(*named)})
    train, test = split_years(typed, settings.train_years, settings.test_year, settings.year_column)
    kept = dict.fromkeys((*features.all, "label", "key"))
    return SplitPanel(settings, features, train.filter(F.col("label").isNotNull()).select(*kept), test)


def store_training(split: SplitPanel) -> tuple[StoredTable, DataFrame]:
    """The training rows as a written table, for fits that draw rows by key.

    The key is mixed with the row's place, so rows that share an id, or have none, differ; as it is
    written, it is the same in every scan.
    """
    salted = split.train.withColumn("key", F.xxhash64("key", F.monotonically_increasing_id()))
    stored = StoredTable(salted, "train")
    return stored, stored.frame


@dataclass
class ModelRun:
    """One fitted model and its result tables; the tables are lazy."""

    name: str
    settings: RunSettings
    preparation: Preparation
    score: Callable[[], Column]
    scored: DataFrame
    smearing: tuple[float, float] | None = None
    coefficients: Sequence[tuple[str, float]] = ()
    importances: Sequence[tuple[str, float]] = ()
    extra: dict[str, float] = field(default_factory=dict)
    permutation: DataFrame | None = None

    def score_rows(self, typed: DataFrame) -> DataFrame:
        """Add ``yhat`` and the raw ``y_pred`` to typed rows, batch or stream."""
        return score_rows(typed, self.preparation, self.score, self.settings.scale, self.smearing)

    @property
    def spark(self) -> SparkSession:
        return self.scored.sparkSession

    @property
    def known(self) -> DataFrame:
        return self.scored.filter(F.col("label").isNotNull())

    def report_columns(self, yhat: str = "yhat", y_pred: str = "y_pred") -> list[Column]:
        """Errors on the learning scale, the smearing factor, raw-scale errors, labels: aggregates and constants."""
        s = self.settings
        columns = metric_columns("label", yhat)
        if s.transforms:
            if self.smearing is not None:
                columns.append(F.lit(self.smearing[0]).alias("smearing"))
            columns += metric_columns("y_true", y_pred, "_raw")
        columns += [F.lit(value).alias(name) for name, value in self.extra.items()]
        labels = {
            "model": self.name, "run": "time", "train_years": s.train_label, "test_year": s.test_year, "target": s.target,
        }
        order = labels if self.name != "RF" else ("model", "run", "target", "train_years", "test_year")
        return columns + [F.lit(labels[name]).alias(name) for name in order]

    def report(self) -> DataFrame:
        """One row for the model."""
        return self.known.agg(*self.report_columns())

    def group_error_lines(self) -> DataFrame:
        """(grouping, level, MAE_group) on the raw scale of all group columns, from one pass over the scored rows;
        coded groups list levels that only unknown targets have."""
        coded = [step.column for step in self.preparation.categories]
        groups = [g for g in self.settings.group_columns if g in self.scored.columns]
        lines = group_mae_lines(self.scored, groups, "y_true", "y_pred")
        return lines.where(F.col("MAE_group").isNotNull() | F.col("grouping").isin(coded))

    def group_errors(self, lines: DataFrame | None = None) -> dict[str, DataFrame]:
        """The lines of each group column as a table of its own, by level."""
        lines = self.group_error_lines() if lines is None else lines
        kinds = dict(self.scored.dtypes)
        return {
            g: lines.where(F.col("grouping") == g).select(F.col("level").cast(kinds[g]).alias(g), "MAE_group").orderBy(g)
            for g in self.settings.group_columns
            if g in kinds
        }

    def predictions(self) -> DataFrame:
        """Test rows without the target, plus its true and predicted raw value."""
        target = self.settings.target
        helpers = {"label", "key", "yhat", "y_true", "y_pred", target, *self.preparation.prepared_columns}
        rest = [c for c in self.known.columns if c not in helpers]
        return self.known.select(
            *rest, F.col("y_true").alias(f"{target}_true"), F.col("y_pred").alias(f"{target}_pred")
        )

    def coefficient_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.coefficients), "feature string, coef double")

    def importance_table(self) -> DataFrame:
        table = self.spark.createDataFrame(list(self.importances), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")

    @contextmanager
    def kept(self) -> Iterator["ModelRun"]:
        """Score the test year once for all tables made inside the block."""
        self.scored.persist()
        try:
            yield self
        finally:
            self.scored.unpersist()

    def write(self, folder: str, fmt: str = "csv", save_predictions: bool = False, by_year: bool = False) -> None:
        """Write the model's tables; the combined metrics table is written by its job.

        ``by_year`` puts the predictions into one table for all test years, a partition each, and replaces its own."""
        run = f"time_{self.settings.train_label}_{self.settings.test_year}"
        if self.coefficients:
            write_small(self.coefficient_table(), f"{folder}/{self.name}_coeffs_{run}", fmt)
        if self.importances:
            write_small(self.importance_table(), f"{folder}/{self.name}_feature_importance_{run}", fmt)
        if self.permutation is not None:
            write_small(self.permutation, f"{folder}/{self.name}_perm_importance_{run}", fmt)
        lines = self.group_error_lines().persist()
        for group, table in self.group_errors(lines).items():
            write_small(table, f"{folder}/{self.name}_by_{group}_{run}", fmt)
        lines.unpersist()
        if save_predictions and by_year:
            place = f"{folder}/{self.name}_preds_time_{self.settings.train_label}"
            write_rows(self.predictions(), place, fmt, (self.settings.year_column,))
        elif save_predictions:
            write_rows(self.predictions(), f"{folder}/{self.name}_preds_{run}", fmt)


def score_rows(
    typed: DataFrame,
    preparation: Preparation,
    score: Callable[[], Column],
    scale: str,
    smearing: tuple[float, float] | None,
) -> DataFrame:
    scored = preparation.apply(typed).withColumn("yhat", score())
    raw = to_raw_prediction(F.col("yhat"), scale, smearing[0] if smearing else 1.0)
    return scored.withColumn("y_pred", raw)


def fit_scored(
    name: str,
    split: SplitPanel,
    preparation: Preparation,
    prepared_train: DataFrame,
    score: Callable[[], Column],
    **results,
) -> ModelRun:
    """Score the test year, with the smearing factor of the training rows if asked for."""
    settings = split.settings
    smearing = None
    if settings.scale == "log1p":
        smearing = (1.0, 1.0)
        if settings.smearing:
            smearing = fit_smearing(prepared_train.select("label", score().alias("yhat")), "label", "yhat")
    scored = score_rows(split.test, preparation, score, settings.scale, smearing)
    scored = scored.withColumn("y_true", invert(F.col("label"), settings.scale))
    return ModelRun(name, settings, preparation, score, scored, smearing, **results)


def write_report(report: DataFrame, folder: str, prefix: str, settings: RunSettings, fmt: str = "csv") -> None:
    years = f"{settings.train_label}_{settings.test_year}"
    write_small(report, f"{folder}/{prefix}_{settings.target}_time_{years}", fmt)


def as_table(columns: list[np.ndarray]) -> np.ndarray:
    return np.column_stack(columns)
