"""Boosting job, with early stopping on held-out training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelreg.operators.boosting import BoostSettings, fit_boosting
from panelreg.operators.preprocess import fit_preparation
from panelreg.operators.validation import split_by_share, split_exact
from panelreg.plans.common import ModelRun, RunSettings, fit_scored, prepare_split, store_training, write_report
from panelreg.sources.roles import RoleSchema


def run_boosting(
    panel: DataFrame,
    roles: RoleSchema,
    settings: RunSettings,
    boosting: BoostSettings = BoostSettings(),
    *,
    val_size: float = 0.0,
    exact_split: bool = True,
) -> ModelRun:
    """With ``patience`` set, preprocessing and trees see only the rows not held out."""
    stopping = boosting.patience > 0
    if stopping and not 0.0 < val_size < 0.5:
        raise ValueError("early stopping needs a validation share between 0 and 0.5")
    split = prepare_split(panel, roles, settings)
    stored, rows = store_training(split)
    try:
        if stopping:
            divide = split_exact if exact_split else split_by_share
            rows = divide(rows, "key", val_size, boosting.seed)
        fitted_rows = rows.filter(F.col("fold") == 0) if stopping else rows
        preparation = fit_preparation(fitted_rows, split.features, settings.prep, persist=False)
        kept = ["label", "key", *preparation.prepared_columns, *(["fold"] if stopping else [])]
        train = preparation.apply(rows).select(*kept)
        model = fit_boosting(train, preparation, boosting, fold="fold" if stopping else None)
        run = fit_scored("XGB", split, preparation, train, model.score, importances=model.importances())
    finally:
        stored.drop()
    return run


def write_boosting(run: ModelRun, folder: str, fmt: str = "csv", save_predictions: bool = False, by_year: bool = False) -> None:
    with run.kept():
        run.write(folder, fmt, save_predictions, by_year)
        write_report(run.report(), folder, "XGB", run.settings, fmt)
