"""Linear baseline: OLS and Huber on one prepared training set."""

from __future__ import annotations

from contextlib import ExitStack
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelreg.functions.target import to_raw_prediction
from panelreg.operators.linear import fit_huber, fit_ols
from panelreg.operators.preprocess import fit_preparation
from panelreg.plans.common import ModelRun, RunSettings, fit_scored, prepare_split, write_report
from panelreg.sources.roles import RoleSchema

MODELS = {"ols": ("OLS",), "huber": ("Huber",), "both": ("OLS", "Huber")}


def run_linear(
    panel: DataFrame,
    roles: RoleSchema,
    settings: RunSettings,
    model: str = "both",
    *,
    huber_epsilon: float = 1.35,
    huber_alpha: float = 1e-4,
    huber_max_iter: int = 1000,
) -> list[ModelRun]:
    if model not in MODELS:
        raise ValueError(f"unknown linear model {model!r}, expected one of {', '.join(MODELS)}")
    split = prepare_split(panel, roles, settings)
    split.train.persist()
    try:
        preparation = fit_preparation(split.train, split.features, settings.prep, persist=False)
        train = preparation.apply(split.train).select("label", *preparation.prepared_columns)
        runs = []
        for name in MODELS[model]:
            if name == "OLS":
                fit = fit_ols(train, preparation)
            else:
                fit = fit_huber(
                    train, preparation, epsilon=huber_epsilon, alpha=huber_alpha, max_iter=huber_max_iter
                )
            runs.append(fit_scored(name, split, preparation, train, fit.score, coefficients=fit.rows()))
    finally:
        split.train.unpersist()
    return runs


def linear_report(runs: list[ModelRun]) -> DataFrame:
    """One row per model. One scan of the test year serves all models that share settings and preparation."""
    groups: dict[tuple, list[ModelRun]] = {}
    for run in runs:
        groups.setdefault((id(run.preparation), run.settings, tuple(run.extra)), []).append(run)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(_shared_report, groups.values()))


def _shared_report(runs: list[ModelRun]) -> DataFrame:
    frame, rows = runs[0].known, []
    for i, run in enumerate(runs):
        factor = run.smearing[0] if run.smearing else 1.0
        raw = to_raw_prediction(run.score(), run.settings.scale, factor)
        frame = frame.withColumns({f"yhat_{i}": run.score(), f"y_pred_{i}": raw})
        rows.append(F.struct(*run.report_columns(f"yhat_{i}", f"y_pred_{i}")))
    return frame.agg(F.array(*rows).alias("models")).select(F.inline("models"))


def write_linear(runs: list[ModelRun], folder: str, fmt: str = "csv", save_predictions: bool = False, by_year: bool = False) -> None:
    kind = "both" if len(runs) > 1 else runs[0].name.lower()
    with ExitStack() as stack:
        for run in runs:
            stack.enter_context(run.kept())
            run.write(folder, fmt, save_predictions, by_year)
        write_report(linear_report(runs), folder, f"BASELINE_{kind}", runs[0].settings, fmt)
