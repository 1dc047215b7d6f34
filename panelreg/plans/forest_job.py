"""Random forest job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from panelreg.operators.evaluate import r2
from panelreg.operators.forest import ForestSettings, fit_forest
from panelreg.operators.permutation import permutation_importance
from panelreg.operators.preprocess import fit_preparation
from panelreg.plans.common import ModelRun, RunSettings, as_table, fit_scored, prepare_split, store_training, write_report
from panelreg.session import StoredTable
from panelreg.sources.roles import RoleSchema


def run_forest(
    panel: DataFrame,
    roles: RoleSchema,
    settings: RunSettings,
    forest: ForestSettings = ForestSettings(),
    *,
    oob: bool = False,
    permutation: bool = False,
    repeats: int = 5,
) -> ModelRun:
    """Areas count as features down to the district unless the settings name a level."""
    if oob and not forest.bootstrap:
        raise ValueError("an out-of-bag score needs rows that a tree did not draw")
    settings = replace(settings, geography=settings.geography or "district")
    split = prepare_split(panel, roles, settings)
    stored, rows = store_training(split)
    try:
        preparation = fit_preparation(rows, split.features, settings.prep, persist=False)
        train = preparation.apply(rows).select("label", "key", *preparation.prepared_columns)
        model, binned = fit_forest(train, preparation, forest)
        extra = {}
        if oob:
            row = model.out_of_bag(binned).filter("oob IS NOT NULL").agg(r2(F.col("y"), F.col("oob"))).first()
            extra["R2_OOB"] = row[0]
        binned.unpersist()
        run = fit_scored("RF", split, preparation, train, model.score, importances=model.importances(), extra=extra)
    finally:
        stored.drop()
    if permutation:
        trees = model.packed()
        known = run.known.withColumn("key", F.xxhash64("key", F.monotonically_increasing_id()))
        stored = StoredTable(known.select("key", "label", *preparation.prepared_columns), "permuted")
        try:
            table = permutation_importance(
                stored.frame,
                preparation,
                lambda columns: sum(t.predict(as_table(columns), binned=False) for t in trees) / len(trees),
                repeats=repeats,
                seed=forest.seed,
            )
            # one row per column, from lines that are kept already
            run.permutation = table
        finally:
            stored.drop()
    return run


def write_forest(run: ModelRun, folder: str, fmt: str = "csv", save_predictions: bool = False, by_year: bool = False) -> None:
    with run.kept():
        run.write(folder, fmt, save_predictions, by_year)
        write_report(run.report(), folder, "RF", run.settings, fmt)
