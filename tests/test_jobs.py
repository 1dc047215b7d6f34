from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelreg.operators.boosting import BoostSettings
from panelreg.operators.forest import ForestSettings
from panelreg.operators.preprocess import PrepSettings
from panelreg.plans.boosting_job import run_boosting, write_boosting
from panelreg.plans.common import RunSettings, prepare_split, store_training
from panelreg.plans.forest_job import run_forest, write_forest
from panelreg.plans.linear_job import linear_report, run_linear, write_linear
from panelreg.sources.roles import RoleSchema
from panelreg.sources.years import load_years
from panelreg.streaming.scoring import score_stream, write_scores

ROLES = RoleSchema(("Age", "Cropsize"), ("Kinh", "Tea"), ("Edu",))
SETTINGS = RunSettings(
    (2010, 2014), 2016, smearing=True, prep=PrepSettings(0.05, 0.95, True, True), geography="province"
)


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("survey")
    rng = np.random.default_rng(11)
    for year in (2010, 2014, 2016):
        n = 400
        table = pd.DataFrame(
            {
                "ma_ho": np.arange(n), "tinh": rng.choice(["Dak Lak", "Long An", "Phu Tho"], n), "Age": rng.integers(20, 80, n),
                "Cropsize": np.exp(rng.normal(7, 1, n)).round(1), "Kinh": rng.integers(0, 2, n),
                "Edu": rng.choice(["No Diploma", "Primary", "Upper"], n),
            }
        )
        table["AgrInc"] = (table.Cropsize * (1 + table.Kinh) * np.exp(rng.normal(0, 0.3, n))).round(2)
        table.loc[rng.random(n) < 0.05, "AgrInc"] = None
        table.loc[rng.random(n) < 0.1, "Age"] = None
        if year == 2014:
            table["Tea"] = rng.integers(0, 2, n)
        if year == 2016:
            table["Tea"] = 1.0
        table.to_csv(folder / f"{year}.csv", index=False)
    return load_years(spark, str(folder), (2010, 2014, 2016)).persist()


@pytest.fixture(scope="module")
def runs(panel):
    linear = run_linear(panel, ROLES, SETTINGS)
    forest = run_forest(panel, ROLES, SETTINGS, ForestSettings(n_trees=6, max_depth=4), oob=True, permutation=True, repeats=2)
    boosting = BoostSettings(n_rounds=5, learning_rate=0.5, max_depth=2, patience=3)
    return [*linear, forest, run_boosting(panel, ROLES, SETTINGS, boosting, val_size=0.15)]


def reports(runs):
    return [run.report().first().asDict() for run in runs]


def test_reports_have_the_published_columns(runs):
    common = ["MAE", "RMSE", "R2", "smearing", "MAE_raw", "RMSE_raw", "R2_raw"]
    labels = ["model", "run", "train_years", "test_year", "target"]
    assert runs[0].report().columns == common + labels
    assert runs[2].report().columns == [*common, "R2_OOB", "model", "run", "target", "train_years", "test_year"]
    first = reports(runs)[0]
    assert (first["model"], first["run"], first["train_years"], first["test_year"]) == ("OLS", "time", "2010,2014", 2016)
    assert linear_report(runs[:2]).count() == 2


def test_error_and_fit_share_one_target_variance(runs):
    for rmse, r2 in (("RMSE", "R2"), ("RMSE_raw", "R2_raw")):
        spreads = [r[rmse] ** 2 / (1 - r[r2]) for r in reports(runs)]
        assert spreads == pytest.approx([spreads[0]] * len(runs), rel=1e-9)


def test_group_errors_average_to_the_overall_error(runs):
    for run in runs:
        counts = {r["Kinh"]: r["n"] for r in run.known.groupBy("Kinh").agg(F.count("*").alias("n")).collect()}
        groups = {r["Kinh"]: r["MAE_group"] for r in run.group_errors()["Kinh"].collect()}
        overall = sum(groups[g] * n for g, n in counts.items()) / sum(counts.values())
        assert overall == pytest.approx(run.report().first()["MAE_raw"], rel=1e-9)
        assert set(run.group_errors()) == {"Kinh", "tinh"}


def test_features_and_importances(runs):
    names = runs[0].preparation.feature_names()
    assert names == ["Age", "Cropsize", "Kinh_1.0", "Tea_1.0", "Edu_Primary", "Edu_Upper", "tinh_Long An", "tinh_Phu Tho"]
    assert [f for f, _ in runs[0].coefficients] == ["intercept", *names]
    for run in runs[2:]:
        assert sum(v for _, v in run.importances) == pytest.approx(1.0) and run.importances[0][0] == "Cropsize"
    assert runs[2].permutation.first()["feature"] == "Cropsize"
    assert 0 < runs[2].extra["R2_OOB"] < 1


def test_missing_incomes_are_scored_as_zero_on_log1p_only(panel):
    total = panel.filter("survey_year = 2016").count()
    known = panel.filter("survey_year = 2016 AND AgrInc IS NOT NULL").count()
    assert run_linear(panel, ROLES, SETTINGS, "ols")[0].predictions().count() == total
    plain = RunSettings((2010, 2014), 2016, scale="none")
    run = run_linear(panel, ROLES, plain, "ols")[0]
    assert run.predictions().count() == known < total
    assert run.report().columns[:4] == ["MAE", "RMSE", "R2", "model"]


def test_outputs_are_written(runs, spark, tmp_path):
    folder = str(tmp_path)
    write_linear(runs[:2], folder, save_predictions=True)
    write_forest(runs[2], folder, save_predictions=True, by_year=True)
    year = SETTINGS.year_column
    assert {p.name for p in (tmp_path / "RF_preds_time_2010,2014").iterdir() if "=" in p.name} == {f"{year}=2016"}
    write_boosting(runs[3], folder, "parquet")
    names = {p.name for p in tmp_path.iterdir()}
    run = "time_2010,2014_2016"
    assert {
        f"BASELINE_both_AgrInc_{run}", f"OLS_coeffs_{run}", f"Huber_coeffs_{run}", f"OLS_by_Kinh_{run}", f"Huber_by_tinh_{run}",
        f"OLS_preds_{run}", f"RF_AgrInc_{run}", f"RF_feature_importance_{run}", f"RF_perm_importance_{run}",
        f"XGB_AgrInc_{run}", f"XGB_feature_importance_{run}",
    } <= names
    predictions = spark.read.csv(f"{folder}/OLS_preds_{run}", header=True)
    assert {"AgrInc_true", "AgrInc_pred", "ma_ho", "tinh"} <= set(predictions.columns) and "AgrInc" not in predictions.columns


def test_wrong_choices_are_errors(panel):
    with pytest.raises(ValueError, match="linear model"):
        run_linear(panel, ROLES, SETTINGS, "ridge")
    with pytest.raises(ValueError, match="validation share"):
        run_boosting(panel, ROLES, SETTINGS, BoostSettings(patience=5), val_size=0.7)
    with pytest.raises(ValueError, match="target column"):
        prepare_split(panel, ROLES, RunSettings((2010,), 2016, target="Nothing"))
    with pytest.raises(ValueError, match="1999"):
        prepare_split(panel, ROLES, RunSettings((1999,), 2016))


def test_a_missing_id_does_not_give_rows_one_key(panel):
    blank = panel.withColumn("ma_ho", F.when(F.col("ma_ho").cast("int") % 3 > 0, F.col("ma_ho")))
    stored, rows = store_training(prepare_split(blank, ROLES, SETTINGS))
    assert rows.select("key").distinct().count() == rows.count() == 800
    stored.drop()


@pytest.mark.filterwarnings("ignore:the table lacks")
def test_a_stream_is_typed_like_the_batch(panel, spark, tmp_path):
    coded = panel.withColumn("tinh", F.when(F.col("tinh") == "Dak Lak", 0.0).when(F.col("tinh") == "Long An", 1.0).otherwise(2.0))
    coded = coded.withColumn("AgrInc", F.col("AgrInc") * (1 + 5 * F.col("tinh")))
    settings = RunSettings((2010, 2014), 2016, geography="province", year_feature=True)
    test = coded.filter("survey_year = 2016")
    test.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    run = run_linear(coded, ROLES, settings, "ols")[0]
    write_scores(score_stream(stream, run, ROLES), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    scored = {r["ma_ho"]: r["AgrInc_pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["ma_ho"]: r["AgrInc_pred"] for r in run.predictions().collect()}
    assert batch and all(scored[k] == pytest.approx(v) for k, v in batch.items())


def test_a_fitted_run_scores_a_stream(runs, panel, spark, tmp_path):
    test = panel.filter("survey_year = 2016")
    test.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    for run in (runs[0], runs[3]):
        out = str(tmp_path / f"out_{run.name}")
        write_scores(score_stream(stream, run, ROLES), out, str(tmp_path / f"state_{run.name}")).awaitTermination()
        scored = spark.read.parquet(out).select("ma_ho", "AgrInc_pred").toPandas().sort_values("ma_ho")
        batch = run.predictions().select("ma_ho", "AgrInc_pred").toPandas().sort_values("ma_ho")
        assert scored["AgrInc_pred"].to_numpy() == pytest.approx(batch["AgrInc_pred"].to_numpy())
