"""Queries over the linear models, metrics, reports and sinks."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.catalog.base import (
    FITTED, HH, LABEL, NUMERIC_ROLES, PREPARED, ROLES, TEST_YEAR, TRAIN_YEARS, households, is_train, metrics_sql, query, rounded, settings,
)
from panelreg.catalog.prep_queries import numeric_fit
from panelreg.catalog.source_queries import _finish
from panelreg.functions.target import to_learning_scale
from panelreg.operators import evaluate
from panelreg.operators.evaluate import metric_columns
from panelreg.operators.linear import LinearFit, cross_products, fit_huber, fit_ols, huber_gradient, huber_objective
from panelreg.operators.preprocess import PrepSettings, fit_preparation
from panelreg.plans.common import ModelRun, prepare_split
from panelreg.plans.linear_job import linear_report, run_linear
from panelreg.session import new_path
from panelreg.sources.roles import FeatureColumns
from panelreg.sources.sinks import write_rows, write_small

LABELS = f"'time' AS run, '{','.join(map(str, TRAIN_YEARS))}' AS train_years, {TEST_YEAR} AS test_year, 'revenue' AS target"
DIGITS = {"MAE": 6, "RMSE": 6, "R2": 6, "smearing": 6, "MAE_raw": 3, "RMSE_raw": 3, "R2_raw": 6}
REPORT_SQL = f"""WITH {HH}, {FITTED} SELECT {metrics_sql("label", "yhat")}, round(any_value(factor), 6) AS smearing,
  {metrics_sql("y_true", "y_pred", "_raw", 3)}, 'OLS' AS model, {LABELS} FROM scored, sm"""


def _ols_run(spark: SparkSession, sf_dir: str, **changes) -> ModelRun:
    return run_linear(households(spark, sf_dir), NUMERIC_ROLES, settings(**changes), "ols")[0]


@query(REPORT_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear job end to end: load, type, split, prepare, fit, smear, score, report."""
    return rounded(_ols_run(spark, sf_dir).report(), **DIGITS)


@query(
    f"""WITH {HH}, {PREPARED}, d AS (SELECT 1.0 AS v0, x1 AS v1, x2 AS v2, label AS v3 FROM x WHERE yr <= 2000)
{" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(v{i} * v{j}), 4) AS value FROM d" for i in range(4) for j in range(i, 4))}"""
)
def ols_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products over [1, acctbal, n_lines, label] of the training rows."""
    train, _, preparation = numeric_fit(spark, sf_dir, settings().prep)
    # adding zero turns a rounded negative zero into a plain one
    return cross_products(train, preparation).withColumn("value", F.round("value", 4) + 0.0)


@query(
    f"""WITH {HH}, m AS (SELECT median(n_lines) AS mn FROM tr), d AS (SELECT coalesce(n_lines, mn) AS v, {LABEL} AS label FROM tr, m)
SELECT 'intercept' AS feature, round(regr_intercept(label, v), 6) AS coef FROM d
UNION ALL SELECT 'n_lines', round(regr_slope(label, v), 6) FROM d"""
)
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = replace(NUMERIC_ROLES, numeric=("n_lines",))
    run = run_linear(households(spark, sf_dir), roles, settings(prep=PrepSettings()), "ols")[0]
    return rounded(run.coefficient_table(), coef=6)


@query(
    f"""WITH {HH}, {FITTED} SELECT 'intercept' AS feature, round(b0, 6) AS coef FROM beta
UNION ALL SELECT 'acctbal', round(b1, 6) FROM beta UNION ALL SELECT 'n_lines', round(b2, 6) FROM beta"""
)
def ols_two_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ols_run(spark, sf_dir).coefficient_table(), coef=6)


NEAR = 0.0001


# the same plane over acctbal and n_lines, whose axes are far from collinear
@query(
    f"""WITH {HH}, d AS (SELECT acctbal AS a, n_lines::DOUBLE AS n, {LABEL} AS y FROM tr WHERE acctbal IS NOT NULL AND n_lines IS NOT NULL),
s AS (SELECT var_pop(a) AS va, var_pop(n) AS vn, covar_pop(a, n) AS can, covar_pop(y, a) AS cya, covar_pop(y, n) AS cyn,
  avg(a) AS ma, avg(n) AS mn, avg(y) AS my FROM d),
c AS (SELECT *, (cya * vn - cyn * can) / (va * vn - can * can) AS ca, (cyn * va - cya * can) / (va * vn - can * can) AS cn FROM s)
SELECT 'acctbal' AS feature, round(ca - cn / {NEAR}, 2) AS coef FROM c UNION ALL SELECT 'beside', round(cn / {NEAR}, 2) FROM c
UNION ALL SELECT 'intercept', round(my - ca * ma - cn * mn, 6) FROM c"""
)
def ols_near_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns that differ by a ten-thousandth of a third: cross products would lose all digits of their coefficients."""
    rows = households(spark, sf_dir).filter(is_train()).where("acctbal IS NOT NULL AND n_lines IS NOT NULL")
    rows = rows.withColumn("label", to_learning_scale(F.col("revenue"), "log1p")).withColumn("beside", F.col("acctbal") + NEAR * F.col("n_lines"))
    preparation = fit_preparation(rows, FeatureColumns(("acctbal", "beside"), ()), PrepSettings())
    lines = fit_ols(preparation.apply(rows), preparation).rows()
    return spark.createDataFrame([(n, round(c, 6 if n == "intercept" else 2)) for n, c in lines], "feature string, coef double")


CELLS = 10_007


# dummies of all cells take the cell means out of both sides
@query(
    f"""WITH {HH}, d AS (SELECT hh_id % {CELLS} AS cell, n_lines::DOUBLE AS n, {LABEL} AS y FROM tr WHERE n_lines IS NOT NULL),
m AS (SELECT cell, avg(n) AS mn, avg(y) AS my FROM d GROUP BY cell),
b AS (SELECT sum((n - mn) * (y - my)) / sum((n - mn) * (n - mn)) AS slope FROM d JOIN m USING (cell)),
base AS (SELECT my - slope * mn AS level FROM m, b WHERE cell = (SELECT min(cell) FROM m))
SELECT 'n_lines' AS feature, round(slope, 5) AS coef FROM b UNION ALL SELECT 'intercept', round(level, 5) FROM base
UNION ALL SELECT 'cell_' || cell, round(my - slope * mn - level, 5) FROM m, b, base WHERE cell > (SELECT min(cell) FROM m)"""
)
def ols_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category with ten thousand levels, solved by gradients over codes."""
    rows = households(spark, sf_dir).filter(is_train()).where("n_lines IS NOT NULL")
    rows = rows.withColumn("label", to_learning_scale(F.col("revenue"), "log1p")).withColumn("cell", (F.col("hh_id") % CELLS).cast("string"))
    preparation = fit_preparation(rows, FeatureColumns(("n_lines",), ("cell",)), PrepSettings(drop_first=True))
    lines = fit_ols(preparation.apply(rows), preparation).rows()
    return spark.createDataFrame([(n, round(c, 5)) for n, c in lines], "feature string, coef double")


@query("SELECT feature, true AS balanced FROM (VALUES ('intercept'), ('acctbal'), ('n_lines'), ('is_f_1.0'), ('is_f_0.0'), "
       "('priority_1-URGENT'), ('priority_2-HIGH'), ('priority_3-MEDIUM'), ('priority_4-NOT SPECIFIED'), ('priority_5-LOW')) t(feature)")  # fmt: skip
def ols_full_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collinear design (all dummies and an intercept): residuals must be orthogonal to every column."""
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    preparation = fit_preparation(split.train, split.features, PrepSettings(0.05, 0.95, scale_numeric=True))
    train = preparation.apply(split.train)
    fit = fit_ols(train, preparation)
    residual = F.col("label") - fit.score()
    names = ["intercept", *preparation.feature_names()]
    products = [F.abs(F.avg(residual * x)) for x in (F.lit(1.0), *preparation.design_columns())]
    lines = [F.struct(F.lit(n).alias("feature"), (p < 1e-8).alias("balanced")) for n, p in zip(names, products)]
    return train.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


@query(f"WITH {HH}, {FITTED} SELECT {metrics_sql('label', 'yhat')} FROM scored")
def metrics_mae_rmse_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _ols_run(spark, sf_dir).known
    return rounded(known.agg(*metric_columns("label", "yhat")), MAE=6, RMSE=6, R2=6)


@query(f"WITH {HH}, {FITTED} SELECT {metrics_sql('y_true', 'y_pred', '_raw', 3)} FROM scored")
def metrics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _ols_run(spark, sf_dir).known
    return rounded(known.agg(*metric_columns("y_true", "y_pred", "_raw")), MAE_raw=3, RMSE_raw=3, R2_raw=6)


@query(
    f"""WITH {HH}, {FITTED} SELECT 'region' AS grouping, region AS level, round(avg(abs(y_true - y_pred)), 3) AS MAE_group FROM scored GROUP BY 2
UNION ALL SELECT 'province', province, round(avg(abs(y_true - y_pred)), 3) FROM scored GROUP BY 2"""
)
def group_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two group columns from one pass over the scored test year."""
    return rounded(_ols_run(spark, sf_dir, group_columns=("region", "province")).group_error_lines(), MAE_group=3)


# targets of segment BUILDING are unknown, so the level is listed without an error
UNOBSERVED_SQL = f"""WITH {HH.replace(", revenue\n  FROM orders", ", CASE WHEN c_mktsegment = 'BUILDING' AND year(o_orderdate) = 2001 THEN NULL ELSE revenue END AS revenue\n  FROM orders")},
a AS (SELECT *, asinh(revenue) AS label, median(n_lines) FILTER (yr <= 2000 AND revenue IS NOT NULL) OVER () AS mn FROM hh),
d AS (SELECT segment, yr, label, coalesce(n_lines, mn) AS v FROM a),
f AS (SELECT regr_slope(label, v) AS b1, regr_intercept(label, v) AS b0 FROM d WHERE yr <= 2000 AND label IS NOT NULL),
e AS (SELECT segment, abs(sinh(label) - sinh(b0 + b1 * v)) AS err FROM d, f WHERE yr = 2001)
SELECT segment, round(avg(err), 3) AS MAE_group FROM e GROUP BY segment"""


@query(UNOBSERVED_SQL)
def group_mae_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = (F.col("segment") == "BUILDING") & (F.col("yr") == TEST_YEAR)
    panel = households(spark, sf_dir).withColumn("revenue", F.when(~unknown, F.col("revenue")))
    roles = replace(NUMERIC_ROLES, numeric=("n_lines",))
    choice = settings(scale="asinh", prep=PrepSettings())
    run = run_linear(panel, roles, choice, "ols")[0]
    return rounded(evaluate.group_mae(run.scored, "segment", "y_true", "y_pred"), MAE_group=3)


@query(
    f"""WITH {HH}, {FITTED} SELECT hh_id, yr, acctbal, n_lines, priority, is_f, segment, province, region,
  round(y_true, 6) AS revenue_true, round(y_pred, 2) AS revenue_pred FROM scored"""
)
def predictions_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row with its true and predicted income."""
    return rounded(_ols_run(spark, sf_dir).predictions(), revenue_true=6, revenue_pred=2)


@query(
    f"""WITH {HH}, {FITTED} SELECT model, {LABELS}, round(smearing, 6) AS smearing, n FROM (
  SELECT 'OLS' AS model, (SELECT factor FROM sm) AS smearing, (SELECT count(*) FROM te) AS n
  UNION ALL SELECT 'OLS_plain', NULL, (SELECT count(*) FROM te WHERE revenue IS NOT NULL))"""
)
def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with different columns below each other: an untransformed target has no smearing."""
    logged = _ols_run(spark, sf_dir)
    plain = _ols_run(spark, sf_dir, scale="none")
    plain.name = "OLS_plain"
    counts = [run.known.agg(F.lit(run.name).alias("model"), F.count(F.lit(1)).alias("n")) for run in (logged, plain)]
    report = linear_report([logged, plain]).join(reduce(DataFrame.unionByName, counts), "model")
    kept = report.select("model", "run", "train_years", "test_year", "target", "smearing", "n")
    return rounded(kept, smearing=6)


@query(REPORT_SQL)
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as CSV and read back."""
    report = rounded(_ols_run(spark, sf_dir).report(), **DIGITS)
    folder = new_path(spark, "report")
    write_small(report, f"{folder}/report")
    return _finish(spark.read.csv(f"{folder}/report", header=True, schema=report.schema), folder)


@query(
    f"""WITH {HH}, {FITTED} SELECT hh_id, CAST(yr AS INT) AS yr, round(y_pred, 2) AS revenue_pred FROM scored
UNION ALL SELECT hh_id, CAST(yr AS INT), -1.0 FROM hh WHERE yr <> {TEST_YEAR}"""
)
def predictions_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by years, written whole and then again with one year's predictions: the other years stay as they were."""
    rows = households(spark, sf_dir).select("hh_id", F.lit(-1.0).alias("revenue_pred"), F.col("yr").cast("int").alias("yr"))
    path = f"{new_path(spark, 'by-year')}/predictions"
    write_rows(rows, path, "parquet", ("yr",))
    found = _ols_run(spark, sf_dir).predictions().select("hh_id", F.round("revenue_pred", 2).alias("revenue_pred"), F.col("yr").cast("int").alias("yr"))
    write_rows(found, path, "parquet", ("yr",))
    return spark.read.parquet(path)


HUBER_AT = {"intercept": 10.0, "acctbal": 0.01, "n_lines": 0.6, "scale": 0.5}


@query(
    f"""WITH {HH}, {PREPARED}, z AS (SELECT abs(10.0 + 0.01 * x1 + 0.6 * x2 - label) / 0.5 AS z FROM x WHERE yr <= 2000)
SELECT count(*) AS n, round(avg(0.5 + CASE WHEN z < 1.35 THEN z * z ELSE 2 * 1.35 * z - 1.35 * 1.35 END * 0.5), 6) AS objective FROM z"""
)
def huber_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean Huber objective at a given point."""
    train, _, preparation = numeric_fit(spark, sf_dir, settings().prep)
    at = LinearFit("Huber", preparation, HUBER_AT["intercept"], (HUBER_AT["acctbal"], HUBER_AT["n_lines"]), HUBER_AT["scale"])
    share = huber_objective(at.score() - F.col("label"), F.lit(at.scale), 1.35)
    return train.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 6).alias("objective"))


@query("SELECT feature, true AS stationary FROM (VALUES ('intercept'), ('acctbal'), ('n_lines'), ('is_f_1.0'), ('priority_2-HIGH'), "
       "('priority_3-MEDIUM'), ('priority_4-NOT SPECIFIED'), ('priority_5-LOW'), ('scale')) t(feature)")  # fmt: skip
def huber_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the Huber fit every derivative of the objective, per row, is nearly zero."""
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    train = split.train.persist()
    preparation = fit_preparation(train, split.features, settings().prep)
    prepared = preparation.apply(train)
    fit = fit_huber(prepared, preparation)
    gradient = huber_gradient(prepared, fit, 1.35, 1e-4)
    lines = gradient.select("feature", (F.abs("gradient") / prepared.count() < 1e-4).alias("stationary")).collect()
    train.unpersist()
    return spark.createDataFrame(lines, "feature string, stationary boolean")


@query()
def linear_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full linear job, OLS and Huber with all features, as one report."""
    return linear_report(run_linear(households(spark, sf_dir), ROLES, settings(), "both"))


@query(
    f"""WITH {HH}, v AS (SELECT round(var_pop({LABEL}), 6) AS variance, round(var_pop(greatest(coalesce(revenue, 0), 0)) / 1e6, 3) AS variance_raw,
  count(*) AS n FROM te) SELECT m.model, variance, variance_raw, true AS beats_mean, n FROM v, (VALUES ('OLS'), ('Huber')) m(model)"""
)
def linear_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports of both linear models must agree on: the variance of the test target."""

    def variance(suffix: str) -> Column:
        error = F.col(f"RMSE{suffix}")
        return error * error / (1 - F.col(f"R2{suffix}"))

    runs = run_linear(households(spark, sf_dir), ROLES, settings(), "both")
    counts = [run.known.agg(F.lit(run.name).alias("model"), F.count(F.lit(1)).alias("n")) for run in runs]
    report = linear_report(runs).join(reduce(DataFrame.unionByName, counts), "model")
    return report.select(
        "model",
        F.round(variance(""), 6).alias("variance"),
        F.round(variance("_raw") / 1e6, 3).alias("variance_raw"),
        (F.col("R2") > 0).alias("beats_mean"),
        "n",
    )
