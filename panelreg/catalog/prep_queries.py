"""Queries over target scales and learned preprocessing; statistics always come from training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelreg.catalog.base import (
    FITTED, HH, LABEL, NUMERIC_ROLES, PREPARED, ROLES, TEST_YEAR, households, is_train, query, read_table, rounded, settings,
)
from panelreg.functions.target import hold_smearing, invert, smearing_factor, to_learning_scale, to_raw_prediction
from panelreg.operators.levels import level_counts, summarize_levels
from panelreg.operators.linear import fit_ols
from panelreg.operators.preprocess import Preparation, PrepSettings, fit_preparation
from panelreg.plans.common import prepare_split
from panelreg.sources.roles import FeatureColumns, RoleSchema


def _target_profile(spark: SparkSession, sf_dir: str, scale: str) -> DataFrame:
    signed = F.when(F.col("hh_id") % 3 == 0, -F.col("revenue")).otherwise(F.col("revenue"))
    label = to_learning_scale(signed, scale)
    return (
        households(spark, sf_dir).select("yr", label.alias("label"))
        .filter("label IS NOT NULL")
        .groupBy("yr")
        .agg(F.count("label").alias("n"), F.round(F.avg("label"), 5).alias("mean"), F.round(F.max("label"), 5).alias("top"))
    )


def _target_sql(expression: str) -> str:
    return f"""WITH {HH}, t AS (SELECT yr, CASE WHEN hh_id % 3 = 0 THEN -revenue ELSE revenue END AS y FROM hh),
l AS (SELECT yr, {expression} AS label FROM t)
SELECT yr, count(label) AS n, round(avg(label), 5) AS mean, round(max(label), 5) AS top
FROM l WHERE label IS NOT NULL GROUP BY yr"""


@query(_target_sql("y"))
def target_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_profile(spark, sf_dir, "none")


@query(_target_sql("ln(1 + greatest(coalesce(y, 0), 0))"))
def target_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_profile(spark, sf_dir, "log1p")


@query(_target_sql("sign(y) * ln(abs(y) + sqrt(y * y + 1))"))
def target_asinh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_profile(spark, sf_dir, "asinh")


@query(
    f"""WITH {HH}, t AS (SELECT hh_id, {LABEL} - 0.5 * coalesce(n_lines, 0) AS yhat FROM hh)
SELECT hh_id, round(greatest(1.2345678 * (exp(yhat) - 1), 0), 2) AS raw FROM t"""
)
def backtransform_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = to_learning_scale(F.col("revenue"), "log1p")
    yhat = label - 0.5 * F.coalesce("n_lines", F.lit(0.0))
    return households(spark, sf_dir).select("hh_id", F.round(to_raw_prediction(yhat, "log1p", 1.2345678), 2).alias("raw"))


@query(
    f"""WITH {HH}, t AS (SELECT hh_id, ln(revenue + sqrt(revenue * revenue + 1)) AS label FROM hh)
SELECT hh_id, round(sinh(label), 6) AS raw, round(sinh(label - 1), 2) AS shifted FROM t"""
)
def backtransform_asinh(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = to_learning_scale(F.col("revenue"), "asinh")
    return households(spark, sf_dir).select(
        "hh_id",
        F.round(invert(label, "asinh"), 6).alias("raw"),
        F.round(to_raw_prediction(label - 1, "asinh"), 2).alias("shifted"),
    )


@query(f"WITH {HH}, {FITTED} SELECT round(factor, 6) AS smearing, round(raw_factor, 6) AS unclipped FROM sm")
def duan_smearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, preparation = numeric_fit(spark, sf_dir, settings().prep)
    fit = fit_ols(train, preparation)
    factor = train.agg(smearing_factor(F.col("label"), fit.score()).alias("unclipped"))
    return rounded(factor.select(hold_smearing(F.col("unclipped")).alias("smearing"), "unclipped"), smearing=6, unclipped=6)


def numeric_fit(spark: SparkSession, sf_dir: str, prep: PrepSettings) -> tuple[DataFrame, DataFrame, Preparation]:
    """(prepared training rows, prepared rows of all years, preparation) on the two numeric columns."""
    panel = households(spark, sf_dir)
    labelled = panel.withColumn("label", to_learning_scale(F.col("revenue"), "log1p"))
    features = prepare_split(panel, NUMERIC_ROLES, settings()).features
    preparation = fit_preparation(labelled.filter(is_train()), features, prep)
    prepared = preparation.apply(labelled)
    return prepared.filter(is_train()), prepared, preparation


def _numeric_values(spark: SparkSession, sf_dir: str, prep: PrepSettings) -> DataFrame:
    _, prepared, _ = numeric_fit(spark, sf_dir, prep)
    return prepared.select("hh_id", F.round("num_0", 6).alias("acctbal"), F.round("num_1", 6).alias("n_lines"))


@query(f"WITH {HH}, {PREPARED} SELECT hh_id, round(a0, 6) AS acctbal, round(n0, 6) AS n_lines FROM imp")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric_values(spark, sf_dir, PrepSettings())


@query(f"WITH {HH}, {PREPARED} SELECT hh_id, round(a1, 6) AS acctbal, round(n1, 6) AS n_lines FROM win")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric_values(spark, sf_dir, PrepSettings(0.05, 0.95))


@query(f"WITH {HH}, {PREPARED} SELECT hh_id, round(x1, 6) AS acctbal, round(x2, 6) AS n_lines FROM x")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric_values(spark, sf_dir, PrepSettings(0.05, 0.95, scale_numeric=True))


CATEGORIES = RoleSchema(categorical_binary=("is_f",), categorical_ordinal=("priority",))
CATEGORY_MODES = """cm AS (
  SELECT (SELECT is_f FROM tr WHERE is_f IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mf,
    (SELECT priority FROM tr WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp)"""


def category_fit(spark: SparkSession, sf_dir: str, prep: PrepSettings, train=None) -> tuple[DataFrame, Preparation]:
    """(all rows with category codes, preparation) on the two categories."""
    panel = prepare_split(households(spark, sf_dir), CATEGORIES, settings())
    typed = households(spark, sf_dir).withColumn("is_f", F.col("is_f").cast("string"))
    rows = typed.filter(is_train() if train is None else train)
    preparation = fit_preparation(rows, panel.features, prep)
    return preparation.apply(typed), preparation


@query(
    f"""WITH {HH}, {CATEGORY_MODES} SELECT hh_id, coalesce(CAST(is_f AS VARCHAR), CAST(mf AS VARCHAR)) AS is_f,
  coalesce(priority, mp) AS priority FROM hh, cm"""
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, preparation = category_fit(spark, sf_dir, PrepSettings())
    return coded.select("hh_id", *[s.imputed().alias(s.column) for s in preparation.categories])


@query(
    f"""WITH {HH} SELECT 'priority' AS "column", priority AS level, count(*) AS n FROM tr GROUP BY 2
UNION ALL SELECT 'province', province, count(*) FROM tr GROUP BY 2
UNION ALL SELECT 'segment', segment, count(*) FROM tr GROUP BY 2""",
    name="level_counts",
)
def level_counts_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(households(spark, sf_dir).filter(is_train()), ["priority", "province", "segment"])


@query(
    f"""WITH {HH}, pc AS (SELECT province, count(*) AS n FROM tr GROUP BY 1),
keep AS (SELECT province FROM pc WHERE n >= (SELECT count(*) FROM tr) / 25.0)
SELECT hh_id, CASE WHEN province IN (SELECT province FROM keep) THEN province ELSE 'Other' END AS province FROM hh"""
)
def rare_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces with less than an even share of the training rows become one level."""
    panel = households(spark, sf_dir)
    total = panel.filter(is_train()).count()
    roles = RoleSchema(categorical_ordinal=("province",))
    features = prepare_split(panel, roles, settings()).features
    least = -(-total // 25)
    preparation = fit_preparation(panel.filter(is_train()), features, PrepSettings(rare_min_count=least))
    levels = F.array(*map(F.lit, preparation.categories[0].levels))
    return preparation.apply(panel).select("hh_id", F.get(levels, F.col("code_0")).alias("province"))


@query(
    """WITH t AS (SELECT o_orderkey AS hh_id, o_custkey AS c, year(o_orderdate) <= 2000 AS train FROM orders),
lv AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT c FROM t WHERE train))
SELECT hh_id, CAST(coalesce(code, -1) AS INT) AS code FROM t LEFT JOIN lv USING (c)"""
)
def many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category of thousands of levels, the customers: codes are places in the order of the training levels."""
    orders = read_table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("hh_id"), F.year("o_orderdate").alias("yr"), F.col("o_custkey").cast("string").alias("c")
    )
    preparation = fit_preparation(rows.filter(is_train()), FeatureColumns((), ("c",)))
    return preparation.apply(rows).select("hh_id", F.col("code_0").alias("code"))


ONEHOT_SQL = f"""WITH {HH}, {CATEGORY_MODES}, v AS (
  SELECT hh_id, yr, coalesce(is_f, mf) AS f, coalesce(priority, mp) AS p FROM hh, cm)"""


def _dummies(rows: DataFrame, preparation: Preparation) -> DataFrame:
    """The design matrix with column names that need no quoting."""
    names = [n.replace(".", "_").replace("-", "_").replace(" ", "_").lower() for n in preparation.feature_names()]
    columns = [c.alias(n) for c, n in zip(preparation.design_columns(), names)]
    return rows.select("hh_id", *columns)


@query(
    f"""{ONEHOT_SQL} SELECT hh_id, CASE WHEN f = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f_1_0,
  {", ".join(f"CASE WHEN p = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS priority_{p.replace('-', '_').replace(' ', '_').lower()}"
             for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM v"""
)
def onehot_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dummies(*category_fit(spark, sf_dir, PrepSettings(drop_first=True)))


@query(
    f"""WITH {HH}, fit AS (SELECT * FROM tr WHERE priority IS NULL OR priority NOT IN ('1-URGENT', '3-MEDIUM')), {CATEGORY_MODES.replace("FROM tr", "FROM fit")},
v AS (SELECT hh_id, coalesce(is_f, mf) AS f, coalesce(priority, mp) AS p FROM hh, cm)
SELECT hh_id, CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f_0_0, CASE WHEN f = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f_1_0,
  {", ".join(f"CASE WHEN p = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS priority_{p.replace('-', '_').replace(' ', '_').lower()}"
             for p in ("2-HIGH", "4-NOT SPECIFIED", "5-LOW"))} FROM v"""
)
def onehot_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels the training rows lack have no dummy: their rows are all zeros."""
    seen = is_train() & ~F.coalesce(F.col("priority").isin("1-URGENT", "3-MEDIUM"), F.lit(False))
    return _dummies(*category_fit(spark, sf_dir, PrepSettings(), train=seen))


@query(
    f"""WITH {HH} SELECT yr, count(*) AS n,
  {", ".join(f"sum(CASE WHEN yr = {y} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS year_{y}" for y in range(1996, 2001))} FROM hh GROUP BY yr"""
)
def year_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey year as a category; the test year is an unknown level."""
    panel = households(spark, sf_dir)
    split = prepare_split(panel, RoleSchema(), settings(year_feature=True))
    preparation = fit_preparation(split.train, split.features, PrepSettings(drop_first=True))
    coded = preparation.apply(panel.withColumn("year", F.col("yr").cast("string")))
    dummies = coded.select("yr", *preparation.design_columns())
    return dummies.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(n)).alias(n) for n in preparation.feature_names()]
    )


@query(
    f"""WITH {HH}, {PREPARED}, {CATEGORY_MODES} SELECT hh_id, round(x1, 6) AS acctbal, round(x2, 6) AS n_lines,
  CASE WHEN coalesce(is_f, mf) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f_1_0,
  {", ".join(f"CASE WHEN coalesce(priority, mp) = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS priority_{p.replace('-', '_').replace(' ', '_').lower()}"
             for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM x, cm WHERE yr = {TEST_YEAR}"""
)
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded test year: numeric block, then the dummies of each category."""
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    preparation = fit_preparation(split.train, split.features, settings().prep)
    return rounded(_dummies(preparation.apply(split.test), preparation), acctbal=6, n_lines=6)


@query(
    f"""WITH {HH}, {PREPARED}, {CATEGORY_MODES} SELECT round(any_value(ma), 4) AS median_acctbal, round(any_value(alo), 4) AS low_acctbal,
  round(any_value(ahi), 4) AS high_acctbal, round(any_value(am), 4) AS mean_acctbal, round(any_value(ad), 4) AS deviation_acctbal,
  round(any_value(nm), 6) AS mean_n_lines, round(any_value(nd), 6) AS deviation_n_lines, any_value(mp) AS mode_priority,
  (SELECT count(*) FROM te) AS test_rows FROM med, qu, mo, cm"""
)
def fit_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned parameters; the test year takes no part in them."""
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    preparation = fit_preparation(split.train, split.features, settings().prep)
    a, n = preparation.numeric
    values = {
        "median_acctbal": round(a.median, 4), "low_acctbal": round(a.low, 4), "high_acctbal": round(a.high, 4),
        "mean_acctbal": round(a.mean, 4), "deviation_acctbal": round(a.deviation, 4), "mean_n_lines": round(n.mean, 6),
        "deviation_n_lines": round(n.deviation, 6), "mode_priority": preparation.categories[1].mode,
    }
    return split.test.agg(*[F.lit(v).alias(k) for k, v in values.items()], F.count(F.lit(1)).alias("test_rows"))


@query(
    f"""WITH {HH}, c AS (SELECT 'priority' AS "column", priority AS level, count(*) AS n FROM hh WHERE priority IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'province', province, count(*) FROM hh GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM hh GROUP BY 2)
SELECT "column", level AS mode FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS r FROM c) WHERE r = 1"""
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each category over all years, the smallest level on a tie."""
    found = summarize_levels(households(spark, sf_dir), ["priority", "province", "segment"])
    return spark.createDataFrame([(c, summary.mode) for c, summary in found.items()], "column string, mode string")
