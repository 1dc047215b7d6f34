"""Queries over sources, typing, column selection, stacking and splitting."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelreg.catalog.base import (
    HH, ROLES, TEST_YEAR, TRAIN_YEARS, digest_sql, households, query, settings,
)
from panelreg.functions.hashing import RANGE
from panelreg.functions.typing import to_level, to_number
from panelreg.operators.levels import level_counts
from panelreg.operators.preprocess import PrepSettings, fit_preparation
from panelreg.operators.validation import split_by_share, split_exact
from panelreg.plans.common import prepare_split, store_training
from panelreg.session import hadoop_path, new_path
from panelreg.sources.roles import GEOGRAPHY, RoleSchema, cast_roles, select_features
from panelreg.sources.sinks import write_rows
from panelreg.sources.years import load_years, parse_stata, split_years, stack_years

ALL_YEARS = (*TRAIN_YEARS, TEST_YEAR)
TEXT = ("hh_id", "yr", "acctbal", "n_lines", "priority", "is_f", "revenue")


def _finish(result: DataFrame, folder: str) -> DataFrame:
    """A small result computed now, so that the files it came from can be removed."""
    spark = result.sparkSession
    rows = result.collect()
    files, path = hadoop_path(spark, folder)
    files.delete(path, True)
    return spark.createDataFrame(rows, result.schema)


def _typed_profile(panel: DataFrame, year: str) -> DataFrame:
    return (
        cast_roles(panel, ROLES, numbers=("revenue",))
        .groupBy(F.col(year).alias("yr"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("acctbal").alias("n_acctbal"),
            F.count("priority").alias("n_priority"),
            F.count("is_f").alias("n_is_f"),
            F.round(F.sum("acctbal"), 2).alias("sum_acctbal"),
            F.round(F.sum("revenue"), 2).alias("sum_revenue"),
        )
    )


PROFILE_SQL = f"""WITH {HH} SELECT yr, count(*) AS n, count(acctbal) AS n_acctbal, count(priority) AS n_priority,
  count(is_f) AS n_is_f, round(sum(acctbal), 2) AS sum_acctbal, round(sum(revenue), 2) AS sum_revenue
FROM hh GROUP BY yr"""


@query(PROFILE_SQL)
def load_year_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year files in both spellings; the cleaned one must win, the plain one serves the rest."""
    panel = households(spark, sf_dir).select(*TEXT).persist()
    folder = new_path(spark, "years")
    for year in ALL_YEARS:
        rows = panel.filter(F.col("yr") == year)
        cleaned = year % 2 == 0
        write_rows(rows, f"{folder}/{year}_clean.csv" if cleaned else f"{folder}/{year}.csv")
        if cleaned:
            write_rows(rows.withColumn("revenue", F.lit(0.0)), f"{folder}/{year}.csv")
    panel.unpersist()
    return _finish(_typed_profile(load_years(spark, folder, ALL_YEARS), "survey_year"), folder)


@query(PROFILE_SQL)
def csv_scan_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps written as the various missing tokens come back as gaps."""
    panel = households(spark, sf_dir).select(*TEXT)
    folder = new_path(spark, "csv")
    tokens = F.array(*[F.lit(t) for t in ("NA", "nan", "NULL", "#N/A", "", "None", "n/a")])
    token = F.get(tokens, (F.col("hh_id") % 7).cast("int"))
    filled = panel.select(*[F.coalesce(F.col(c).cast("string"), token).alias(c) for c in TEXT]).persist()
    for year in ALL_YEARS:
        write_rows(filled.filter(F.col("yr") == str(year)), f"{folder}/{year}.csv")
    filled.unpersist()
    return _finish(_typed_profile(load_years(spark, folder, ALL_YEARS), "survey_year"), folder)


def _to_stata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["priority"] = batch["priority"].astype("category")
        out = io.BytesIO()
        batch.to_stata(out, write_index=False, version=118)
        yield pd.DataFrame({"content": [out.getvalue()]})


@query(PROFILE_SQL)
def stata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as labelled Stata files, one per batch, read back in parallel."""
    files = households(spark, sf_dir).select(*TEXT).mapInPandas(_to_stata, "content binary")
    return _typed_profile(parse_stata(files), "yr").withColumn("yr", F.col("yr").cast("int"))


@query(
    f"""WITH {HH}, t AS (SELECT yr, hh_id % 8 AS kind, CASE hh_id % 8 WHEN 0 THEN 'abc' WHEN 1 THEN 'nan' WHEN 2 THEN ''
  WHEN 3 THEN ' ' || CAST(n_lines AS VARCHAR) || 'e1 ' ELSE CAST(acctbal AS VARCHAR) END AS raw FROM hh)
SELECT yr, count(*) AS n, count(CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END) AS parsed,
  round(sum(CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END), 3) AS total
FROM t GROUP BY yr"""
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("hh_id") % 8
    raw = (
        F.when(kind == 0, "abc").when(kind == 1, "nan").when(kind == 2, "")
        .when(kind == 3, F.concat(F.lit(" "), F.col("n_lines").cast("string"), F.lit("e1 ")))
        .otherwise(F.col("acctbal").cast("string"))
    )
    text = households(spark, sf_dir).select("yr", raw.alias("raw"))
    number = to_number(F.col("raw"), text.schema["raw"].dataType)
    return text.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("parsed"), F.round(F.sum(number), 3).alias("total")
    )


@query(
    f"""WITH {HH} SELECT 'flag' AS "column", CASE is_f WHEN 1 THEN '1.0' WHEN 0 THEN '0.0' END AS level, count(*) AS n
FROM hh GROUP BY 2
UNION ALL SELECT 'priority', trim(priority), count(*) FROM hh GROUP BY 2"""
)
def canon_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code spelled as 1, 1.0 and padded is one level; text levels are trimmed."""
    spelled = F.when(
        F.col("is_f").isNotNull(),
        F.get(
            F.array(F.col("is_f").cast("string"), F.col("is_f").cast("int").cast("string"),
                    F.concat(F.lit(" "), F.col("is_f").cast("int").cast("string"))),
            (F.col("hh_id") % 3).cast("int"),
        ),
    )
    raw = households(spark, sf_dir).select(
        spelled.alias("flag"), F.concat("priority", F.when(F.col("hh_id") % 2 == 0, " ").otherwise("")).alias("priority")
    )
    levels = raw.select(*[to_level(F.col(c), raw.schema[c].dataType).alias(c) for c in raw.columns])
    return level_counts(levels, levels.columns)


@query(
    f"""WITH {HH} SELECT 1 AS place, 'numeric' AS role, 'acctbal' AS "column", 'used' AS status, count(acctbal) AS n FROM hh
UNION ALL SELECT 2, 'numeric', 'n_lines', 'used', count(n_lines) FROM hh
UNION ALL SELECT 3, 'numeric', 'rainfall', 'missing', NULL
UNION ALL SELECT 4, 'categorical_binary', 'is_f', 'used', count(is_f) FROM hh
UNION ALL SELECT 5, 'categorical_binary', 'revenue', 'excluded', count(revenue) FROM hh
UNION ALL SELECT 6, 'categorical_ordinal', 'priority', 'used', count(priority) FROM hh"""
)
def role_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema columns by role and what became of them, with their non-null counts."""
    roles = RoleSchema(("acctbal", "n_lines", "rainfall"), ("is_f", "revenue"), ("priority",))
    panel = households(spark, sf_dir)
    chosen = select_features(panel.columns, roles, "revenue")

    def status(column: str) -> str:
        return "used" if column in chosen.all else "missing" if column in chosen.missing else "excluded"

    lines = [
        F.struct(
            F.lit(place).alias("place"), F.lit(roles.role_of(c)).alias("role"), F.lit(c).alias("column"),
            F.lit(status(c)).alias("status"),
            (F.lit(None).cast("bigint") if c in chosen.missing else F.count(c)).alias("n"),
        )
        for place, c in enumerate(roles.columns, start=1)
    ]
    return panel.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


INCOMES = ("Wage", "TotalInc", "AgrInc", "CropInc", "CropValue", "n_lines")
LEAKAGE_SQL = f"""WITH {HH}, inc AS (SELECT acctbal AS Wage, acctbal + revenue AS TotalInc, revenue AS AgrInc,
  revenue / 2 AS CropInc, revenue * 2 AS CropValue, n_lines FROM hh),
kept(target, excluding, feature) AS (VALUES
  ('AgrInc', false, 'Wage'), ('AgrInc', false, 'TotalInc'), ('AgrInc', false, 'CropInc'), ('AgrInc', false, 'CropValue'),
  ('AgrInc', false, 'n_lines'), ('AgrInc', true, 'n_lines'),
  ('CropInc', false, 'Wage'), ('CropInc', false, 'TotalInc'), ('CropInc', false, 'AgrInc'), ('CropInc', false, 'CropValue'),
  ('CropInc', false, 'n_lines'), ('CropInc', true, 'n_lines'),
  ('CropValue', false, 'Wage'), ('CropValue', false, 'TotalInc'), ('CropValue', false, 'AgrInc'), ('CropValue', false, 'CropInc'),
  ('CropValue', false, 'n_lines'), ('CropValue', true, 'AgrInc'), ('CropValue', true, 'CropInc'), ('CropValue', true, 'n_lines')),
counts AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM inc" for c in INCOMES)})
SELECT target, excluding, feature, n FROM kept JOIN counts USING (feature)"""


@query(LEAKAGE_SQL)
def leakage_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features left for each target, with and without exclusion of related incomes."""
    revenue, acctbal = F.col("revenue"), F.col("acctbal")
    panel = households(spark, sf_dir).select(
        F.col("hh_id").alias("ma_ho"), acctbal.alias("Wage"), (acctbal + revenue).alias("TotalInc"), revenue.alias("AgrInc"),
        (revenue / 2).alias("CropInc"), (revenue * 2).alias("CropValue"), "n_lines",
    )
    roles = RoleSchema(numeric=("ma_ho", *INCOMES))
    lines = [
        F.struct(F.lit(t).alias("target"), F.lit(flag).alias("excluding"), F.lit(c).alias("feature"), F.count(c).alias("n"))
        for t in ("AgrInc", "CropInc", "CropValue")
        for flag in (False, True)
        for c in select_features(panel.columns, roles, t, exclude_related=flag).all
    ]
    return panel.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


@query(
    f"""WITH {HH}, c AS (SELECT count(DISTINCT region) AS tinh, count(DISTINCT province) AS quan,
  count(DISTINCT segment) AS xa, count(DISTINCT priority) AS priority FROM hh)
SELECT 'none' AS geography, 'priority' AS "column", priority AS levels FROM c
UNION ALL SELECT 'province', 'priority', priority FROM c UNION ALL SELECT 'province', 'tinh', tinh FROM c
UNION ALL SELECT 'district', 'priority', priority FROM c UNION ALL SELECT 'district', 'tinh', tinh FROM c
UNION ALL SELECT 'district', 'quan', quan FROM c
UNION ALL SELECT 'commune', 'priority', priority FROM c UNION ALL SELECT 'commune', 'tinh', tinh FROM c
UNION ALL SELECT 'commune', 'quan', quan FROM c UNION ALL SELECT 'commune', 'xa', xa FROM c"""
)
def geo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category columns and their level counts for each geography setting."""
    panel = households(spark, sf_dir).select(
        F.col("region").alias("tinh"), F.col("province").alias("quan"), F.col("segment").alias("xa"), "priority", "revenue"
    )
    roles = RoleSchema(categorical_ordinal=("priority",))
    counted = (
        level_counts(panel.drop("revenue"), ["tinh", "quan", "xa", "priority"])
        .filter("level IS NOT NULL")
        .groupBy("column")
        .agg(F.count("level").alias("levels"))
    )
    uses = F.create_map(
        *[
            part
            for g in GEOGRAPHY
            for part in (
                F.lit(g),
                F.array(*[F.lit(c) for c in select_features(panel.columns, roles, "revenue", geography=g).categorical]),
            )
        ]
    )
    return (
        counted.select("column", "levels", F.explode(uses).alias("geography", "used"))
        .filter(F.array_contains("used", F.col("column")))
        .select("geography", "column", "levels")
    )


@query(
    f"""WITH {HH}, lv AS (SELECT DISTINCT 'is_f' AS c, CAST(is_f AS VARCHAR) AS level FROM tr WHERE is_f IS NOT NULL
  UNION ALL SELECT DISTINCT 'priority', priority FROM tr WHERE priority IS NOT NULL),
rk AS (SELECT c, level, row_number() OVER (PARTITION BY c ORDER BY level) AS r FROM lv),
names AS (SELECT 0 AS block, 1 AS r, 'acctbal' AS feature UNION ALL SELECT 0, 2, 'n_lines'
  UNION ALL SELECT 1, r, c || '_' || level FROM rk WHERE c = 'is_f' AND r > 1
  UNION ALL SELECT 2, r, c || '_' || level FROM rk WHERE c = 'priority' AND r > 1)
SELECT CAST(row_number() OVER (ORDER BY block, r) - 1 AS INT) AS place, feature FROM names"""
)
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    preparation = fit_preparation(split.train, split.features, PrepSettings(drop_first=True))
    return spark.createDataFrame(list(enumerate(preparation.feature_names())), "place int, feature string")


@query(
    f"""WITH {HH}, u AS (SELECT yr, acctbal, n_lines, NULL AS priority FROM hh WHERE yr <= 1997
  UNION ALL BY NAME SELECT yr, acctbal, priority FROM hh WHERE yr > 1997)
SELECT yr, count(*) AS n, count(acctbal) AS n_acctbal, count(n_lines) AS n_lines, count(priority) AS n_priority FROM u GROUP BY yr"""
)
def union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years with different columns, stacked; what a year lacks is missing there."""
    panel = households(spark, sf_dir)
    early = panel.filter("yr <= 1997").select("yr", "acctbal", "n_lines")
    late = panel.filter("yr > 1997").select("yr", "acctbal", "priority")
    return (
        stack_years([early, late])
        .groupBy("yr")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count("acctbal").alias("n_acctbal"),
            F.count("n_lines").alias("n_lines"), F.count("priority").alias("n_priority"),
        )
    )


@query(
    f"""WITH {HH} SELECT CASE WHEN yr = {TEST_YEAR} THEN 'test' ELSE 'train' END AS part, yr, count(*) AS n,
  sum(hh_id) AS ids FROM hh GROUP BY 1, 2"""
)
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = zip(("train", "test"), split_years(households(spark, sf_dir), TRAIN_YEARS, TEST_YEAR, "yr"))
    labelled = stack_years([rows.withColumn("part", F.lit(name)) for name, rows in parts])
    return labelled.groupBy("part", "yr").agg(F.count(F.lit(1)).alias("n"), F.sum("hh_id").alias("ids"))


def _fold_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("hh_id").alias("ids"))


@query(
    f"""WITH {HH}, r AS (SELECT hh_id, row_number() OVER (ORDER BY {digest_sql('hh_id', 42, 13)}, hh_id) AS place, count(*) OVER () AS n FROM tr)
SELECT CAST(CASE WHEN place <= ceil(n * 0.15) THEN 1 ELSE 0 END AS INT) AS fold, count(*) AS n, sum(hh_id) AS ids FROM r GROUP BY 1"""
)
def val_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split_years(households(spark, sf_dir), TRAIN_YEARS, TEST_YEAR, "yr")
    return _fold_counts(split_exact(train.select("hh_id"), "hh_id", 0.15))


@query(
    f"""WITH {HH}, r AS (SELECT count(*) AS n FROM tr WHERE revenue IS NOT NULL)
SELECT 1::INT AS fold, CAST(ceil(n * 0.15) AS BIGINT) AS n FROM r UNION ALL SELECT 0, CAST(n - ceil(n * 0.15) AS BIGINT) FROM r"""
)
def val_split_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which 8 % have no id, as a job stores them: the exact split still has its size."""
    panel = households(spark, sf_dir).withColumn("hh_id", F.when(F.col("hh_id") % 25 > 1, F.col("hh_id")))
    stored, rows = store_training(prepare_split(panel, ROLES, settings(scale="none")))
    folds = split_exact(rows, "key", 0.15).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()
    stored.drop()
    return spark.createDataFrame(folds, "fold int, n long")


@query(
    f"""WITH {HH} SELECT CAST(CASE WHEN {digest_sql('hh_id', 42, 8)} / {RANGE} < 0.15 THEN 1 ELSE 0 END AS INT) AS fold,
  count(*) AS n, sum(hh_id) AS ids FROM tr GROUP BY 1"""
)
def val_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split_years(households(spark, sf_dir), TRAIN_YEARS, TEST_YEAR, "yr")
    return _fold_counts(split_by_share(train, "hh_id", 0.15))
