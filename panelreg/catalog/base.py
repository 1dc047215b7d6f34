"""The household table of the registered queries, and the SQL text they share.

Orders play the households: one row per order, the order year as survey year, revenue as the
income to predict. The years up to 2000 train, 2001 tests, so every row takes part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.functions.hashing import MULTIPLIER, RANGE, WORD
from panelreg.operators.preprocess import PrepSettings
from panelreg.plans.common import RunSettings
from panelreg.sources.roles import RoleSchema

TRAIN_YEARS = (1995, 1996, 1997, 1998, 1999, 2000)
TEST_YEAR = 2001

ROLES = RoleSchema(numeric=("acctbal", "n_lines"), categorical_binary=("is_f",), categorical_ordinal=("priority",))
NUMERIC_ROLES = RoleSchema(numeric=("acctbal", "n_lines"))


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir), under its own name unless another is given."""

    def register(run):
        REGISTRY[name or run.__name__] = Query(run, sql)
        return run

    return register


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. Line items are summed before the join; the small tables join by size."""
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        )
    )
    people = (
        read_table(spark, sf_dir, "customer")
        .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    return (
        read_table(spark, sf_dir, "orders")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("hh_id"),
            F.year("o_orderdate").alias("yr"),
            F.when(key % 11 != 0, F.col("c_acctbal")).alias("acctbal"),
            F.when(key % 13 != 0, F.coalesce("lines", F.lit(0)).cast("double")).alias("n_lines"),
            F.when(key % 7 != 0, F.col("o_orderpriority")).alias("priority"),
            F.when(F.col("o_orderstatus") == "F", 1.0).when(key % 17 != 0, 0.0).alias("is_f"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("province"),
            F.col("r_name").alias("region"),
            "revenue",
        )
    )


def settings(**changes) -> RunSettings:
    base = {
        "train_years": TRAIN_YEARS,
        "test_year": TEST_YEAR,
        "target": "revenue",
        "group_columns": ("is_f", "region"),
        "id_column": "hh_id",
        "year_column": "yr",
        "smearing": True,
        "check_years": False,
        "prep": PrepSettings(0.05, 0.95, scale_numeric=True, drop_first=True),
    }
    return RunSettings(**(base | changes))


def is_train() -> Column:
    return F.col("yr").isin(*TRAIN_YEARS)


HH = f"""hh AS (
  SELECT o_orderkey AS hh_id, CAST(year(o_orderdate) AS INT) AS yr,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(coalesce(n_lines, 0) AS DOUBLE) END AS n_lines,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) WHEN o_orderkey % 17 = 0 THEN NULL
         ELSE CAST(0 AS DOUBLE) END AS is_f,
    c_mktsegment AS segment, n_name AS province, r_name AS region, revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue
             FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
), tr AS (SELECT * FROM hh WHERE yr <= 2000), te AS (SELECT * FROM hh WHERE yr = {TEST_YEAR})"""

LABEL = "ln(1 + greatest(coalesce(revenue, 0), 0))"

# acctbal and n_lines of all rows after imputing, winsorizing and scaling with training statistics
PREPARED = f"""med AS (SELECT median(acctbal) AS ma, median(n_lines) AS mn FROM tr
), imp AS (SELECT hh.*, coalesce(acctbal, ma) AS a0, coalesce(n_lines, mn) AS n0, {LABEL} AS label FROM hh, med
), qu AS (SELECT quantile_cont(a0, 0.05) AS alo, quantile_cont(a0, 0.95) AS ahi,
    quantile_cont(n0, 0.05) AS nlo, quantile_cont(n0, 0.95) AS nhi FROM imp WHERE yr <= 2000
), win AS (SELECT imp.*, least(greatest(a0, alo), greatest(ahi, alo + 1e-12)) AS a1,
    least(greatest(n0, nlo), greatest(nhi, nlo + 1e-12)) AS n1 FROM imp, qu
), mo AS (SELECT avg(a1) AS am, stddev_pop(a1) AS ad, avg(n1) AS nm, stddev_pop(n1) AS nd FROM win WHERE yr <= 2000
), x AS (SELECT win.*, (a1 - am) / CASE WHEN ad = 0 THEN 1 ELSE ad END AS x1,
    (n1 - nm) / CASE WHEN nd = 0 THEN 1 ELSE nd END AS x2 FROM win, mo)"""

# least squares of label on x1 and x2 by Cramer's rule, smearing, and the scored test year
FITTED = f"""{PREPARED}, s AS (
  SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, label) AS s1y,
    covar_pop(x2, label) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(label) AS my FROM x WHERE yr <= 2000
), b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM s
), beta AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b
), fit AS (SELECT x.*, b0 + b1 * x1 + b2 * x2 AS yhat FROM x, beta
), sm AS (SELECT avg(exp(label - yhat)) AS raw_factor,
    least(greatest(avg(exp(label - yhat)), 0.5), 1.5) AS factor FROM fit WHERE yr <= 2000
), scored AS (SELECT fit.*, exp(label) - 1 AS y_true, greatest(factor * (exp(yhat) - 1), 0) AS y_pred
    FROM fit, sm WHERE yr = {TEST_YEAR})"""


def metrics_sql(truth: str, prediction: str, suffix: str = "", digits: int = 6) -> str:
    error = f"({truth} - {prediction})"
    return (
        f"round(avg(abs({error})), {digits}) AS MAE{suffix}, round(sqrt(avg({error} * {error})), {digits}) AS RMSE{suffix}, "
        f"round(1 - avg({error} * {error}) / var_pop({truth}), 6) AS R2{suffix}"
    )


def mix_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MULTIPLIER}) & {WORD})"
    return f"xor({x}, ({x}) >> 16)"


def hash_word_sql(key: str, stream: str) -> str:
    return mix_sql(f"xor(({key}) & {WORD}, {mix_sql(f'xor(({key}) >> 32, {stream})')})")


def hash_uniform_sql(key: str, stream: str) -> str:
    return f"(CAST({hash_word_sql(key, stream)} AS DOUBLE) / {RANGE})"


def digest_sql(key: str, seed: int, digits: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat(CAST({key} AS VARCHAR), ':{seed}')), 1, {digits}) AS UBIGINT) AS DOUBLE)"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, leaving the others and the order alone."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
