"""Error metrics as aggregates, overall and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def mae(truth: Column, prediction: Column) -> Column:
    return F.avg(F.abs(truth - prediction))


def rmse(truth: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((truth - prediction) * (truth - prediction)))


def r2(truth: Column, prediction: Column) -> Column:
    """1 - SSE/SST; for a constant target 1 if every prediction is exact, else 0."""
    mean_error = F.avg((truth - prediction) * (truth - prediction))
    spread = F.var_pop(truth)
    return (
        F.when(spread > 0, 1 - mean_error / spread)
        .when(mean_error == 0, 1.0)
        .when(mean_error > 0, 0.0)
    )


def metric_columns(truth: str, prediction: str, suffix: str = "") -> list[Column]:
    y, p = F.col(truth), F.col(prediction)
    return [mae(y, p).alias(f"MAE{suffix}"), rmse(y, p).alias(f"RMSE{suffix}"), r2(y, p).alias(f"R2{suffix}")]


def group_mae(scored: DataFrame, group: str, truth: str, prediction: str) -> DataFrame:
    """Mean absolute error per group, without the NULL group.

    Rows without a truth still name their group: a group that has only such rows is listed with
    a NULL error. Drop those rows first to list observed groups only.
    """
    return (
        scored.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(mae(F.col(truth), F.col(prediction)).alias("MAE_group"))
        .orderBy(group)
    )


def group_mae_lines(scored: DataFrame, groups: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """(grouping, level, MAE_group) of several group columns from one pass over the rows, as ``group_mae`` has them."""
    if not groups:
        return scored.select(F.lit("").alias("grouping"), F.lit("").alias("level"), F.lit(0.0).alias("MAE_group")).limit(0)
    rows = scored.select(*(F.col(g).cast("string").alias(f"_level_{i}") for i, g in enumerate(groups)), F.abs(F.col(truth) - F.col(prediction)).alias("_error"))
    levels = [f"_level_{i}" for i in range(len(groups))]
    summed = rows.groupingSets([[level] for level in levels], *levels).agg(
        F.avg("_error").alias("MAE_group"), F.array(*(F.grouping(level) == 0 for level in levels)).alias("_kept")
    )
    place = F.array_position("_kept", True).cast("int")
    named = summed.select(
        F.element_at(F.array(*map(F.lit, groups)), place).alias("grouping"), F.element_at(F.array(*levels), place).alias("level"), "MAE_group"
    )
    return named.where(F.col("level").isNotNull())
