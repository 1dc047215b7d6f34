"""Target scales: what the model learns on, and the way back to currency units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCALES = ("none", "log1p", "asinh")

# The range a smearing factor is held to.
SMEARING_RANGE = (0.5, 1.5)


def _known(scale: str) -> str:
    if scale not in SCALES:
        raise ValueError(f"unknown target scale {scale!r}, expected one of {', '.join(SCALES)}")
    return scale


def to_learning_scale(target: Column, scale: str) -> Column:
    """The label. ``log1p`` reads a missing or negative income as zero; the others keep NULL."""
    _known(scale)
    if scale == "log1p":
        return F.log1p(F.greatest(F.coalesce(target, F.lit(0.0)), F.lit(0.0)))
    if scale == "asinh":
        # asinh is odd; taking it of |y| avoids the cancellation Spark's formula has below zero
        return F.signum(target) * F.asinh(F.abs(target))
    return target


def invert(value: Column, scale: str) -> Column:
    """Learning scale back to raw scale, without any correction."""
    _known(scale)
    if scale == "log1p":
        return F.expm1(value)
    if scale == "asinh":
        return F.sinh(value)
    return value


def to_raw_prediction(prediction: Column, scale: str, smearing: float = 1.0) -> Column:
    """Raw-scale prediction. On ``log1p`` the factor multiplies expm1 and the result stays >= 0."""
    raw = invert(prediction, scale)
    if scale == "log1p":
        return F.greatest(F.lit(float(smearing)) * raw, F.lit(0.0))
    return raw


def smearing_factor(label: Column, prediction: Column) -> Column:
    """Duan's factor as an aggregate: the mean exponentiated training residual, unclipped."""
    return F.avg(F.exp(label - prediction))


def hold_smearing(factor: Column) -> Column:
    low, high = SMEARING_RANGE
    return F.least(F.greatest(factor, F.lit(low)), F.lit(high))


def fit_smearing(scored_train: DataFrame, label: str, prediction: str) -> tuple[float, float]:
    """(held factor, unclipped factor) over the scored training rows, one aggregate."""
    row = (
        scored_train.agg(smearing_factor(F.col(label), F.col(prediction)).alias("raw"))
        .select(hold_smearing(F.col("raw")).alias("held"), "raw")
        .first()
    )
    return row["held"], row["raw"]
