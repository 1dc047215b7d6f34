from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from panelreg.functions.hashing import hash_rank, hash_uniform, poisson_array, uniform_array
from panelreg.functions.target import fit_smearing, invert, to_learning_scale, to_raw_prediction
from panelreg.functions.typing import to_level, to_number


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def column(frame, expression):
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_numbers_that_do_not_parse_are_missing(spark):
    frame = texts(spark, "1", " 1e3 ", "abc", "nan", "", None, "1d", "0x1p3", "-inf", ".5", "5.", "1,000")
    got = column(frame, to_number(F.col("v"), StringType()))
    assert got == [1.0, 1000.0, None, None, None, None, None, None, -math.inf, 0.5, 5.0, None]


def test_nan_in_a_number_column_is_missing(spark):
    frame = spark.createDataFrame([(0, float("nan")), (1, 2.0)], "i int, v double")
    assert column(frame, to_number(F.col("v"), DoubleType())) == [None, 2.0]


def test_one_code_is_one_level_whatever_its_spelling(spark):
    frame = texts(spark, "1", "1.0", " 1", "No Diploma", " No Diploma ", "nan", "0.5", None)
    got = column(frame, to_level(F.col("v"), StringType()))
    assert got == ["1.0", "1.0", "1.0", "No Diploma", "No Diploma", None, "0.5", None]
    numbers = spark.createDataFrame([(0, 1), (1, None)], "i int, v int")
    assert column(numbers, to_level(F.col("v"), IntegerType())) == ["1.0", None]


def test_target_scales(spark):
    frame = spark.createDataFrame([(0, None), (1, -5.0), (2, 0.0), (3, math.e - 1)], "i int, v double")
    assert column(frame, to_learning_scale(F.col("v"), "log1p")) == pytest.approx([0, 0, 0, 1])
    assert column(frame, to_learning_scale(F.col("v"), "none"))[0] is None
    signed = spark.createDataFrame([(0, None), (1, -3.0), (2, -1e7), (3, 1e7)], "i int, v double")
    got = column(signed, to_learning_scale(F.col("v"), "asinh"))
    assert got[0] is None and got[1:] == pytest.approx(np.arcsinh([-3.0, -1e7, 1e7]).tolist())
    back = column(signed, invert(to_learning_scale(F.col("v"), "asinh"), "asinh"))
    assert back[1:] == pytest.approx([-3.0, -1e7, 1e7])


def test_raw_prediction_is_clamped_only_on_log1p(spark):
    frame = spark.createDataFrame([(0, -1.0)], "i int, v double")
    assert column(frame, to_raw_prediction(F.col("v"), "log1p", 1.2)) == [0.0]
    assert column(frame, to_raw_prediction(F.col("v"), "asinh")) == pytest.approx([math.sinh(-1)])
    assert column(frame, to_raw_prediction(F.col("v"), "none")) == [-1.0]


def test_unknown_scale_is_an_error():
    with pytest.raises(ValueError, match="target scale"):
        to_learning_scale(F.lit(1.0), "sqrt")


def test_smearing_is_held_in_range(spark):
    frame = spark.createDataFrame([(2.0, 0.0), (2.0, 0.0)], "y double, p double")
    held, raw = fit_smearing(frame, "y", "p")
    assert held == 1.5 and raw == pytest.approx(math.exp(2))


def test_row_hashes_are_even_and_repeatable(spark):
    frame = spark.range(20000).withColumnRenamed("id", "k")
    row = frame.agg(
        F.avg(hash_uniform(F.col("k"), 42)), F.avg(hash_rank(F.col("k"), 42) / 2.0**52), F.countDistinct(hash_rank(F.col("k"), 1))
    ).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(0.5, abs=0.01) and row[2] == 20000
    keys = np.arange(200000, dtype=np.int64)
    assert uniform_array(keys, 7).mean() == pytest.approx(0.5, abs=0.005)
    weights = poisson_array(keys, 7)
    assert weights.mean() == pytest.approx(1, abs=0.02) and (weights == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    high = keys << 33
    assert abs(np.corrcoef(uniform_array(high, 3), uniform_array(high, 4))[0, 1]) < 0.02


def test_known_uniform_of_the_digest(spark):
    got = spark.createDataFrame([(7,)], "k long").select(hash_uniform(F.col("k"), 42)).first()[0]
    assert got == pytest.approx(0.676139617105946, abs=1e-12)
