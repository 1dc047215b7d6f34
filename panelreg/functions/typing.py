"""Casting columns to their role: numbers and category levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, NumericType, StringType

# A plain decimal number, or an infinity. Spark's own cast is wider: it also takes Java
# suffixes such as "1d" and hexadecimal floats, which a survey file does not mean as numbers.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def to_number(column: Column, dtype: DataType) -> Column:
    """The column as double; whatever does not parse, and NaN, becomes NULL."""
    if isinstance(dtype, StringType):
        return F.when(column.rlike(NUMBER_PATTERN), column.try_cast("double"))
    return F.nullif(column.try_cast("double"), F.lit(float("nan")))


def to_level(column: Column, dtype: DataType) -> Column:
    """The column as a category level.

    Codes are spelled one way whatever the file type was: ``1``, ``1.0`` and `` 1`` are all
    the level ``1.0``. Text levels are trimmed, NaN is a missing value.
    """
    if isinstance(dtype, NumericType):
        number = to_number(column, dtype)
        return F.when(number.isNotNull(), _spell(number))
    text = F.trim(column.cast("string"))
    number = to_number(text, StringType())
    return F.when(number.isNotNull(), _spell(number)).when(F.lower(text) != "nan", text)


def _spell(number: Column) -> Column:
    whole = (F.abs(number) < 1e15) & (number == F.floor(number))
    return F.when(whole, F.concat(number.try_cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        number.cast("string")
    )
