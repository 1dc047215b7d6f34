"""Year tables: finding, reading, stacking and splitting them."""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelreg.session import path_exists
from panelreg.sources.roles import YEAR_COLUMN

# File names of a year in order of preference, and the spellings that mean
# "missing" in a CSV cell.
YEAR_FILES = ("{year}_clean.csv", "{year}.csv", "{year}.dta")
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

STATA_CHUNK_ROWS = 50_000


def find_year(spark: SparkSession, folder: str, year: int) -> str:
    """Path of the year's table: the first of the known file names that exists."""
    names = [name.format(year=year) for name in YEAR_FILES]
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no table for year {year} in {folder}, looked for {', '.join(names)}")


def load_year(spark: SparkSession, folder: str, year: int, *, multi_line: bool = False) -> DataFrame:
    """One survey year with its year column; all other columns are still text."""
    path = find_year(spark, folder, year)
    table = read_stata(spark, path) if path.endswith(".dta") else read_csv(spark, path, multi_line)
    return table.withColumn(YEAR_COLUMN, F.lit(year).cast("int"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text, missing tokens as NULL.

    Nothing is inferred: two years may infer differently, and roles decide the types anyway.
    ``multi_line`` allows line breaks inside quoted cells, at the price of unsplittable files.
    """
    table = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line)
    return table.select(
        *[F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in table.columns]
    )


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """Stata file, or folder of part files, as text columns with value labels applied.

    The format has no splits, so a file is one task; a large year is stored as several parts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dta").load(path)
    return parse_stata(files.select("content"))


def parse_stata(files: DataFrame) -> DataFrame:
    """Rows of the Stata files in the ``content`` column; the columns are the union over files."""
    names = [
        row["name"]
        for row in files.mapInPandas(_stata_columns, "name string, place int")
        .groupBy("name")
        .agg(F.min("place").alias("place"))
        .orderBy("place", "name")
        .collect()
    ]
    schema = StructType([StructField(name, StringType()) for name in names])
    return files.mapInPandas(_stata_rows(names), schema)


def _stata_chunks(content: bytes, rows: int) -> Iterator[pd.DataFrame]:
    with warnings.catch_warnings():
        # partly labelled columns differ in type between chunks; all of them become text anyway
        warnings.simplefilter("ignore", pd.errors.CategoricalConversionWarning)
        with pd.read_stata(io.BytesIO(content), chunksize=rows) as reader:
            for chunk in reader:  # not `yield from`: that would close the reader a second time
                yield chunk


def _stata_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            names = next(_stata_chunks(content, 1), pd.DataFrame()).columns
            yield pd.DataFrame({"name": names, "place": range(len(names))})


def _stata_rows(names: list[str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for chunk in _stata_chunks(content, STATA_CHUNK_ROWS):
                    absent = pd.Series(pd.NA, index=chunk.index, dtype="string")
                    yield pd.DataFrame({c: chunk[c].astype("string") if c in chunk else absent for c in names})

    return rows


def stack_years(tables: Iterable[DataFrame]) -> DataFrame:
    """All years below each other; a column a year lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def load_years(spark: SparkSession, folder: str, years: Iterable[int]) -> DataFrame:
    """Only the years a run uses are read."""
    return stack_years([load_year(spark, folder, year) for year in dict.fromkeys(years)])


def split_years(
    panel: DataFrame, train_years: Iterable[int], test_year: int, year_column: str = YEAR_COLUMN
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a stacked panel. The year predicate reaches partitions or row groups."""
    year = F.col(year_column)
    return panel.filter(year.isin(*train_years)), panel.filter(year == test_year)


def require_years(panel: DataFrame, years: Iterable[int], year_column: str = YEAR_COLUMN) -> None:
    """Fail on a year without rows, instead of quietly training on another one."""
    wanted = set(years)
    found = {r[0] for r in panel.filter(F.col(year_column).isin(*wanted)).select(year_column).distinct().collect()}
    if wanted - found:
        raise ValueError(f"no rows for year(s) {sorted(wanted - found)}")
