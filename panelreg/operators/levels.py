"""Category levels of a table: counts, modes and rare levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

OTHER_LEVEL = "Other"


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, n) for every category column in one pass; a NULL level counts the gaps.

    Rows are counted before the shuffle, so a level that holds a third of them costs one row
    per task.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class LevelSummary:
    """The mode of a category, its levels with gaps counted for the mode, and how many were too rare."""

    mode: str
    counts: dict[str, int]
    rare: int


def summarize_levels(df: DataFrame, columns: Sequence[str], min_count: int = 0) -> dict[str, LevelSummary]:
    """Levels of at least ``min_count`` rows per category; columns without any value are left out.

    Modes and rare levels are settled in Spark, so what reaches the driver are the levels a model
    has a coefficient for, however many others there are.
    """
    if not columns:
        return {}
    counts = level_counts(df, columns).persist()
    try:
        present = counts.where(F.col("level").isNotNull())
        top = present.groupBy("column").agg(F.max("n").alias("n"))
        tied = present.join(F.broadcast(top), ["column", "n"])
        number = F.expr("try_cast(level AS DOUBLE)")
        # numeric order if every tied level is a number, else text order
        least = F.when(F.count(number) == F.count("level"), F.min(F.struct(number, "level"))["level"]).otherwise(F.min("level"))
        modes = tied.groupBy("column").agg(least.alias("mode"))
        gaps = counts.groupBy("column").agg(F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("gaps"))
        shared = modes.join(gaps, "column")
        full = present.join(F.broadcast(shared), "column").withColumn(
            "n", F.col("n") + F.when(F.col("level") == F.col("mode"), F.col("gaps")).otherwise(0)
        )
        kept = full.where(F.col("n") >= min_count).select("column", "level", "n").collect()
        sizes = full.groupBy("column", "mode").agg(F.count("level").alias("levels")).collect()
    finally:
        counts.unpersist()
    found: dict[str, dict[str, int]] = {row["column"]: {} for row in sizes}
    for row in kept:
        found[row["column"]][row["level"]] = row["n"]
    return {
        r["column"]: LevelSummary(r["mode"], found[r["column"]], r["levels"] - len(found[r["column"]])) for r in sizes
    }


def sort_levels(levels: Sequence[str], as_text: bool = False) -> list[str]:
    """Numeric order if every level is a number, else text order."""
    if not as_text:
        try:
            return sorted(levels, key=float)
        except ValueError:
            pass
    return sorted(levels)

