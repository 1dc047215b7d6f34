"""Result tables on disk, replaced only once their successors are complete.

A table is written aside and then takes the place of the old one; a write that fails leaves what was
there. Partitioned tables replace the partitions that the new rows have and leave the others alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from panelreg.session import hadoop_path


def _save(table: DataFrame, path: str, fmt: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = table.write.partitionBy(*partition_by)
    if partition_by:
        # the partitions are staged and moved when all tasks are done
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def replace_table(table: DataFrame, path: str, fmt: str) -> None:
    """Write the table aside and swap it with what lies at the path."""
    spark, mark = table.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    files, place = hadoop_path(spark, path)
    aside, former = (hadoop_path(spark, p)[1] for p in (new, old))
    try:
        _save(table, new, fmt)
        there = files.exists(place)
        if there and not files.rename(place, former):
            raise OSError(f"{path} can't be moved")
        if not files.rename(aside, place):
            if there:
                files.rename(former, place)
            raise OSError(f"{new} can't be moved to {path}")
        if there:
            files.delete(former, True)
    finally:
        if files.exists(aside):
            files.delete(aside, True)


def write_small(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report-sized table as one file with a header, replacing what was there."""
    replace_table(table.coalesce(1), path, fmt)


def write_rows(table: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = ()) -> None:
    """A row-sized table, written in parallel, replacing what was there, or the partitions that it has rows of."""
    if partition_by:
        _save(table, path, fmt, partition_by)
    else:
        replace_table(table, path, fmt)
