"""Score newly arriving survey files with a fitted run.

Fitting is batch work. A fitted run, though, is a projection over typed rows, so scoring files
as they arrive needs no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from panelreg.plans.common import ModelRun, type_rows
from panelreg.sources.roles import RoleSchema


def score_stream(rows: DataFrame, run: ModelRun, roles: RoleSchema) -> DataFrame:
    """The stream's own columns plus the raw-scale prediction of the target."""
    typed = type_rows(rows, roles, run.settings, [step.column for step in run.preparation.categories])
    scored = run.score_rows(typed).select(*rows.columns, "y_pred")
    return scored.withColumnRenamed(
        "y_pred", f"{run.settings.target}_pred"
    )


def write_scores(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows until all files present are done."""
    return (
        scored.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
