"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "panelreg", **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; a cluster's own settings stay as they are."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which the session names; all executors have to see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/panelreg-{label}-{uuid.uuid4().hex}"


class StoredTable:
    """A DataFrame written out, so that its lineage is one file scan; ``drop`` removes the files.

    The scan is also persisted for the many passes of an iterative fit; partitions of a lost
    executor are read again from the files.
    """

    def __init__(self, frame: DataFrame, label: str):
        self.spark = frame.sparkSession
        self.path = new_path(self.spark, label)
        frame.write.parquet(self.path)
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path).persist()

    def drop(self) -> None:
        self.frame.unpersist()
        files, jvm_path = hadoop_path(self.spark, self.path)
        files.delete(jvm_path, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop client, for existence checks and clean-up."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, jvm_path = hadoop_path(spark, path)
    return files.exists(jvm_path)

