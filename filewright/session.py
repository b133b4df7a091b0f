"""Session settings, the shared folder, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of single columns cost more than building the columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A scorer reply may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "filewright", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``.

    Only a session in one process may do without: a temporary folder then serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="filewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/filewright-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    A written table is computed once, where a checkpoint computes its input a
    second time; it also keeps column pruning and a known size.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
