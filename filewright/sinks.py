"""Writers. Nothing is written unless the caller applies the plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.placement import EXPORTED
from filewright.schemas import MOVE_LOG


def write_by_category(plan: DataFrame, folder: str, mode: str = "error") -> None:
    """Parquet partitioned by category.

    Rebalanced on the category: each category gets files of even size, with
    large ones split over several tasks and small ones kept in one file.
    """
    plan.hint("rebalance", F.col("category")).write.partitionBy("category").mode(mode).parquet(folder)


def write_manifest(manifest: DataFrame, folder: str, mode: str = "error") -> None:
    """CSV parts with a header, in manifest order from part to part. Blanks at the ends of values stay."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    manifest.write.options(**options).mode(mode).csv(folder)


def write_bundle(export: DataFrame, contents: DataFrame, folder: str, key: str = "path") -> None:
    """The exported files with their contents, by category, as ``folder``.

    ``contents`` holds what the plan left behind, to be joined back by ``key``. All is written aside and published by one
    rename; what fails before leaves nothing behind, and an existing bundle is not touched.
    """
    spark = export.sparkSession
    folder = folder.rstrip("/")
    parent, _, name = folder.rpartition("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    aside, place = path(f"{parent}/.{name}-{uuid.uuid4().hex}"), path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        raise FileExistsError(f"there is a bundle already: {folder}")
    carried = [c for c in contents.columns if c == key or c not in export.columns]
    rows = export.where(F.col("status") == EXPORTED).join(contents.select(*carried), key)
    try:
        rows.hint("rebalance", F.col("category")).write.partitionBy("category").parquet(aside.toString())
        if not files.rename(aside, place):
            raise FileExistsError(f"the bundle could not be published: {folder}")
    finally:
        files.delete(aside, True)


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """All lines ever written. One that cannot be read fails the job that reads it: to take back only some of the moves is
    worse than none."""
    lines = spark.read.schema(MOVE_LOG).option("mode", "FAILFAST").json(folder)
    return lines.withColumns({"generation": F.coalesce("generation", F.lit(0)), "closes": F.coalesce("closes", F.lit(False))})


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _open_generation(spark: SparkSession, folder: str) -> int:
    """One more than the last generation that an undo has closed."""
    if not _exists(spark, folder):
        return 0
    last = _log(spark, folder).where("closes").agg(F.max("generation")).first()[0]
    return 0 if last is None else last + 1


def append_move_log(log: DataFrame, folder: str) -> None:
    """Append a run's moves to the open generation; an empty run leaves no trace."""
    if not log.isEmpty():
        generation = _open_generation(log.sparkSession, folder)
        log.withColumns({"generation": F.lit(generation).cast("long"), "closes": F.lit(False)}).write.mode("append").json(folder)


def close_move_log(spark: SparkSession, folder: str, run_id: str, closed_at) -> None:
    """Append the line that closes all moves so far, which have been taken back; nothing where none is open."""
    if _exists(spark, folder) and not read_move_log(spark, folder).isEmpty():
        line = spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(closed_at).cast("timestamp").alias("moved_at"),
            F.lit(_open_generation(spark, folder)).cast("long").alias("generation"), F.lit(True).alias("closes"))
        line.write.mode("append").json(folder)


def read_move_log(spark: SparkSession, folder: str) -> DataFrame:
    """The moves of all runs since the last undo."""
    generation = _open_generation(spark, folder)
    return _log(spark, folder).where((F.col("generation") >= generation) & ~F.col("closes")).drop("generation", "closes")
