"""The inventory: one row per candidate file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions import paths
from filewright.sources.files import list_files, read_text  # noqa: F401


def candidates(
    listing: DataFrame, root: str, categories: Iterable[str], recursive: bool = True,
    prefix: str = C.BOOKKEEPING_PREFIX,
) -> DataFrame:
    """Files below ``root`` that are still to be sorted.

    Left out: folders, the engine's own files, and everything whose first path
    part below the root is a category, since that has been sorted before.
    """
    rel = paths.relative(F.col("path"), root)
    df = listing.withColumn("_rel", rel).where(F.col("_rel").isNotNull())
    if "is_dir" in listing.columns:
        df = df.where(~F.col("is_dir"))
    df = df.where(~F.startswith(paths.basename(F.col("path")), F.lit(prefix)))
    df = df.where(~paths.head(F.col("_rel")).isin(list(categories)))
    if not recursive:
        df = df.where(~F.contains("_rel", F.lit("/")))
    return df.drop("_rel")
