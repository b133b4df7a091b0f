"""Retention: dispositions, exportable rows, manifest and review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import RetentionPolicy
from filewright.functions import paths
from filewright.functions.literals import map_of


def disposition(category: Column, policy: RetentionPolicy) -> Column:
    """Disposition of a category; a category without one fails the job.

    The failure sits in the value itself, so no plan that uses the disposition
    can lose it.
    """
    found = F.try_element_at(map_of(policy.by_category.items()), category)
    lost = F.concat(F.lit("category '"), F.coalesce(category, F.lit("None")),
                    F.lit("' has no disposition in the retention policy"))
    return F.when(found.isNull(), F.raise_error(lost)).otherwise(found)


def is_barred(category: Column, policy: RetentionPolicy) -> Column:
    return category.isin(sorted(policy.barred)) if policy.barred else F.lit(False)


def with_disposition(plan: DataFrame, policy: RetentionPolicy) -> DataFrame:
    """Add ``disposition``, ``never_export`` and ``exportable``."""
    out = plan.withColumn("disposition", disposition(F.col("category"), policy))
    return out.withColumn("never_export", is_barred(F.col("category"), policy)).withColumn(
        "exportable", (F.col("disposition") == C.KEEP) & ~F.col("never_export"))


def disposition_counts(plan: DataFrame, policy: RetentionPolicy) -> DataFrame:
    """Files per disposition and category, with the mark of barred categories."""
    return (
        with_disposition(plan, policy).groupBy("disposition", "category")
        .agg(F.count("*").alias("files"), F.max("never_export").alias("never_export"))
        .orderBy("disposition", F.desc("files"), "category")
    )


def manifest(plan: DataFrame, policy: RetentionPolicy, applied: bool) -> DataFrame:
    """Audit trail over all rows in the order disposition, category, file name."""
    rows = with_disposition(plan, policy)
    exported = F.when(F.col("exportable") & F.lit(applied), "yes").otherwise("no")
    return rows.select(
        "disposition", exported.alias("exported"), "category", "confidence", "method",
        paths.basename(F.col("path")).alias("filename"), F.col("path").alias("source_path"), "reason",
    ).orderBy("disposition", "category", "filename", "source_path")


def review_list(plan: DataFrame, policy: RetentionPolicy) -> DataFrame:
    """Rows that wait for a decision: secrets first, then by path."""
    rows = with_disposition(plan, policy).where(F.col("disposition") == C.REVIEW)
    return rows.select(
        "never_export", "path", paths.basename(F.col("path")).alias("filename"), "category",
    ).orderBy(F.desc("never_export"), "path")
