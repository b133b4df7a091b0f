"""Routes, models per route and capacity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright import constants as C
from filewright import profile


@dataclass(frozen=True)
class RouteRule:
    """Rows for which ``predicate`` holds go to ``route``; the first rule wins."""

    route: str
    predicate: Column
    note: str = ""


def default_routes(images: bool = False) -> list[RouteRule]:
    """Readable files by size; images only where something reads images."""
    ext, size = F.col("ext"), F.coalesce(F.col("size_bytes"), F.lit(0))
    readable = ext.isin(C.READABLE_EXTS)
    rules = [
        RouteRule(C.ROUTE_LARGE, readable & (size >= C.LARGE_FILE_BYTES), "large readable files"),
        RouteRule(C.ROUTE_SMALL, readable & (size < C.LARGE_FILE_BYTES), "small readable files"),
    ]
    if images:
        rules.insert(0, RouteRule(C.ROUTE_IMAGE, ext.isin(C.IMAGE_EXTS), "images, read by text recognition"))
    return rules


def route_column(rules: Sequence[RouteRule], default: str = C.ROUTE_NONE) -> Column:
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(rule.predicate, rule.route).otherwise(out)
    return out


def with_route(df: DataFrame, rules: Sequence[RouteRule] | None = None, default: str = C.ROUTE_NONE) -> DataFrame:
    return df.withColumn("route", route_column(default_routes() if rules is None else rules, default))


def describe(spark: SparkSession, rules: Sequence[RouteRule] | None = None, default: str = C.ROUTE_NONE) -> DataFrame:
    rules = default_routes() if rules is None else rules
    rows = [(i, r.route, r.note) for i, r in enumerate(rules)]
    rows.append((len(rows), default, "decided by file-name rules alone"))
    return spark.createDataFrame(rows, "position int, route string, note string")


def model_for_route(route: Column, settings: dict, override: str | None = None) -> Column:
    """Override, else the route's model, else the large model on its route, else the default."""
    if override:
        return F.lit(override)
    default = settings["default_local_model"]
    out = F.lit(default)
    chosen = {C.ROUTE_LARGE: settings.get("large_model", default)}
    chosen.update({r: m for r, m in (settings.get("models") or {}).items() if m})
    for name, model in chosen.items():
        out = F.when(route == name, model).otherwise(out)
    return out


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("files"))


def capacity_table(spark: SparkSession, capacity: Sequence[tuple[str, int, int]] = tuple(profile.CAPACITY)) -> DataFrame:
    return spark.createDataFrame(list(capacity), "route string, files_per_worker long, max_workers long")


def worker_counts(counts: DataFrame, capacity: DataFrame) -> DataFrame:
    """Workers per capacity route: one when idle, else enough within the limit."""
    files = F.coalesce("files", F.lit(0))
    wanted = F.greatest(F.lit(1), F.ceil(files / F.col("files_per_worker")))
    workers = F.when(files <= 0, F.lit(1)).otherwise(F.least("max_workers", wanted))
    return capacity.join(counts, "route", "left").select("route", files.alias("files"), workers.cast("bigint").alias("workers"))


def wall_time(workers: DataFrame, rates: DataFrame) -> DataFrame:
    """Seconds until the slowest route is done; ``rates`` holds files per second of one worker."""
    seconds = F.col("files") / (F.col("workers") * F.col("files_per_second"))
    return workers.join(rates, "route").agg(F.max(seconds).alias("seconds"))
