"""The three jobs a user runs: sort, undo, offboard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright import sinks
from filewright.config import RetentionPolicy, Taxonomy
from filewright.operators import placement, policy as retention
from filewright.plans import pipeline
from filewright.session import cut_lineage
from filewright.sources import inventory


def stored_plan(judged: DataFrame) -> DataFrame:
    """The plan as a written table, without the files' contents.

    Where the inventory has no ``seq``, rows are sorted by path, by range and
    not in one task, and numbered in that order. The numbers hold for one
    computation only, which is why they are written down. A sort looks at its
    input twice, so the verdicts are written before it: each file is scored once.
    """
    plan = cut_lineage(judged.drop("text", "content"))
    if "seq" in plan.columns:
        return plan
    return cut_lineage(plan.sort("path").withColumn("seq", F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Sorted:
    """A plan, where its files would go, and the summary."""

    plan: DataFrame
    moves: DataFrame
    summary: DataFrame


def sort(
    listing: DataFrame, root: str, taxonomy: Taxonomy, recursive: bool = False,
    stages: Sequence = pipeline.LOCAL, routed: bool = False, **model_options,
) -> Sorted:
    """Classify what is not yet sorted below ``root`` and place it there.

    ``routed`` sends rows no scorer can read through rules alone.
    """
    files = inventory.candidates(listing, root, taxonomy.names, recursive)
    judged = pipeline.routed(files, taxonomy, **model_options) if routed else pipeline.classify(
        files, taxonomy, stages, **model_options)
    plan = stored_plan(judged)
    moves = placement.move_plan(plan, root, placement.existing_names(listing, root))
    return Sorted(plan, moves, pipeline.category_counts(plan))


def apply_moves(moves: DataFrame, log_folder: str, run_id: str, moved_at) -> None:
    """Record a run's moves in the log, for ``undo``."""
    sinks.append_move_log(placement.move_log(moves, run_id, moved_at), log_folder)


def undo(spark: SparkSession, log_folder: str, listing: DataFrame, apply: bool = False, run_id: str = "undo", at=None) -> DataFrame:
    """Plan that takes back every move logged since the last undo, of all runs, latest first.

    With ``apply`` the log is closed, so that another undo finds nothing left to take back.
    """
    log = sinks.read_move_log(spark, log_folder)
    later_first = cut_lineage(log.sort("moved_at", "run_id", "seq").withColumn("seq", F.monotonically_increasing_id()))
    plan = placement.undo_plan(later_first, listing).orderBy(F.desc("seq"))
    if apply:
        plan = cut_lineage(plan).orderBy(F.desc("seq"))
        sinks.close_move_log(spark, log_folder, run_id, F.current_timestamp() if at is None else at)
    return plan


@dataclass(frozen=True)
class Offboarded:
    plan: DataFrame
    counts: DataFrame
    export: DataFrame
    manifest: DataFrame
    review: DataFrame


def offboard(
    listing: DataFrame, root: str, taxonomy: Taxonomy, policy: RetentionPolicy, destination: str,
    existing: DataFrame | None = None, recursive: bool = False, apply: bool = False,
    stages: Sequence = pipeline.LOCAL, **model_options,
) -> Offboarded:
    """Split files by the retention policy; written only with ``apply``: the exported files with their contents, and the manifest.

    A policy that does not cover the taxonomy stops the job before any work.
    """
    policy.must_fit(taxonomy.names)
    files = inventory.candidates(listing, root, taxonomy.names, recursive)
    plan = stored_plan(pipeline.classify(files, taxonomy, stages, **model_options))
    known = None if existing is None else placement.existing_names(existing, destination)
    export = placement.export_plan(plan, policy, destination, known)
    manifest = retention.manifest(plan, policy, apply)
    if apply:
        key = "seq" if "seq" in files.columns else "path"
        contents = files.select(key, *[c for c in ("text", "content") if c in files.columns])
        sinks.write_bundle(export, contents, f"{destination.rstrip('/')}/export", key)
        sinks.write_manifest(manifest, f"{destination.rstrip('/')}/manifest")
    return Offboarded(plan, retention.disposition_counts(plan, policy), export, manifest, retention.review_list(plan, policy))
