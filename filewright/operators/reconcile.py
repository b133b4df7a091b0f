"""Jobs and the results of external workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions.verdicts import unknown, verdict
from filewright.functions.wire import job_id, no_payload
from filewright.operators.skew import running_total


def make_jobs(routed: DataFrame, run_id: str, enqueued_at, payload: Column | None = None) -> DataFrame:
    """One job per row of a scoring route; ``payload`` is a variant."""
    return routed.where(F.col("route") != C.ROUTE_NONE).select(
        job_id(F.lit(run_id), F.col("path")).alias("job_id"), F.col("path").alias("file_path"), "route",
        (no_payload() if payload is None else payload).alias("payload"),
        F.lit(0).alias("attempts"), F.lit(C.MAX_ATTEMPTS).alias("max_attempts"),
        F.lit(enqueued_at).cast("timestamp").alias("enqueued_at"))


def is_ok(error: Column, classification: Column) -> Column:
    return error.isNull() & classification.isNotNull()


def result_verdict(error: Column, classification: Column, route: Column) -> Column:
    """Verdict of one result. An error with a text wins over the classification;
    one without category or confidence is malformed."""
    method = F.concat(F.lit(C.METHOD_QUEUE_PREFIX), route)
    complete = classification["category"].isNotNull() & classification["confidence"].isNotNull()
    return (
        F.when(F.coalesce(error != "", F.lit(False)), unknown(F.concat(F.lit("worker error: "), error), method))
        .when(F.coalesce(complete, F.lit(False)), verdict(
            classification["category"], classification["confidence"],
            F.coalesce(classification["method"], method), F.coalesce(classification["reason"], F.lit(""))))
        .otherwise(unknown(C.REASON_MALFORMED, method))
    )


def first_results(results: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First result per job, with the given columns.

    Order of arrival is time, then the result's own number where it has one. A
    partial aggregate shrinks repeated results of one job to one row per task
    before the shuffle.
    """
    tie = "result_seq" if "result_seq" in results.columns else "worker_id"
    payload = F.struct(*[c for c in columns or results.columns if c != "job_id"])
    first = results.groupBy("job_id").agg(F.min_by(payload, F.struct("done_at", tie)).alias("_first"))
    return first.select("job_id", "_first.*")


def job_verdicts(jobs: DataFrame, results: DataFrame, deadline: Column | None = None) -> DataFrame:
    """Exactly one verdict per job, and its outcome: completed, failed or timeout.

    ``deadline`` may use the job's columns (``enqueued_at`` plus a timeout) or be
    one instant for the whole batch; results at or after it count as missing.
    Results of unknown jobs drop out in the join.
    """
    first = first_results(results, ["done_at", "error", "classification", "route"]).select(
        "job_id", F.col("done_at").alias("_done"), F.col("error").alias("_error"),
        F.col("classification").alias("_class"), F.col("route").alias("_route"), F.lit(True).alias("_here"))
    joined = jobs.join(first, "job_id", "left")
    in_time = F.col("_here").isNotNull()
    if deadline is not None:
        in_time = in_time & (F.col("_done") < deadline)
    timed_out = unknown(C.REASON_TIMEOUT, F.concat(F.lit(C.METHOD_QUEUE_PREFIX), F.col("route")))
    answer = result_verdict(F.col("_error"), F.col("_class"), F.col("_route"))
    outcome = F.when(~F.col("_in_time"), "timeout").when(
        is_ok(F.col("_error"), F.col("_class")), "completed").otherwise("failed")
    return (
        joined.withColumn("_in_time", in_time)
        .withColumn("_verdict", F.when(F.col("_in_time"), answer).otherwise(timed_out))
        .select("job_id", "file_path", "route", "_verdict.*", outcome.alias("outcome"))
    )


def stray_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results of jobs nobody submitted."""
    return results.join(jobs.select("job_id"), "job_id", "left_anti")


def run_stats(verdicts: DataFrame, by_route: bool = False) -> DataFrame:
    """Submitted, completed and failed jobs; a timeout is a failure."""
    grouped = verdicts.groupBy("route") if by_route else verdicts.groupBy()
    done = F.col("outcome") == "completed"
    return grouped.agg(
        F.count("*").alias("submitted"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"))


def worker_stats(results: DataFrame) -> DataFrame:
    """Per worker: processed (no error, whatever the verdict), failed, total time."""
    fine = F.col("error").isNull()
    return results.groupBy("worker_id").agg(
        F.count_if(fine).alias("processed"), F.count_if(~fine).alias("failed"),
        F.sum("duration_ms").alias("total_duration_ms"))


def backlog(jobs: DataFrame, results: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Jobs without a result per route; every route of ``routes`` gets a row."""
    answered = results.select("job_id").distinct()
    open_jobs = jobs.join(answered, "job_id", "left_anti").groupBy("route").agg(F.count("*").alias("outstanding"))
    all_routes = (jobs if routes is None else routes).select("route").distinct()
    return all_routes.join(open_jobs, "route", "left").select("route", F.coalesce("outstanding", F.lit(0)).alias("outstanding"))


def progress(results: DataFrame, order: str = "result_seq") -> DataFrame:
    """Add ``completed_on_route`` and ``failed_on_route`` so far, per result.

    A route may hold most of the rows; the running total is split within it.
    """
    failed = F.when(is_ok(F.col("error"), F.col("classification")), 0).otherwise(1)
    counts = {"completed_on_route": F.lit(1), "failed_on_route": failed}
    return running_total(results, ["route"], ["done_at", order], counts)


def progress_ticks(results: DataFrame, seconds: int = C.PROGRESS_TICK_SECONDS) -> DataFrame:
    """Results per route and tick, and the running total at the end of the tick.

    Rows are summed up to ticks first; the running total sees one row per tick.
    """
    tick = F.window("done_at", f"{seconds} seconds")
    counts = results.groupBy("route", tick.alias("_w")).agg(F.count("*").alias("completed"))
    ends = counts.select("route", F.col("_w.end").alias("tick_end"), "completed")
    return running_total(ends, ["route"], ["tick_end"], {"completed_total": F.col("completed")})
