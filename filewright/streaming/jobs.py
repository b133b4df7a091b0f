"""Streams of files, jobs and results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filewright import constants as C
from filewright.config import Taxonomy
from filewright.functions.verdicts import unknown
from filewright.operators.reconcile import is_ok, result_verdict
from filewright.plans import pipeline
from filewright.schemas import VERDICT
from filewright.streaming.state import RECONCILED, ROW, Reconciler


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classify_stream(
    files: DataFrame, taxonomy: Taxonomy, stages: Sequence = pipeline.LOCAL, scorer=None, **model_options,
) -> DataFrame:
    """Arriving files with their verdict. Rows are judged one by one: no state."""
    return pipeline.classify(files, taxonomy, stages, scorer=scorer, **model_options)


def reconcile_stream(
    jobs: DataFrame, results: DataFrame, timeout_seconds: int = C.RUN_TIMEOUT_SECONDS,
    jobs_late: str = "1 minute", results_late: str = "1 minute", groups: int = 1024,
) -> DataFrame:
    """One verdict per job, as soon as no earlier result can come, or its own timeout has passed.

    Time is that of the events. The first result by ``done_at`` (then by its own number where it has one) counts, in whatever
    order they arrive; repeats, and results of unknown jobs, drop out. State is kept for each of ``groups`` of jobs, with a timer
    (``Reconciler``): a job's first result so far is given out once the watermark has passed it, and a job without one at its deadline; then
    nothing of it is kept. Rows that come later than the watermark are dropped, so a silent stream holds jobs back. Rows without time
    only drop out. A stream goes on with the number of groups that it began with.
    """
    numbered = "result_seq" in results.columns
    none = lambda kind: F.lit(None).cast(kind)
    asked = jobs.withWatermark("enqueued_at", jobs_late).select(
        "job_id", F.col("enqueued_at").alias("time"), F.unix_micros("enqueued_at").alias("micros"), F.lit(True).alias("is_job"), "file_path", "route", none("long").alias("number"),
        none("string").alias("worker"), *[none(f.dataType).alias(f.name) for f in VERDICT], none("string").alias("outcome"))
    error, classified = F.col("error"), F.col("classification")
    found = result_verdict(error, classified, F.col("route"))
    answered = results.withWatermark("done_at", results_late).select(
        "job_id", F.col("done_at").alias("time"), F.unix_micros("done_at").alias("micros"), F.lit(False).alias("is_job"), none("string").alias("file_path"), none("string").alias("route"),
        F.coalesce(F.col("result_seq") if numbered else F.lit(0), F.lit(0)).cast("long").alias("number"), F.coalesce("worker_id", F.lit("")).alias("worker"),
        *[found[f.name].cast(f.dataType).alias(f.name) for f in VERDICT], F.when(is_ok(error, classified), "completed").otherwise("failed").alias("outcome"))
    told = asked.union(answered).where(F.col("job_id").isNotNull() & F.col("time").isNotNull()).select(
        F.pmod(F.hash("job_id"), F.lit(groups)).alias("group"), "time", F.to_json(F.struct(*ROW)).alias("told")).groupBy("group").transformWithState(
        Reconciler(timeout_seconds), RECONCILED, "append", "EventTime")
    timed_out = unknown(C.REASON_TIMEOUT, F.concat(F.lit(C.METHOD_QUEUE_PREFIX), F.col("route")))
    verdict = F.when(F.col("outcome").isNull(), timed_out).otherwise(F.struct(*VERDICT.names))
    return told.select("job_id", "file_path", "route", verdict.alias("_v"), F.coalesce("outcome", F.lit("timeout")).alias("outcome")).select(
        "job_id", "file_path", "route", "_v.*", "outcome")


def progress_stream(results: DataFrame, seconds: int = C.PROGRESS_TICK_SECONDS, late: str = "1 minute") -> DataFrame:
    """Results and failures per route and tick."""
    fine = is_ok(F.col("error"), F.col("classification"))
    ticks = results.withWatermark("done_at", late).groupBy(F.window("done_at", f"{seconds} seconds").alias("_w"), "route")
    return ticks.agg(F.count("*").alias("completed"), F.count_if(~fine).alias("failed")).select(
        F.col("_w.end").alias("tick_end"), "route", "completed", "failed")


def worker_stats_stream(results: DataFrame) -> DataFrame:
    """Counters per worker since the stream began."""
    fine = F.col("error").isNull()
    return results.groupBy("worker_id").agg(
        F.count_if(fine).alias("processed"), F.count_if(~fine).alias("failed"),
        F.sum("duration_ms").alias("total_duration_ms"))


def write_once(
    folder: str, on_batch: Callable[[DataFrame, int], None] | None = None, failures: list[tuple[int, str]] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch writer for ``foreachBatch`` that may safely run a batch again.

    Each batch overwrites a folder of its own, so a replay after a failure leaves the same rows. ``on_batch`` sees the
    batch afterwards; what it raises does not stop the stream and is added to ``failures`` as (batch, error).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if on_batch is not None:
            try:
                on_batch(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)
            except Exception as exc:
                if failures is not None:
                    failures.append((batch_id, f"{type(exc).__name__}: {exc}"))

    return write


def latest(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key in what ``write_once`` wrote: results of a stream in update mode, which reports a key
    again whenever it changes."""
    others = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_last"))
    return last.select(*keys, "_last.*")


def start(
    stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a stream: ``every`` names the interval, None takes what is there and stops.

    State is kept in RocksDB, so it may outgrow memory; keyed state with timers needs it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = stream.writeStream.foreachBatch(writer).outputMode(mode).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()
