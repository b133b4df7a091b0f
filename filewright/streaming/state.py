"""Keyed state of streams: groups of jobs, the first result of each so far, and a timer for each group."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filewright.schemas import VERDICT

RECONCILED = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("route", T.StringType()),
    *VERDICT.fields, T.StructField("outcome", T.StringType())])
# What a row brings, as JSON in one column, since each column of a row has its price in a worker: of a job the path and route,
# of a result the rest.
ROW = ["job_id", "is_job", "micros", "file_path", "route", "number", "worker", *VERDICT.names, "outcome"]
JOB = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("enqueued_at", T.LongType()), T.StructField("file_path", T.StringType()),
    T.StructField("route", T.StringType()), T.StructField("done_at", T.LongType()), T.StructField("number", T.LongType()),
    T.StructField("worker", T.StringType()), *VERDICT.fields, T.StructField("outcome", T.StringType())])
HELD = T.StructType([T.StructField("timer", T.LongType()), T.StructField("jobs", T.ArrayType(JOB))])


def milliseconds(micros: int) -> int:
    """Rounded up: the watermark has passed a time when it has passed this."""
    return -(-micros // 1000)


class Reconciler(StatefulProcessor):
    """Gives out each job once: with its first result when the watermark has passed that, or at its deadline.

    A result can only be preceded by one that the watermark still lets in, so the first result held is final when the watermark
    passes it. Results come after their job was queued; one whose job is not there by then is of no job, and goes.

    A key is a group of jobs: each call to the state store has its price, and a group pays it once for all its jobs. Only jobs
    that still wait are held; the timer of a group is that of the first one due.
    """

    def __init__(self, timeout_seconds: int) -> None:
        self.timeout = timeout_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, jobs = self._load()
        for r in rows:
            told = json.loads(r.told)
            job_id, is_job, micros, file_path, route, *answer = map(told.get, ROW)
            enqueued_at, its_path, its_route, done_at, *first = jobs.get(job_id) or [None] * (len(JOB.names) - 1)
            if is_job:
                if enqueued_at is None or micros < enqueued_at:
                    jobs[job_id] = (micros, file_path, route, done_at, *first)
            elif done_at is None or (micros, *answer[:2]) < (done_at, *first[:2]):
                jobs[job_id] = (enqueued_at, its_path, its_route, micros, *answer)
        yield from self._settle(timer, jobs, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, jobs = self._load()
        yield from self._settle(None, jobs, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int | None, dict[str, tuple]]:
        """The timer that is set and the jobs that wait."""
        kept = self.held.get()
        return (None, {}) if kept is None else (kept[0], {job_id: tuple(rest) for job_id, *rest in kept[1]})

    def _settle(self, timer: int | None, jobs: dict[str, tuple], watermark: int) -> Iterator[Row]:
        """Jobs that the watermark has passed; the others wait, with the timer of the first of them. ``timer`` is the one set so far."""
        waiting, due = [], None
        for job_id, job in jobs.items():
            enqueued_at, file_path, route, done_at, _, _, *answer = job
            deadline = None if enqueued_at is None else enqueued_at + self.timeout
            at = milliseconds(min(t for t in (deadline, done_at) if t is not None))
            if at >= watermark:
                waiting.append((job_id, *job))
                due = at if due is None else min(due, at)
            elif deadline is not None:
                here = done_at is not None and done_at < deadline
                yield Row(**dict(zip(RECONCILED.names, (job_id, file_path, route, *(answer if here else [None] * len(answer))))))
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.held.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.held.update((due, waiting))
