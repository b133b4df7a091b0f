"""Long-running forms of the operators."""

from pyspark import cloudpickle

from filewright.streaming import state

from filewright.streaming.jobs import (
    classify_stream,
    latest,
    progress_stream,
    reconcile_stream,
    start,
    worker_stats_stream,
    write_once,
)
from filewright.streaming.keyed import KeyedTable

__all__ = ["KeyedTable", "classify_stream", "latest", "progress_stream", "reconcile_stream", "start", "worker_stats_stream", "write_once"]

# What keeps state in workers travels with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(state)
