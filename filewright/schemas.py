"""Declared schemas of the tables the operators exchange."""

from pyspark.sql import types as T

VERDICT = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("reason", T.StringType()),
])

FILES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("text", T.StringType()),
])

# What a job or a result looks like on the wire; times are epoch seconds.
JOB_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("enqueued_at", T.DoubleType()),
])

RESULT_JSON = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("classification", T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.VariantType()),
        T.StructField("method", T.StringType()),
        T.StructField("reason", T.StringType()),
    ])),
    T.StructField("error", T.StringType()),
])

JOBS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("enqueued_at", T.TimestampType()),
])

RESULTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("classification", VERDICT),
    T.StructField("error", T.StringType()),
    T.StructField("done_at", T.TimestampType()),
])

MOVE_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("original", T.StringType()),
    T.StructField("new", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("moved_at", T.TimestampType()),
    # An undo closes a generation with one line; moves after it are of the next.
    T.StructField("generation", T.LongType()),
    T.StructField("closes", T.BooleanType()),
])
