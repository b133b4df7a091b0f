"""Jobs and results as JSON text, ids and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright import schemas as S


def job_id(run_id: Column, path: Column) -> Column:
    """Same id each time a run is repeated, so a retry stays idempotent."""
    return F.sha2(F.concat_ws(":", run_id, path), 256)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("bigint"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e3)


def _needed(value: Column, name: str) -> Column:
    """The value itself; the job fails where it is missing."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(f"required field is missing: {name}"))


def whole_number(value: Column) -> Column:
    """Confidence from its JSON text: numbers lose their fraction, true and false are 1 and 0, texts must be whole
    numbers; anything else, and what no integer can hold, is NULL."""
    text = F.trim(F.regexp_replace(value, '^"|"$', ""))
    number = F.when(~F.startswith(value, F.lit('"')), text.try_cast("double"))
    whole = F.when(F.rlike(text, F.lit(r"\A[+-]?[0-9]+\z")), text.try_cast("double"))
    flag = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return F.coalesce(F.when(~F.startswith(value, F.lit('"')), flag), number, whole).try_cast("int")


def no_payload() -> Column:
    """An empty object. Payloads are of any shape, so they are variants: numbers, texts, lists and NULLs stay what they are."""
    return F.parse_json(F.lit("{}"))


def encode_job(df: DataFrame) -> Column:
    return F.to_json(F.struct(
        df["job_id"].alias("id"), "file_path", "route", "payload", "attempts", "max_attempts",
        epoch_seconds(df["enqueued_at"]).alias("enqueued_at"),
    ), {"ignoreNullFields": "false"})


def encode_result(df: DataFrame) -> Column:
    return F.to_json(F.struct(
        "job_id", "file_path", "route", "worker_id", "duration_ms", "classification", "error",
    ), {"ignoreNullFields": "false"})


def decode_jobs(df: DataFrame, column: str = "job", now: Column | None = None) -> DataFrame:
    """Jobs of a JSON column; missing optional fields get their defaults."""
    now = F.current_timestamp() if now is None else now
    j = F.from_json(F.col(column), S.JOB_JSON)
    out = df.withColumn("_j", j)
    return out.select(
        _needed(F.col("_j.id"), "id").alias("job_id"),
        _needed(F.col("_j.file_path"), "file_path").alias("file_path"),
        _needed(F.col("_j.route"), "route").alias("route"),
        F.when(F.coalesce(F.schema_of_variant("_j.payload") != "VOID", F.lit(False)), F.col("_j.payload")).otherwise(no_payload()).alias("payload"),
        F.coalesce("_j.attempts", F.lit(0)).alias("attempts"),
        F.coalesce("_j.max_attempts", F.lit(C.MAX_ATTEMPTS)).alias("max_attempts"),
        F.coalesce(from_epoch(F.col("_j.enqueued_at")), now).alias("enqueued_at"),
    )


def decode_results(df: DataFrame, column: str = "result", done_at: Column | None = None) -> DataFrame:
    """Results of a JSON column.

    A classification without category or with a confidence that is no number
    keeps NULL in that field; reconciliation reports it as malformed.
    """
    done_at = F.current_timestamp() if done_at is None else done_at
    out = df.withColumn("_r", F.from_json(F.col(column), S.RESULT_JSON)).withColumn("_done", done_at)
    c = F.col("_r.classification")
    return out.select(
        _needed(F.col("_r.job_id"), "job_id").alias("job_id"),
        _needed(F.col("_r.file_path"), "file_path").alias("file_path"),
        _needed(F.col("_r.route"), "route").alias("route"),
        _needed(F.col("_r.worker_id"), "worker_id").alias("worker_id"),
        _needed(F.col("_r.duration_ms"), "duration_ms").alias("duration_ms"),
        F.when(c.isNotNull(), F.struct(
            c["category"].alias("category"),
            whole_number(F.to_json(c["confidence"])).alias("confidence"),
            c["method"].alias("method"),
            c["reason"].alias("reason"),
        )).alias("classification"),
        F.col("_r.error").alias("error"),
        F.col("_done").alias("done_at"),
    )
