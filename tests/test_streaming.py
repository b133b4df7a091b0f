import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

from checks import fixtures as X
from checks import queries
from filewright import constants as C
from filewright import schemas as S
from filewright.config import Taxonomy
from filewright.operators import reconcile
from filewright.plans import pipeline
from filewright.streaming import (
    classify_stream, latest, progress_stream, reconcile_stream, start, worker_stats_stream, write_once,
)
from tests.conftest import DATA

TAXONOMY = Taxonomy()
NONE = VariantVal.parseJson("{}")


def as_stream(spark, df, folder):
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def run(stream, tmp_path, mode="append", **options):
    out = str(tmp_path / "out")
    start(stream, write_once(out, **options), str(tmp_path / "checkpoint"), mode).awaitTermination()
    return stream.sparkSession.read.parquet(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_classify_equals_batch(spark, tmp_path):
    files = X.files(spark, DATA)
    stream = classify_stream(as_stream(spark, files, str(tmp_path / "in")), TAXONOMY, pipeline.RULES_ONLY)
    got = run(stream, tmp_path).drop("batch_id")
    assert rows(got) == rows(pipeline.classify(files, TAXONOMY, pipeline.RULES_ONLY))


def test_a_table_is_a_stream_as_one_file_and_as_a_folder(spark, tmp_path):
    whole = X.load(spark, DATA, "documents")
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole.limit(1).write.parquet(str(tmp_path / "documents.parquet.old"))
    want = rows(pipeline.classify(X.files(spark, DATA), TAXONOMY, pipeline.RULES_ONLY).select(*queries.PLAN))
    assert rows(queries.stream_classify(spark, str(tmp_path))) == rows(queries.stream_classify(spark, DATA)) == want


def test_reconcile_fills_timeouts_and_drops_repeats(spark, tmp_path):
    jobs, results = X.jobs(spark, DATA), X.results(spark, DATA).drop("result_seq")
    # One late pair moves both watermarks past every real deadline.
    late = dt.datetime(2030, 1, 1)
    end_job = spark.createDataFrame([("end", "/f", "r", NONE, 0, 3, late)], S.JOBS)
    end_result = spark.createDataFrame([("end", "/f", "r", "w", 1.0, ("Medical_Health", 1, "m", "r"), None, late)], S.RESULTS)
    stream = reconcile_stream(
        as_stream(spark, jobs.unionByName(end_job), str(tmp_path / "jobs")),
        as_stream(spark, results.unionByName(end_result), str(tmp_path / "results")), 900)
    got = run(stream, tmp_path).drop("batch_id").where("job_id <> 'end'")
    want = reconcile.job_verdicts(jobs, results, F.col("enqueued_at") + F.expr("INTERVAL 900 SECONDS"))
    want = reconcile.job_verdicts(jobs, results, F.col("enqueued_at") + F.expr("INTERVAL 900 SECONDS"))
    assert rows(got) == rows(want)


def test_reconcile_takes_the_first_of_repeats_in_any_order(spark, tmp_path):
    at = lambda second: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    end = dt.datetime(2100, 1, 1)
    job = lambda name, time: (name, f"/{name}", "r", NONE, 0, 3, time)
    result = lambda name, reason, time, seq: (name, f"/{name}", "r", "w", 1.0, ("Medical_Health", 90, "m", reason), None, time, seq)
    numbered = T.StructType([*S.RESULTS.fields, T.StructField("result_seq", T.LongType())])
    # The later result arrives first in the same batch (a, c by number) or a batch earlier (b); d is too late, e has none.
    batches = [
        [result("a", "second", at(20), 1), result("a", "first", at(10), 2), result("b", "second", at(20), 1), result("stray", "x", at(5), 9)],
        [result("b", "first", at(10), 2), result("c", "second", at(10), 8), result("c", "first", at(10), 7), result("d", "late", at(950), 1)],
        [result("a", "third", at(30), 3)],
        [result("a", "fourth", at(31), 4), result("end", "x", end, 1)]]
    jobs = [[job(name, at(0)) for name in "abcde"], [job("end", end)]]
    for rows_, schema, folder in ((batches, numbered, "results"), (jobs, S.JOBS, "jobs")):
        for batch in rows_:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
    stream = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    found = reconcile_stream(stream("jobs", S.JOBS), stream("results", numbered), 900)
    query = start(found, write_once(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("job_id <> 'end'").select("job_id", "reason", "outcome")
    timeout = lambda name: (name, C.REASON_TIMEOUT, "timeout")
    assert rows(got) == [("a", "first", "completed"), ("b", "first", "completed"), ("c", "first", "completed"), timeout("d"), timeout("e")]
    # The last result of a came when the watermark had passed it; of all jobs and strays nothing is kept but the last pair.
    state = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(s.numRowsDroppedByWatermark for s in state) == 1
    assert max(s.numRowsTotal for s in state) >= 7 and state[-1].numRowsTotal == 1


def test_reconcile_reports_a_job_when_its_result_is_there(spark, tmp_path):
    """Long before its deadline, once the watermark is past the result; an earlier result on the way still counts."""
    at = lambda second: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    result = lambda name, reason, time: (name, f"/{name}", "r", "w", 1.0, ("Medical_Health", 90, "m", reason), None, time)
    batches = [[result("a", "second", at(20))], [result("a", "first", at(15))], [result("x", "clock", at(90))], [result("x", "clock", at(95))]]
    jobs = [[("a", "/a", "r", NONE, 0, 3, at(0)), ("b", "/b", "r", NONE, 0, 3, at(1))], [("c", "/c", "r", NONE, 0, 3, at(100))]]
    for kind, schema, folder in ((batches, S.RESULTS, "results"), (jobs, S.JOBS, "jobs")):
        for batch in kind:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
    stream = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    got = run(reconcile_stream(stream("jobs", S.JOBS), stream("results", S.RESULTS), 900), tmp_path)
    assert [(r.job_id, r.reason) for r in got.collect()] == [("a", "first")]


def test_reconcile_keeps_state_by_groups_of_jobs(spark, tmp_path):
    """Calls to the state store grow with groups, not with jobs; groups of any number give the same verdicts."""
    jobs, results = X.jobs(spark, DATA), X.results(spark, DATA)
    want = reconcile.job_verdicts(jobs, results, F.col("enqueued_at") + F.expr("INTERVAL 900 SECONDS"))
    late = dt.datetime(2030, 1, 1)
    end_job = spark.createDataFrame([("end", "/f", "r", NONE, 0, 3, late)], S.JOBS)
    end_result = spark.createDataFrame([("end", "/f", "r", "w", 1.0, None, None, late, 0)], T.StructType([*S.RESULTS.fields, T.StructField("result_seq", T.LongType())]))
    none = (results.limit(1).withColumns({"job_id": F.lit(None).cast("string")}), results.limit(1).withColumn("done_at", F.lit(None).cast("timestamp")))
    stream = reconcile_stream(
        as_stream(spark, jobs.unionByName(end_job), str(tmp_path / "jobs")),
        as_stream(spark, results.unionByName(end_result).unionByName(none[0]).unionByName(none[1]), str(tmp_path / "results")), 900, groups=3)
    query = start(stream, write_once(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch_id")) == rows(want)
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 3


def test_reconcile_query_streams_repeats_and_strays(spark, monkeypatch):
    fed = {}
    whole = queries._in_time

    def watch(df, *args, **kwargs):
        fed["result_seq" if "result_seq" in df.columns else "job"] = df.count()
        return whole(df, *args, **kwargs)

    monkeypatch.setattr(queries, "_in_time", watch)
    queries.stream_reconcile(spark, DATA)
    assert fed == {"result_seq": X.results(spark, DATA).count(), "job": X.jobs(spark, DATA).count()}


def test_reconcile_query_gives_a_verdict_for_every_job(spark):
    """Also for the last ones, whose deadline no other row of the tables would bring the watermark past."""
    jobs, results = X.jobs(spark, DATA), X.results(spark, DATA)
    want = reconcile.job_verdicts(jobs, results, F.col("enqueued_at") + F.expr("INTERVAL 900 SECONDS"))
    assert rows(queries.stream_reconcile(spark, DATA)) == rows(want)


def test_progress_and_worker_stats_equal_batch(spark, tmp_path):
    results = X.results(spark, DATA)
    stream = as_stream(spark, results, str(tmp_path / "in"))
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    ticks = run(progress_stream(stream), tmp_path / "a", "update").select("route", "tick_end", "completed")
    assert rows(ticks) == rows(reconcile.progress_ticks(results).select("route", "tick_end", "completed"))
    stats = run(worker_stats_stream(stream), tmp_path / "b", "update").select("worker_id", "processed", "failed")
    assert rows(stats) == rows(reconcile.worker_stats(results).select("worker_id", "processed", "failed"))


def test_latest_state_over_several_batches(spark, tmp_path):
    results = X.results(spark, DATA)
    results.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    written = run(worker_stats_stream(stream), tmp_path, "update")
    assert written.select("batch_id").distinct().count() == 3
    got = latest(written, ["worker_id"]).select("worker_id", "processed", "failed")
    assert rows(got) == rows(reconcile.worker_stats(results).select("worker_id", "processed", "failed"))


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    calls = []

    def observe(batch, batch_id):
        calls.append((batch_id, batch.count()))
        raise RuntimeError("observers must not stop the stream")

    failures = []
    write = write_once(str(tmp_path / "out"), observe, failures)
    batch = spark.range(5)
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert calls == [(0, 5), (0, 5), (1, 5)]
    assert failures == [(i, "RuntimeError: observers must not stop the stream") for i in (0, 0, 1)]
