import json
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from filewright import schemas as S
from filewright.functions import wire
from filewright.operators import reconcile

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def jobs(spark, ids):
    return spark.createDataFrame([(i, f"/f/{i}", "ai-small", VariantVal.parseJson("{}"), 0, 3, T0) for i in ids], S.JOBS)


def results(spark, rows):
    """rows: (job_id, classification, error, seconds)"""
    return spark.createDataFrame(
        [(j, f"/f/{j}", "ai-small", "w1", 5.0, c, e, at(s)) for j, c, e, s in rows], S.RESULTS)


GOOD = ("Medical_Health", 90, "Local AI", "why")


def verdicts(spark, ids, rows, **options):
    return {r.job_id: r for r in reconcile.job_verdicts(jobs(spark, ids), results(spark, rows), **options).collect()}


def test_each_job_gets_exactly_one_verdict(spark):
    got = verdicts(spark, ["ok", "err", "none", "bad", "late", "dup", "blank"], [
        ("ok", GOOD, None, 1), ("err", None, "RuntimeError: boom", 1), ("bad", (None, None, None, None), None, 1),
        ("late", GOOD, None, 900), ("dup", GOOD, None, 1), ("dup", ("Travel_Transit", 10, "m", "r"), None, 2),
        ("stray", GOOD, None, 1), ("blank", GOOD, "", 1),
    ], deadline=F.col("enqueued_at") + F.expr("INTERVAL 900 SECONDS"))
    assert len(got) == 7
    assert (got["ok"].category, got["ok"].outcome) == ("Medical_Health", "completed")
    assert (got["err"].reason, got["err"].outcome) == ("worker error: RuntimeError: boom", "failed")
    assert (got["none"].reason, got["none"].method) == ("orchestrator timeout waiting for worker", "Queue:ai-small")
    assert (got["bad"].reason, got["bad"].outcome) == ("worker returned malformed classification", "completed")
    assert got["late"].outcome == "timeout"
    assert got["dup"].category == "Medical_Health"
    # An empty error is a failure that keeps its verdict.
    assert (got["blank"].category, got["blank"].outcome) == ("Medical_Health", "failed")


def test_missing_classification_is_malformed_and_failed(spark):
    got = verdicts(spark, ["x"], [("x", None, None, 1)])["x"]
    assert (got.reason, got.outcome) == ("worker returned malformed classification", "failed")


def test_method_and_reason_defaults(spark):
    got = verdicts(spark, ["x"], [("x", ("Medical_Health", 5, None, None), None, 1)])["x"]
    assert (got.method, got.reason) == ("Queue:ai-small", "")


def test_stats_and_backlog(spark):
    v = reconcile.job_verdicts(jobs(spark, "abc"), results(spark, [("a", GOOD, None, 1), ("b", None, "e", 1)]))
    assert tuple(reconcile.run_stats(v).first()) == (3, 1, 2)
    r = results(spark, [("a", GOOD, None, 1), ("b", None, None, 1), ("c", None, "e", 1)])
    assert tuple(reconcile.worker_stats(r).first()) == ("w1", 2, 1, 15.0)
    routes = spark.createDataFrame([("ai-small",), ("ai-large",)], "route string")
    b = reconcile.backlog(jobs(spark, "abcd"), r, routes)
    assert {x.route: x.outstanding for x in b.collect()} == {"ai-small": 1, "ai-large": 0}


def test_progress_counts_on_one_hot_route(spark):
    rows = [(str(i), GOOD if i % 3 else None, None, (i * 13) % 50) for i in range(400)]
    df = results(spark, rows).withColumn("result_seq", F.col("job_id").cast("bigint") * 70000)
    got = {int(r.job_id): (r.completed_on_route, r.failed_on_route) for r in reconcile.progress(df).collect()}
    order = sorted(range(400), key=lambda i: ((i * 13) % 50, i))
    failed = 0
    for n, i in enumerate(order, 1):
        failed += i % 3 == 0
        assert got[i] == (n, failed)


def test_job_json(spark):
    j = jobs(spark, ["a"])
    text = j.select(wire.encode_job(j).alias("job"))
    back = wire.decode_jobs(text).first()
    assert (back.job_id, back.route, back.payload.toPython(), back.attempts, back.max_attempts, back.enqueued_at) == (
        "a", "ai-small", {}, 0, 3, T0)
    short = spark.createDataFrame([('{"id":"1","file_path":"/x","route":"r","payload":null}',)], "job string")
    row = wire.decode_jobs(short).first()
    assert (row.payload.toPython(), row.attempts, row.max_attempts) == ({}, 0, 3) and row.enqueued_at is not None
    payload = '{"n": 1, "x": 2.5, "o": {"k": [1, 2, null]}, "s": "1", "b": true, "z": null}'
    whole = spark.createDataFrame([(f'{{"id":"1","file_path":"/x","route":"r","payload":{payload}}}',)], "job string")
    decoded = wire.decode_jobs(whole)
    again = wire.decode_jobs(decoded.select(wire.encode_job(decoded).alias("job"))).first()
    assert json.loads(again.payload.toJson()) == json.loads(payload)
    with pytest.raises(Exception, match="required field is missing: route"):
        wire.decode_jobs(spark.createDataFrame([('{"id":"1","file_path":"/x"}',)], "job string")).collect()


def test_result_json(spark):
    r = results(spark, [("a", GOOD, None, 1), ("b", None, "e", 1)])
    text = r.select(wire.encode_result(r).alias("result"))
    assert '"error":null' in text.first()[0]
    back = {x.job_id: x for x in wire.decode_results(text).collect()}
    assert tuple(back["a"].classification) == GOOD and back["a"].error is None
    assert back["b"].classification is None and back["b"].error == "e"
    odd = spark.createDataFrame([(
        '{"job_id":"m","file_path":"/x","route":"r","worker_id":"w","duration_ms":1,"classification":{"missing_fields":true}}',)],
        "result string")
    row = wire.decode_results(odd).first()
    assert row.classification is not None and row.classification.category is None


def test_job_ids_repeat_with_the_run(spark):
    df = spark.createDataFrame([("/a",), ("/b",)], "p string").select(wire.job_id(F.lit("run"), F.col("p")).alias("i"))
    first, again = [r.i for r in df.collect()], [r.i for r in df.collect()]
    assert first == again and len(set(first)) == 2


def test_odd_results_are_malformed_and_stop_nothing(spark):
    given = {"95": 95, "95.7": 95, "true": 1, "3000000000": None, '"NaN"': None, '"95.5"': None, '"88"': 88, "null": None, "[1]": None, '"x"': None}
    text = '{"job_id":"j","file_path":"/f","route":"r","worker_id":"w","duration_ms":1,"classification":{"category":"A","confidence":%s}}'
    df = spark.createDataFrame([(text % c,) for c in given], "result string")
    got = [r.classification.confidence for r in wire.decode_results(df).collect()]
    assert dict(zip(given, got)) == given
