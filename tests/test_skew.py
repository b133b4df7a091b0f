"""Scans within groups against plain loops, whole and cut into many parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from filewright.operators import skew
from filewright.operators.skew import after, before, scan, total


def rows(rng, n):
    groups = ["hot"] * 6 + ["a", "b", 'c"x', ""]
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(microseconds=137 * i) for i in range(n)]
    rng.shuffle(times)
    return [(rng.choice(groups), t, i, rng.choice([None, rng.randint(-5, 5)])) for i, t in enumerate(times)]


def loops(table):
    out = {}
    for group in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == group), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in own]
        for i, r in enumerate(own):
            earlier, later = [v for v in values[:i] if v is not None], [v for v in values[i + 1:] if v is not None]
            out[r[2]] = (i + 1, sum(v or 0 for v in values[:i + 1]), earlier[-1] if earlier else None, later[0] if later else None)
    return out


@pytest.mark.parametrize("rows_per_part", [10**6, 300, 20, 3])
def test_scans_equal_loops(spark, rows_per_part):
    table = rows(random.Random(rows_per_part), 1500)
    df = spark.createDataFrame(table, "g string, t timestamp, i long, v int").repartition(5)
    got = scan(df, ["g"], ["t", "i"], {
        "n": total(F.lit(1)), "s": total(F.coalesce("v", F.lit(0))), "b": before(F.col("v")), "a": after(F.col("v"))}, rows_per_part)
    assert got.columns == ["g", "t", "i", "v", "n", "s", "b", "a"]
    assert {r.i: (r.n, r.s, r.b, r.a) for r in got.collect()} == loops(table)


def test_nulls_in_the_order_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", None, 3), ("b", 1, 4)] * 1, "g string, t int, i long")
    for size in (10**6, 1):
        got = scan(df, ["g"], ["t", "i"], {"n": total(F.lit(1))}, size)
        assert {r.i: r.n for r in got.collect()} == {1: 1, 3: 2, 2: 3, 4: 1}
        assert scan(df.limit(0), ["g"], ["t", "i"], {"n": total(F.lit(1))}, size).collect() == []


def test_a_hot_group_lies_in_many_parts(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % 20_011).alias("t"))
    bounds = skew._bounds(df, ["g", "t"], 500)
    sizes = [r["count"] for r in df.groupBy(skew._part(df, ["g", "t"], bounds).alias("p")).count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 2_500


def test_the_input_is_computed_once(spark):
    """What a scan reads after its first pass is the written table."""
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    df = spark.range(3_000, numPartitions=3).mapInArrow(count, "id long").withColumn("g", F.col("id") % 2)
    out = scan(df, ["g"], ["id"], {"n": total(F.lit(1))}, 100)
    assert out.agg(F.max("n")).first()[0] == 1_500 and counted.value == 3_000
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
