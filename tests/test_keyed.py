"""The keyed table against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from filewright.streaming import KeyedTable


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_replays_equal_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    table, want = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4), {}
    assert table.read() is None
    for version in range(4):
        batch = [(rng.randint(0, 12), rng.randint(0, 99), version) for _ in range(rng.choice([0, 3, 9]))]
        df = spark.createDataFrame(batch, "k long, v long, at long")
        before = dict(want)
        for k, v, at in sorted(batch):
            want[k] = (v, at)
        table.merge(df, version, F.col("v"))
        if rng.random() < 0.7:
            table.merge(df, version, F.col("v"))  # run again after a failure
        assert rows(table.read()) == sorted((k, *v) for k, v in want.items())
        if version:
            assert rows(table.read(version - 1)) == sorted((k, *v) for k, v in before.items())
    table.merge(spark.createDataFrame([(1, -1, -1)], "k long, v long, at long"), 0)  # committed long ago
    assert rows(table.read()) == sorted((k, *v) for k, v in want.items())


def test_a_failing_batch_leaves_the_last_commit(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.merge(spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
    bad = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(2).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, 1)
    assert table.versions() == [0] and {r.v for r in table.read().collect()} == {1}


def test_readers_scan_no_old_version(spark, tmp_path):
    """Thirty batches of one key: a reader sees one folder a bucket."""
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.merge(spark.range(40).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    for version in range(1, 8):
        table.merge(spark.createDataFrame([(3, version)], "k long, v int"), version)
    folders = {f.rsplit("/", 1)[0] for f in table.read().inputFiles()}
    assert len(folders) == 4 and sum("7-" in f for f in folders) == 1
    assert {r.k: r.v for r in table.read().collect()} == {**{k: 0 for k in range(40)}, 3: 7}
