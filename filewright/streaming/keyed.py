"""A keyed table written by a stream: the last row of each key, in versions that a commit publishes.

Keys are dealt out to a fixed number of buckets by hash. A batch writes a new version of the buckets it touches, each with
the rows of its last version that the batch does not replace, and then a commit: a small file that names the folder of
every bucket. Readers look at the last commit alone, and read one folder a bucket, whatever the number of batches so far.
A batch that fails leaves folders that no commit names. One that is run again begins from the commit before its own,
writes other folders, and puts its commit in place of the former: the same rows.

Files are reached through Hadoop's file systems, so the folder may be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class KeyedTable:
    """``folder`` holds ``commits/<version>.json`` and ``data/<version>-<attempt>/_bucket=<bucket>``."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        commits = self._path("commits")
        if not self.files.exists(commits):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(commits))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _commit(self, version: int) -> dict:
        stream = self.files.open(self._path("commits", f"{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, commit: dict) -> None:
        """In place in one step: written aside, then renamed over what a former attempt published."""
        aside = self._path("commits", f".{version}-{uuid.uuid4().hex}")
        out = self.files.create(aside, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        context.rename(aside, self._path("commits", f"{version:020d}.json"), over)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame | None:
        """One row per key as of a commit, the last by default; None before the first."""
        known = self.versions()
        known = known if version is None else [v for v in known if v <= version]
        if not known:
            return None
        commit = self._commit(known[-1])
        paths = [f"{self.folder}/{p}" for p in commit["buckets"].values()]
        kind = StructType.fromJson(commit["schema"])
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def merge(self, batch: DataFrame, version: int, order: Column | None = None) -> None:
        """Put the rows of ``batch`` in place of those with the same keys, as ``version``.

        Of rows with equal keys within the batch the one with the largest ``order`` counts. A version before the last is
        committed already and is left alone; the last one may be written again.
        """
        known = self.versions()
        if known and version < known[-1]:
            return
        before = max((v for v in known if v < version), default=None)
        held = {} if before is None else self._commit(before)["buckets"]
        others = [c for c in batch.columns if c not in self.keys]
        row = F.struct(*others)
        # Equal rows in the order of all their values, so that a batch run again chooses the same.
        last = F.max_by(row, row if order is None else F.struct(order, row))
        new = batch.groupBy(*self.keys).agg(last.alias("_row")).select(*self.keys, *[F.col("_row")[c].alias(c) for c in others])
        new = new.select(*batch.columns).withColumn("_bucket", self.bucket()).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]
            kept = [f"{self.folder}/{held[str(b)]}" for b in touched if str(b) in held]
            rows = new
            if kept:
                old = self.spark.read.schema(batch.schema).parquet(*kept).withColumn("_bucket", self.bucket())
                rows = old.join(new.select(*self.keys), self.keys, "left_anti").select(*new.columns).unionByName(new)
            attempt = f"data/{version}-{uuid.uuid4().hex}"
            rows.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder}/{attempt}")
        finally:
            new.unpersist()
        written = {str(b): f"{attempt}/_bucket={b}" for b in touched}
        self._publish(version, {"buckets": {**held, **written}, "schema": batch.schema.jsonValue()})

    def writer(self, order: Callable[[], Column] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is one version."""
        return lambda batch, batch_id: self.merge(batch, batch_id, None if order is None else order())
