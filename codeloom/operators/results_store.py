"""Stored results as copy-on-write buckets under numbered manifests (C1-C4 at scale).

Rows are dealt into ``buckets`` by the hash of their path.  A snapshot is a manifest: for every
bucket the version of the directory that holds it.  An upsert reads and rewrites only the
buckets that its rows fall into and writes a new manifest last, so

* bytes written go with the change, not with the table;
* a snapshot stays readable as long as its directories are kept;
* a run that dies before its manifest is complete leaves the store as it was, and its rerun writes over
  the same directories.

Manifests hold one row per bucket, a number fixed when the store is made; only they reach the driver.  One writer
at a time: two upserts of one snapshot would write the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.state import RESULT_SCHEMA, cache_upsert

BUCKETS = 64
MANIFEST = "bucket int, version int, buckets int"


class ResultsStore:
    """A results table at ``path`` (any store that Spark reads)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, schema: str = RESULT_SCHEMA):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        last = self.snapshot()
        # a store keeps the number of buckets it was made with
        self.buckets = self._manifest(last).first()["buckets"] if last else buckets

    def snapshot(self) -> int:
        """The newest complete snapshot; 0 before the first upsert."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(fs_path):
            return 0
        made = [s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("snapshot=")]
        done = [int(p.getName().split("=")[1]) for p in made if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=0)

    def _manifest(self, snapshot: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/snapshot={snapshot}")

    def _versions(self, snapshot: int) -> dict[int, int]:
        return {r["bucket"]: r["version"] for r in self._manifest(snapshot).collect()} if snapshot else {}

    def read(self, snapshot: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a snapshot (the newest), of all or some buckets."""
        versions = self._versions(self.snapshot() if snapshot is None else snapshot)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, new: DataFrame, order_col: str | None = None) -> int:
        """A new snapshot with ``new`` rows in place of those of their keys; its number."""
        before = self.snapshot()
        versions, now = self._versions(before), before + 1
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        touched = {r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()}  # at most `buckets` numbers
        if not touched:
            return before
        merged = cache_upsert(self.read(before, touched), new, order_col)
        # rows are dealt over tasks by key, so a bucket is some files, and no task holds a whole one
        (merged.withColumn("bucket", bucket).sortWithinPartitions("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.path}/data/version={now}"))
        rows = [(b, now if b in touched else versions[b], self.buckets) for b in sorted(touched | set(versions))]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/snapshot={now}")
        return now
