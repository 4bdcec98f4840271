"""Readers for the parquet tables a job starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_file_table(spark: SparkSession, path: str) -> DataFrame:
    """A file table stored as parquet (path, relative, size, mtime, content)."""
    return spark.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition to the cluster's parallelism only when ``df`` is too small to have that many splits.

    Inputs with a single row group come in as one partition; per-row CPU work
    (regex scans, rendering) would then run in one task.  The size is the
    optimizer's estimate, so no job runs; an input of a full split per core or
    more (any large one) is left as it is.  The explicit count also keeps AQE
    from coalescing the shuffle by byte size.
    """
    spark = df.sparkSession
    n = parallelism(spark)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= n * split:
        return df
    return df.repartition(n, key) if key else df.repartition(n)
