"""Structured Streaming over arriving file-table drops.

New file versions arrive as *new* parquet files (the file source never
re-emits a rewritten path).  Both jobs run the batch operators inside
``foreachBatch`` because the per-file operators use window functions, which
streaming plans do not support:

* T1 ``stream_summary``: stateless, each micro-batch's descriptions are
  appended under ``out/batch_id=<n>`` (overwrite of that one directory makes
  a replayed batch idempotent).
* T2 ``stream_latest``: a stateful streaming aggregation keeps the newest
  version per key in the state store; update mode emits only changed keys,
  written per batch id as a run of level 0.  Every ``FANOUT`` runs of a level are
  merged into one of the next (newest wins), so reading the latest rows opens at most
  ``FANOUT - 1`` runs a level however many batches came.  Which runs hold follows from the number of
  batches alone, so a replayed batch writes the same runs again.

Checkpoints and outputs live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.summary import PatternConfig, file_summary
from codeloom.session import scratch_path

#: runs of a level that are merged into one of the next
FANOUT = 4


def stage_drops(df: DataFrame, drop_col: str, name: str = "drops") -> str:
    """Writes ``df`` partitioned by ``drop_col``: one directory (and one file) per arrival."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartition(drop_col).write.partitionBy(drop_col).parquet(path)
    return path


def _read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def stream_summary(spark: SparkSession, drops: str, schema, cfg: PatternConfig = PatternConfig(),
                   files_per_trigger: int = 1) -> str:
    """file_summary on every arriving file table; returns the output directory."""
    out = scratch_path(spark, "stream-summary")
    ckpt = scratch_path(spark, "stream-summary-ckpt")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        (file_summary(batch, cfg).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    q = (_read_stream(spark, drops, schema, files_per_trigger).writeStream
         .foreachBatch(per_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_latest(spark: SparkSession, drops: str, schema, key: list[str], version: str,
                  files_per_trigger: int = 1) -> str:
    """Newest version per key as a stateful streaming aggregation.

    ``groupBy(key).agg(max_by(row, version))`` keeps one state row per key in
    the state store (checkpointed with the query); in update mode each
    micro-batch emits only the keys it changed, which ``foreachBatch`` writes as a
    run of level 0 and merges upwards every ``FANOUT`` runs (a replayed batch overwrites
    its own runs).  A row is rewritten once a level.  Returns the base of the runs;
    ``read_latest`` folds the live ones.
    """
    base = scratch_path(spark, "stream-latest")
    ckpt = scratch_path(spark, "stream-latest-ckpt")
    cols = [f.name for f in schema.fields if f.name != "drop"]
    rest = [c for c in cols if c not in key]
    stream = _read_stream(spark, drops, schema, files_per_trigger).select(*cols)
    latest = stream.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")) \
        .select(*key, *[F.col("_r." + c).alias(c) for c in rest])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_run(base, 0, batch_id))
        level, n = 0, batch_id + 1
        while n % FANOUT == 0:
            # the last FANOUT runs of this level are whole: one run of the next holds their newest rows
            n //= FANOUT
            runs = [_run(base, level, r) for r in range(FANOUT * (n - 1), FANOUT * n)]
            level += 1
            newest(batch.sparkSession.read.schema(batch.schema).parquet(*runs), key, version).write.mode("overwrite").parquet(
                _run(base, level, n - 1))

    q = (latest.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def _run(base: str, level: int, run: int) -> str:
    return f"{base}/level{level}/run{run}"


def newest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of largest ``version`` per key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")) \
        .select(*key, *[F.col("_r." + c).alias(c) for c in rest])


def _whole_runs(spark: SparkSession, base: str, level: int) -> set[int]:
    """Runs of a level that were written completely; numbers only, at most one per batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/level{level}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return set()
    dirs = [s.getPath() for s in fs.listStatus(path)]
    done = [d.getName() for d in dirs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]
    return {int(name[3:]) for name in done if name.startswith("run")}


def live_runs(spark: SparkSession, base: str) -> list[str]:
    """The runs that hold the latest rows: of each level those that no whole run of a higher level covers."""
    levels = []
    while runs := _whole_runs(spark, base, len(levels)):
        levels.append(runs)
    out, covered = [], 0  # batches before `covered` are in a chosen run
    for level in range(len(levels) - 1, -1, -1):
        width = FANOUT ** level
        while covered % width == 0 and covered // width in levels[level]:
            out.append(_run(base, level, covered // width))
            covered += width
    return out


def read_latest(spark: SparkSession, base: str, key: list[str], version: str) -> DataFrame:
    """The newest row per key over the live runs."""
    return newest(spark.read.parquet(*live_runs(spark, base)), key, version)
