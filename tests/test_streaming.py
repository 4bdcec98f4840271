"""Streams equal their batch counterparts."""

from pyspark.sql import functions as F

from codeloom.operators import summary as A
from codeloom.streaming import arrivals as ST
from tests.conftest import files_df


def test_stream_summary_equals_batch(spark):
    rows = [(f"m{i}.rs", f"fn f{i}() {{\n    // x\n}}\n") for i in range(6)] + \
           [(f"p{i}.py", f"class C{i}:\n    def g(self):\n") for i in range(6)]
    files = files_df(spark, rows).withColumn("drop", (F.length("relative") + F.col("size")) % 3)
    drops = ST.stage_drops(files, "drop", "t-drops")
    out = ST.stream_summary(spark, drops, spark.read.parquet(drops).schema, files_per_trigger=1)
    got = sorted(map(tuple, A.summary_report(spark.read.parquet(out).drop("batch_id")).collect()))
    want = sorted(map(tuple, A.summary_report(A.file_summary(files_df(spark, rows))).collect()))
    assert got == want


def test_stream_latest_keeps_newest_version(spark):
    rows = [("a", "m", "{}", 1, "old", 1), ("a", "m", "{}", 2, "new", 5), ("b", "m", "{}", 3, "only", 2),
            ("a", "x", "{}", 4, "other mode", 3), ("a", "m", "{}", 0, "late but older", 4)]
    df = spark.createDataFrame(rows, "path string, mode string, params string, mtime_ms bigint, text string, v bigint")
    df = df.withColumn("drop", (F.col("v") % 2).cast("int"))
    drops = ST.stage_drops(df, "drop", "t-versions")
    base = ST.stream_latest(spark, drops, spark.read.parquet(drops).schema, ["path", "mode", "params"], "v")
    got = {(r.path, r.mode): r.text for r in ST.read_latest(spark, base, ["path", "mode", "params"], "v").collect()}
    assert got == {("a", "m"): "new", ("b", "m"): "only", ("a", "x"): "other mode"}


def test_stream_latest_merges_runs_by_levels(spark):
    """Eleven batches read as two merged runs and three single ones, and hold the newest version of every key."""
    rows = [(f"k{(7 * v) % 5}", "m", "{}", v, f"t{v}", (v * 13) % 44) for v in range(44)]
    df = spark.createDataFrame(rows, "path string, mode string, params string, mtime_ms bigint, text string, v bigint")
    drops = ST.stage_drops(df.withColumn("drop", (F.col("mtime_ms") % 11).cast("int")), "drop", "t-levels")
    key = ["path", "mode", "params"]
    base = ST.stream_latest(spark, drops, spark.read.parquet(drops).schema, key, "v")
    live = [r.removeprefix(base) for r in ST.live_runs(spark, base)]
    assert live == ["/level1/run0", "/level1/run1", "/level0/run8", "/level0/run9", "/level0/run10"]
    want = {p: max((v, t) for q, _, _, _, t, v in rows if q == p)[1] for p in {r[0] for r in rows}}
    assert {r.path: r.text for r in ST.read_latest(spark, base, key, "v").collect()} == want
    assert spark.read.parquet(base + "/level1/run0").count() <= len(want)
