"""Session helpers.

The library never hard-codes a scratch location: lineage cuts and staging
tables go under ``spark.checkpoint.dir`` as configured by the cluster.  Only
when that setting is absent and the master is local (tests) do we fill in a
private temp dir; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ARROW_BATCH_BYTES = 8 << 20
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows sent to a Python worker at once, by bytes: texts differ by orders of magnitude
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BATCH_BYTES),
    # Python data sources need this for filter pushdown into the reader.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "codeloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``codeloom`` importable in Python workers (mapInPandas, foreachBatch
    closures), whatever the driver's working directory: zip it once per
    application on the driver and ``addPyFile`` it."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    # built on the driver only: addPyFile sends it to every executor
    target = tempfile.mkdtemp(prefix="codeloom-pyfiles-")
    archive = shutil.make_archive(os.path.join(target, "codeloom"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on; safe to call on a session we did not build."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder, ``spark.checkpoint.dir``; a temp dir where a local master left it unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="codeloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused directory under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/codeloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` once as parquet under the shared checkpoint
    folder and read it back.  Unlike an eager RDD checkpoint of an unpersisted
    plan, the upstream work runs exactly once; the table survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
