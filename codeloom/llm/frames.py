"""DataFrame helpers shared by the operators: word counting, global running sums, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: rows of a measured table that may be broadcast
BROADCAST_ROWS = 100_000
#: rows that one task of a narrowed table holds
NARROW_ROWS = 20_000


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str) -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``rows``; unchanged beyond.

    ``df`` should be a written table (see ``materialize``): it is counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows by count, in partitions of ``NARROW_ROWS``, at least one per core.

    Small tables are then written in a few files; a table with more rows keeps its partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS)))


def partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Global running sums in ``order`` (total, or ties must be interchangeable).

    Adds, for every ``out: value`` of ``sums``, the sum of ``value`` over all rows up
    to and including this one.  The rows are range-partitioned by ``order`` and
    written once; each range is summed on its own and shifted by the totals of the
    ranges before it (one row per range), so no task holds more than one range.
    """
    ranged = (df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
              .withColumn("__range", F.spark_partition_id()))
    kept = materialize(ranged, name)
    totals = kept.groupBy("__range").agg(*[F.sum(v).alias(f"__t_{o}") for o, v in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("__range", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__t_{o}")
                                       for o in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = kept.select("*", *[F.sum(v).over(inside).alias(f"__l_{o}") for o, v in sums.items()])
    # `shift` has one row per range, that is at most partitions(df) rows
    out = local.join(F.broadcast(shift), "__range")
    return out.select(*df.columns, *[(F.col(f"__l_{o}") + F.col(f"__t_{o}")).alias(o) for o in sums])
