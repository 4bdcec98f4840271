"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.frames import BROADCAST_ROWS, narrow
from codeloom.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Every step is a map-side combined minimum and a join on the centre of a star (broadcast
    while the counted edges are few); the number of steps grows with the logarithm of the longest path.  Only counts reach
    the driver.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    state = _state(e)
    while state[0]:
        # centres and edges of a large star: at most two per edge of the last count
        n = 2 * state[0]
        centres = (lambda df: F.broadcast(narrow(df, n))) if n <= BROADCAST_ROWS else (lambda df: df)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(centres(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(narrow(large, n), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centres(down), "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        e = materialize(narrow(small.select("e.*").where("u <> v").distinct(), 2 * n), "small-star")
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
