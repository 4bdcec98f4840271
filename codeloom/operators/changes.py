"""Change detection between two file-table snapshots.

The reference shells out to ``git diff``; the data work behind it is done
here on tables.  X1 compares content hashes after a full outer join on the
path, carrying ``relative + sha2`` and never the content.  X2 explodes lines
only for modified files and compares per-line multiplicities (``exceptAll``
semantics) with an aggregate on (relative, line) — partial aggregation makes
a file full of identical lines cost one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative, status) with status added / removed / modified; unchanged rows omitted."""
    o = old.select("relative", F.lit(True).alias("in_old"), F.sha2(F.col("content"), 256).alias("h_old"))
    n = new.select("relative", F.lit(True).alias("in_new"), F.sha2(F.col("content"), 256).alias("h_new"))
    j = o.join(n, "relative", "full_outer")
    # presence is a flag of its own: unreadable content is null on either side
    status = (F.when(F.col("in_old").isNull(), F.lit("added"))
              .when(F.col("in_new").isNull(), F.lit("removed"))
              .when(~F.col("h_old").eqNullSafe(F.col("h_new")), F.lit("modified")))
    return j.select("relative", status.alias("status")).filter(F.col("status").isNotNull())


NO_FINAL_NEWLINE = "\\ No newline at end of file"


def _lines(content: str):
    """(mark, line) between ``\n``, carriage returns kept; a missing final newline is a marked line of its own."""
    c = F.col(content)
    parts = F.split(c, "\n", -1)
    plain = F.transform(F.when(F.endswith(c, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
                        lambda x: F.struct(F.lit(False).alias("mark"), x.alias("line")))
    mark = F.array(F.struct(F.lit(True).alias("mark"), F.lit(NO_FINAL_NEWLINE).alias("line")))
    none = F.slice(mark, 1, 0)
    return F.when(c == "", none).otherwise(F.concat(plain, F.when(F.endswith(c, F.lit("\n")), none).otherwise(mark)))


def _line_counts(files: DataFrame, alias: str) -> DataFrame:
    return (files.select("relative", F.explode(_lines("content")).alias("l")).select("relative", "l.*")
            .groupBy("relative", "mark", "line").agg(F.count("*").alias(alias)))


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per modified file, lines added ('+') and removed ('-') with multiplicity.

    ``mark`` tells the note on a missing final newline from a line of the same text.

    The modified-path set (paths only) is written once to the checkpoint
    folder, so each snapshot is read exactly twice: hashes, then the lines of
    modified files."""
    modified = materialize(snapshot_diff(old, new).filter(F.col("status") == "modified").select("relative"),
                           "modified-paths")
    o = _line_counts(old.join(modified, "relative", "left_semi"), "n_old")
    n = _line_counts(new.join(modified, "relative", "left_semi"), "n_new")
    d = o.join(n, ["relative", "mark", "line"], "full_outer").select(
        "relative", "mark", "line", (F.coalesce("n_new", F.lit(0)) - F.coalesce("n_old", F.lit(0))).alias("delta"))
    return d.filter(F.col("delta") != 0).select(
        "relative", F.when(F.col("delta") > 0, F.lit("+")).otherwise(F.lit("-")).alias("change"),
        "line", "mark", F.abs("delta").cast("bigint").alias("n"))
