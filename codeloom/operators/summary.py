"""A2 file_summary: one description row per file (the flagship operator).

    files(path, relative, size, content) -> descriptions(
        path, relative, total_lines, symbols, functions, text, error, from_cache)

Plan shape: one narrow pass finishes every file that is not Rust; Rust files go
through the token job (``codeloom.operators.rust``), which carries their guards
and line counts through its shuffle by path and returns one row per file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codeloom.functions import text as T
from codeloom.functions.patterns import DEFAULT_REGISTRY, LanguageRegistry, regex_symbols
from codeloom.operators.filters import long_functions, too_large, too_large_message
from codeloom.operators.rust import rust_items
from codeloom.session import materialize
from codeloom.sources.tables import spread

def empty_symbols():
    return F.array().cast("array<string>")


def empty_functions():
    return F.array().cast("array<struct<name:string,lines:bigint>>")

DESCRIPTION_COLUMNS = ["path", "relative", "total_lines", "symbols", "functions", "text", "error", "from_cache"]


@dataclass(frozen=True)
class PatternConfig:
    max_file_size: int | None = None
    no_truncate: bool = False
    long_threshold: int = T.LONG_THRESHOLD
    registry: LanguageRegistry = field(default_factory=lambda: DEFAULT_REGISTRY)
    rust_partitions: int | None = None


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``_text`` (strict UTF-8 decode when content is binary)."""
    if isinstance(files.schema[content].dataType, BinaryType):
        return files.withColumn("_text", T.as_text_strict(content))
    return files.withColumn("_text", F.col(content))


def file_summary(files: DataFrame, cfg: PatternConfig = PatternConfig(), balance: bool = True) -> DataFrame:
    """Files of every language but Rust are finished in one projection of the scan: guards,
    line counts and regex symbols, no shuffle.  Rust files alone go through the token job,
    which shuffles tokens by path once and carries the guards along.  ``balance=False`` for files
    that are already dealt over the cluster."""
    base = with_text(spread(files) if balance else files)
    big = too_large("size", cfg.max_file_size)
    err = (F.when(big, too_large_message("size", cfg.max_file_size or 0))
           .when(F.col("_text").isNull(), F.lit("unreadable")))
    ok = err.isNull()
    lines = F.when(ok, T.line_count("_text")).cast("bigint")
    is_rs = T.file_ext("relative").eqNullSafe(F.lit("rs"))
    plain = base.where(~is_rs).select(
        "path", "relative", lines.alias("total_lines"),
        F.when(ok, regex_symbols("relative", "_text", cfg.registry)).otherwise(empty_symbols()).alias("symbols"),
        empty_functions().alias("functions"), err.alias("error"))
    carry = F.struct(F.col("relative").alias("relative"), lines.alias("total_lines"), err.alias("error"))
    rust = rust_items(base.where(is_rs).select("path", carry.alias("c"), F.when(ok, F.col("_text")).alias("content")),
                      cfg.rust_partitions, carry="c")
    rust = rust.select(
        "path", F.col("c.relative").alias("relative"), F.col("c.total_lines").alias("total_lines"),
        F.coalesce("symbols", empty_symbols()).alias("symbols"), F.coalesce("functions", empty_functions()).alias("functions"),
        F.col("c.error").alias("error"))
    return plain.unionByName(rust).select(
        "path", "relative", "total_lines", "symbols", "functions",
        F.when(F.col("error").isNotNull(), F.lit(T.ERROR_TEXT))
        .otherwise(T.describe_text("symbols", cfg.no_truncate)).alias("text"),
        "error", F.lit(False).alias("from_cache"))


def summary_report(desc: DataFrame, long_threshold: int = T.LONG_THRESHOLD,
                   with_cache_flag: bool = False) -> DataFrame:
    """Scalar view of descriptions (what the correctness check hashes)."""
    return desc.select(
        "relative",
        F.col("total_lines").cast("bigint").alias("total_lines"),
        F.size("symbols").cast("bigint").alias("n_symbols"),
        F.size("functions").cast("bigint").alias("n_functions"),
        F.size(long_functions("functions", long_threshold)).cast("bigint").alias("n_long"),
        "text", "error", *(["from_cache"] if with_cache_flag else []),
    )


def symbol_rows(desc: DataFrame) -> DataFrame:
    """E16 exploded: (relative, pos, kind, name) per distinct symbol."""
    return desc.select("relative", F.posexplode("symbols").alias("pos", "symbol")).select(
        "relative", (F.col("pos") + 1).cast("bigint").alias("pos"),
        # kinds are single words except 'async def'; names may hold spaces (headings)
        F.regexp_extract("symbol", r"(?s)^(async def|\S+) (.*)$", 1).alias("kind"),
        F.regexp_extract("symbol", r"(?s)^(async def|\S+) (.*)$", 2).alias("name"))


def function_rows(desc: DataFrame) -> DataFrame:
    """N1 exploded: (relative, pos, name, lines)."""
    return desc.select("relative", F.posexplode("functions").alias("pos", "f")).select(
        "relative", (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.col("f.name").alias("name"), F.col("f.lines").cast("bigint").alias("lines"))


def long_count_per_file(desc: DataFrame, threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """A4: files with at least one long function and their count."""
    return (desc.select("relative", F.size(long_functions("functions", threshold)).cast("bigint").alias("n_long"))
            .filter(F.col("n_long") > 0))


def sort_files(files: DataFrame) -> DataFrame:
    """Files in byte order of ``relative`` with their 1-based position.

    ``orderBy`` range-partitions the keys (sampled bounds, no single task holds
    all rows).  The sorted rows are written once with their place within their
    partition; a partition's offset is a running sum over one row per partition.
    """
    ordered = files.select("relative").orderBy("relative")
    place = F.monotonically_increasing_id()  # partition in the upper 31 bits, row in the lower 33
    rows = materialize(ordered.withColumn("place", place), "sorted-files").select(
        "relative", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("relative", (F.col("offset") + F.col("row") + 1).alias("position"))
