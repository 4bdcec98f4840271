"""Corpus export (F6 status chain, D1 plain, D2 markdown, D3 xml).

One output row per file, ``(section, relative, entry)``; ``entry`` is the text
the file contributes minus its final newline, which the text writer adds.
The whole export is a single narrow projection: no shuffle until the sink's
``orderBy(section, relative)`` (a range shuffle that keeps every writer task
bounded).  ``content`` is only touched by rows whose status is ``content``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codeloom.functions import text as T


@dataclass(frozen=True)
class DumpOptions:
    max_size: int | None = None
    max_lines: int | None = None
    include_binary: bool = False
    detailed: bool = False
    absolute_paths: bool = False


def dump_status(files: DataFrame, opts: DumpOptions = DumpOptions()) -> DataFrame:
    """Adds ``display``, ``status``, ``reason``, ``body``, ``has_meta``.

    First match wins: metadata error, empty file, over the size limit, binary,
    otherwise content.  Bytes that are not UTF-8 become an ``unreadable`` marker
    (the reference aborts the whole export there).
    """
    content = F.col("content")
    is_bin = isinstance(files.schema["content"].dataType, BinaryType)
    raw = content if is_bin else F.encode(content, "UTF-8")
    if is_bin:
        text = T.as_text_lossy(content) if opts.include_binary else T.as_text_strict(content)
    else:
        text = content
    meta_err = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    size = F.col("size")
    status = F.when(meta_err.isNotNull(), F.lit("error")).when(size == 0, F.lit("empty"))
    reason = F.when(meta_err.isNotNull(), F.concat(F.lit("[ERROR: metadata] "), meta_err)) \
        .when(size == 0, F.lit("[EMPTY FILE]"))
    if opts.max_size is not None:
        over = size > F.lit(int(opts.max_size))
        status = status.when(over, F.lit("skipped"))
        reason = reason.when(over, F.concat(F.lit("[SKIPPED: file size "), T.human_size(size),
                                            F.lit(" > limit "), T.human_size(F.lit(int(opts.max_size))),
                                            F.lit("]")))
    if not opts.include_binary:
        status = status.when(T.is_binary(raw, T.BINARY_PREFIX), F.lit("binary"))
        reason = reason.when(T.is_binary(raw, T.BINARY_PREFIX), F.lit("[BINARY FILE SKIPPED]"))
    status = status.when(text.isNull(), F.lit("unreadable")).otherwise(F.lit("content"))
    reason = reason.when(text.isNull(), F.lit("[ERROR: unreadable] stream did not contain valid UTF-8"))
    body = text if opts.max_lines is None else T.head_lines(text, opts.max_lines)
    display = F.col("path") if opts.absolute_paths else F.col("relative")
    return files.select(
        "relative", display.alias("display"), size.alias("size"), F.col("mtime"),
        status.alias("status"), reason.alias("reason"),
        F.when(status == "content", body).alias("body"),
        meta_err.isNull().alias("has_meta"))


def _nl_if_missing(body: Column) -> Column:
    return F.when(body.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))


def dump_plain(files: DataFrame, opts: DumpOptions = DumpOptions()) -> DataFrame:
    s = dump_status(files, opts)
    plain_head = F.concat(F.lit("==== File: "), F.col("display"), F.lit(" ===="))
    if opts.detailed:
        detail_head = F.concat(F.lit("==== File: "), F.col("display"), F.lit(" (size: "), T.human_size("size"),
                               F.lit(", modified: "), F.coalesce(T.iso_time("mtime"), F.lit("unknown")),
                               F.lit(") ===="))
        head = F.when(F.col("has_meta"), detail_head).otherwise(plain_head)
    else:
        head = plain_head
    entry = F.when(F.col("status") == "content",
                   F.concat(head, F.lit("\n"), F.col("body"), _nl_if_missing(F.col("body")))) \
        .otherwise(F.concat(head, F.lit("\n"), F.col("reason"), F.lit("\n")))
    return s.select(F.lit(1).alias("section"), "relative", entry.alias("entry"))


def dump_markdown(files: DataFrame, opts: DumpOptions = DumpOptions()) -> DataFrame:
    s = dump_status(files, opts)
    head = F.concat(F.lit("## `"), F.col("display"), F.lit("`\n\n"))
    if opts.detailed:
        meta = F.when(F.col("has_meta"), F.concat(
            F.lit("\n*Size: "), T.human_size("size"), F.lit("*, *Modified: "),
            F.coalesce(T.iso_time("mtime"), F.lit("unknown")), F.lit("*\n\n\n"))).otherwise(F.lit(""))
        head = F.concat(head, meta)
    lang = T.lang_tag("display")
    entry = F.when(F.col("status") == "content", F.concat(
        head, F.lit("```"), lang, F.lit("\n"), F.col("body"), _nl_if_missing(F.col("body")), F.lit("```\n"))) \
        .otherwise(F.concat(head, F.lit("```\n"), F.col("reason"), F.lit("\n```\n")))
    return s.select(F.lit(1).alias("section"), "relative", entry.alias("entry"))


def dump_xml(files: DataFrame, opts: DumpOptions = DumpOptions(), project_name: str = "project",
             generated: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``generated`` is a parameter (the reference stamps the wall clock)."""
    s = dump_status(files, opts)
    path_attr = T.xml_attr_escape("display")
    mtime_attr = F.when(F.col("mtime").isNotNull(),
                        F.concat(F.lit(' mtime="'), T.epoch_seconds("mtime").cast("string"), F.lit('"'))) \
        .otherwise(F.lit(""))
    meta_attrs = F.when(F.col("has_meta"), F.concat(F.lit(' size="'), F.col("size").cast("string"), F.lit('"'),
                                                    mtime_attr)).otherwise(F.lit(""))
    marker = F.concat(F.lit('    <file path="'), path_attr, F.lit('"'), meta_attrs, F.lit(' error="'),
                      T.xml_attr_escape("reason"), F.lit('" />'))
    element = F.concat(F.lit('    <file path="'), path_attr, F.lit('" size="'), F.col("size").cast("string"),
                       F.lit('"'), mtime_attr, F.lit(">\n      "), T.xml_body("body"), F.lit("\n    </file>"))
    entry = F.when(F.col("status") == "content", element).otherwise(marker)
    rows = s.select(F.lit(1).alias("section"), "relative", entry.alias("entry"))
    spark = files.sparkSession
    esc = (lambda v: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
           .replace('"', "&quot;").replace("'", "&apos;"))
    header = ('<?xml version="1.0" encoding="UTF-8"?>\n'
              f'<project name="{esc(project_name)}" generated="{esc(generated)}">\n  <files>')
    frame = spark.createDataFrame([(0, "", header), (2, "", "  </files>\n</project>")],
                                  "section int, relative string, entry string")
    return rows.unionByName(frame)


def write_dump(entries: DataFrame, path: str) -> None:
    """Sink: range-partitioned sort, one text part per task, concatenation = document."""
    entries.orderBy("section", "relative").select("entry").write.mode("overwrite").text(path)
