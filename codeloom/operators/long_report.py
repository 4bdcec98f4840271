"""N3 long_report and its renderers D8-D10.

Each renderer yields one row per unit of output ``(section, relative, entry)``:
section 0 is a header, 1 one entry per file, 2 a footer.  Writing
``orderBy(section, relative)`` with ``.write.text`` reproduces the document.
The functions list comes from the description row itself, so no
``collect_list`` and no shuffle is needed per file; the only global values are
one-row aggregates (the last file name, the file count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.filters import long_functions
from codeloom.session import materialize

ENTRY_COLUMNS = ["section", "relative", "entry"]


def long_report(desc: DataFrame, threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """(relative, total_lines, long array<struct<name, lines>>) for files with a long function."""
    return (desc.select("relative", F.coalesce(F.col("total_lines"), F.lit(0)).cast("bigint").alias("total_lines"),
                        long_functions("functions", threshold).alias("long"))
            .filter(F.size("long") > 0))


def _frame(entries: DataFrame, header: str | None, footer: str | None, empty: str | None) -> DataFrame:
    """Adds header/footer rows; ``empty`` replaces both when there are no entries."""
    n = entries.agg(F.count("*").alias("n"))
    rows = [entries.select(F.lit(1).alias("section"), "relative", "entry")]
    if header is not None:
        rows.append(n.select(F.lit(0).alias("section"), F.lit("").alias("relative"),
                             F.when(F.col("n") > 0, F.lit(header)).otherwise(F.lit(empty)).alias("entry"))
                    .filter(F.col("entry").isNotNull()))
    if footer is not None:
        rows.append(n.filter(F.col("n") > 0).select(F.lit(2).alias("section"), F.lit("").alias("relative"),
                                                     F.lit(footer).alias("entry")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def long_text(desc: DataFrame, threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """D8: 'R [N lines]', one '  └── name: L lines' per function, then a blank line."""
    rep = long_report(desc, threshold)
    fn_lines = F.array_join(F.transform("long", lambda f: F.concat(
        F.lit("  └── "), f["name"], F.lit(": "), f["lines"].cast("string"), F.lit(" lines"))), "\n")
    entry = F.concat(F.col("relative"), F.lit(" ["), F.col("total_lines").cast("string"), F.lit(" lines]\n"),
                     fn_lines, F.lit("\n"))
    return rep.select(F.lit(1).alias("section"), "relative", entry.alias("entry"))


def long_json(desc: DataFrame, threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """Pretty-printed JSON array (2-space indent, keys in sorted order)."""
    # read three times (entries, last file, count): materialise once
    rep = materialize(long_report(desc, threshold), "long-report")
    last = rep.select(F.max("relative")).scalar()
    fn_objs = F.array_join(F.transform("long", lambda f: F.concat(
        F.lit("      {\n        \"lines\": "), f["lines"].cast("string"),
        F.lit(",\n        \"name\": "), T.json_string(f["name"]), F.lit("\n      }"))), ",\n")
    entry = F.concat(
        F.lit("  {\n    \"file\": "), T.json_string("relative"),
        F.lit(",\n    \"long_functions\": [\n"), fn_objs,
        F.lit("\n    ],\n    \"total_lines\": "), F.col("total_lines").cast("string"),
        F.lit("\n  }"), F.when(F.col("relative") == last, F.lit("")).otherwise(F.lit(",")))
    return _frame(rep.select("relative", entry.alias("entry")), "[", "]", "[]")


def long_xml(desc: DataFrame, threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """<long-functions> root, one <file> element per file."""
    rep = long_report(desc, threshold)
    fn_elems = F.array_join(F.transform("long", lambda f: F.concat(
        F.lit("    <function name=\""), T.xml_attr_escape(f["name"]), F.lit("\" lines=\""),
        f["lines"].cast("string"), F.lit("\" />"))), "\n")
    entry = F.concat(F.lit("  <file path=\""), T.xml_attr_escape("relative"), F.lit("\" total_lines=\""),
                     F.col("total_lines").cast("string"), F.lit("\">\n"), fn_elems, F.lit("\n  </file>"))
    out = _frame(rep.select("relative", entry.alias("entry")), None, None, None)
    spark = desc.sparkSession
    frame = spark.createDataFrame([(0, "", "<long-functions>"), (2, "", "</long-functions>")],
                                  "section int, relative string, entry string")
    return out.unionByName(frame)


def render(entries: DataFrame, path: str) -> None:
    """Sink: one text file set whose concatenation (part order) is the document."""
    (entries.orderBy("section", "relative").select("entry")
     .write.mode("overwrite").text(path))
