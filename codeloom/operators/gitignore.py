"""Ignore rules (F4) as table operators.

``gitignore_rules(files)`` parses every ``.gitignore`` in a file table into
rows ``(dir, ord, negated, dir_only, regex)``; the per-line glob translation
is a small Arrow-batched helper.  ``ignored(files, rules)`` decides every path:

* the rules that hold in a directory are those of its nearest ``.gitignore`` and of the ones
  above, so each ``.gitignore`` has one list; a list is folded into one pattern that matches exactly
  the paths whose last matching rule (deeper directory first, then later line) ignores them: a positive rule
  is one more alternative, a negated one a lookahead in front of all before it;
* directories are the distinct parents of files and their prefixes, one row each; a directory is ignored
  if its own path matches the list of its parent or a directory above it is ignored;
* a file takes its directory's verdict and list by one join on its parent and is matched once, so it can't be
  re-included under an ignored directory; directory-only rules never match files.

Rows are sorted by pattern before they are matched, so a pattern is compiled once a task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from codeloom.functions import text as T
from codeloom.session import materialize

RULE_SCHEMA = StructType([StructField("negated", BooleanType()), StructField("dir_only", BooleanType()),
                          StructField("regex", StringType())])


def glob_to_regex(line: str):
    """One .gitignore line -> (negated, dir_only, regex) or None for blanks and comments."""
    s = line.rstrip("\r")
    # trailing spaces are ignored unless escaped
    while s.endswith(" ") and not s.endswith("\\ "):
        s = s[:-1]
    if not s or s.startswith("#"):
        return None
    negated = s.startswith("!")
    if negated:
        s = s[1:]
    elif s.startswith("\\!") or s.startswith("\\#"):
        s = s[1:]
    dir_only = s.endswith("/")
    s = s.rstrip("/")
    if not s:
        return None
    anchored = "/" in s
    s = s.lstrip("/")
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if s.startswith("**/", i) and (i == 0 or s[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif s.startswith("/**", i) and i + 3 == len(s):
            out.append("/.*")
            i += 3
        elif s.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = s.find("]", i + 2)
            if j < 0:
                out.append(re.escape(c))
                i += 1
            else:
                body = s[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j + 1
        elif c == "\\" and i + 1 < len(s):
            out.append(re.escape(s[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    body = "".join(out)
    prefix = "" if anchored else "(?:.*/)?"
    return negated, dir_only, "^" + prefix + body + r"\z"


@F.pandas_udf(RULE_SCHEMA)
def _parse_lines(lines: pd.Series) -> pd.DataFrame:
    parsed = [glob_to_regex(x) if x is not None else None for x in lines]
    return pd.DataFrame({
        "negated": [p[0] if p else None for p in parsed],
        "dir_only": [p[1] if p else None for p in parsed],
        "regex": [p[2] if p else None for p in parsed],
    })


def gitignore_rules(files: DataFrame) -> DataFrame:
    """(dir, ord, negated, dir_only, regex) from every '.gitignore' in the file table."""
    g = files.filter(T.basename("relative") == ".gitignore")
    text = F.col("content").cast("string")
    parent = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    lines = g.select(parent.alias("dir"), F.posexplode(T.split_lines(text)).alias("ord", "line"))
    rules = lines.select("dir", F.col("ord").cast("int").alias("ord"), _parse_lines("line").alias("r"))
    return rules.filter(F.col("r.regex").isNotNull()).select(
        "dir", "ord", F.col("r.negated").alias("negated"), F.col("r.dir_only").alias("dir_only"),
        F.col("r.regex").alias("regex"))


def _ancestors(path: str) -> Column:
    """'' and every prefix of a directory, itself included."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    top = F.array(F.lit(""))
    return F.when(F.col(path) == "", top).otherwise(F.concat(top, below))


def _depth(path: str) -> Column:
    return F.when(F.col(path) == "", 0).otherwise(F.size(F.split(path, "/")))


def _parent(path: str) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def _folded(rules: Column) -> Column:
    """One pattern for the paths that ``rules`` (in order) ignore; null if none can be."""
    def step(body: Column, rule: Column) -> Column:
        more = F.when(body == "", rule["regex"]).otherwise(F.concat(body, F.lit("|"), rule["regex"]))
        less = F.when(body == "", body).otherwise(F.concat(F.lit("(?!"), rule["regex"], F.lit(")(?:"), body, F.lit(")")))
        return F.when(rule["negated"], less).otherwise(more)
    body = F.aggregate(rules, F.lit(""), step)
    return F.when(body != "", F.concat(F.lit("^(?:"), body, F.lit(")")))


def rule_lists(rules: DataFrame) -> DataFrame:
    """(list, for_dirs, for_files): the patterns of each directory that has rules, on whole relative paths."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("dir"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("/\\E"))
    whole = F.concat(F.when(F.col("dir") == "", F.lit("")).otherwise(quoted), F.expr("substring(regex, 2)"))
    placed = rules.select("dir", F.struct(_depth("dir").alias("depth"), "ord", "negated", "dir_only", whole.alias("regex")).alias("rule"))
    own = rules.select(F.col("dir").alias("list")).distinct()
    chain = own.select("list", F.explode(_ancestors("list")).alias("dir")).join(placed, "dir")
    lists = chain.groupBy("list").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    return lists.select("list", _folded(F.col("rules")).alias("for_dirs"),
                        _folded(F.filter("rules", lambda r: ~r["dir_only"])).alias("for_files"))


def directory_verdicts(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(dir, out, for_files): per directory of ``files`` whether it is ignored, and the pattern for its files."""
    lists = materialize(rule_lists(rules), "ignore-lists")
    parents = files.select(_parent("relative").alias("dir")).distinct()
    dirs = materialize(parents.select(F.explode(_ancestors("dir")).alias("dir")).distinct(), "ignore-dirs")
    above = dirs.select("dir", F.explode(_ancestors("dir")).alias("list"))
    nearest = above.join(lists.select("list"), "list").groupBy("dir").agg(F.max_by("list", _depth("list")).alias("list"))
    ruled = materialize(nearest.join(lists, "list").select("dir", "for_dirs", "for_files"), "ignore-ruled")
    hit = (dirs.where("dir <> ''").select("dir", _parent("dir").alias("up"))
           .join(ruled.select(F.col("dir").alias("up"), "for_dirs"), "up").sortWithinPartitions("for_dirs")
           .where(F.expr("dir rlike for_dirs")).select(F.col("dir").alias("list")))
    out = above.join(hit, "list").select("dir").distinct().withColumn("out", F.lit(True))
    return dirs.join(ruled, "dir", "left").join(out, "dir", "left").select("dir", F.coalesce("out", F.lit(False)).alias("out"), "for_files")


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Relative paths of files that the rules ignore."""
    verdicts = materialize(directory_verdicts(files, rules).where("out or for_files is not null"), "ignore-verdicts")
    met = files.select("relative", _parent("relative").alias("dir")).join(verdicts, "dir").sortWithinPartitions("for_files")
    return met.where(F.expr("out or coalesce(relative rlike for_files, false)")).select("relative").distinct()


def ignored_paths(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The ignored-path set, written once to the checkpoint folder (rules too)."""
    rules = materialize(gitignore_rules(files) if rules is None else rules, "ignore-rules")
    return materialize(ignored(files.select("relative"), rules), "ignored-paths")


def gitignore_filter(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Files kept after honouring the ignore rules (rules default to the table's own .gitignore files).

    The rules and the ignored-path set are small and written once to the
    checkpoint folder; the file table is read for paths only (pruned to the
    ``relative`` column) and once more for the kept rows."""
    return files.join(ignored_paths(files, rules), "relative", "left_anti")
