"""Path filters and guards.

All of them are plain predicates over columns, so Catalyst pushes them below
any later projection and, when the file table is parquet, into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import col

# ---------------------------------------------------------------------------
# The default include / exclude patterns (reference dialect).
# ---------------------------------------------------------------------------
DEFAULT_INCLUDE_PATTERN = (
    r"\.(rs|toml|md|txt|py|js|ts|go|java|cpp|c|h|cs|php|rb|swift|kt"
    r"|sh|bash|zsh|fish|ps1|pl|lua|r|sql|yml|yaml|json|xml|conf|cfg|ini|env|gitignore|dockerignore|editorconfig|prettierrc|eslintrc)$"
    r"|(^|/)(Makefile|Dockerfile|README)$"
)
DEFAULT_EXCLUDE_PATTERN = r"(target|\.git|node_modules|dist|build|\.vscode|\.idea|__pycache__|\.venv|env)"
# ---------------------------------------------------------------------------


def end_anchored(pattern: str, end: str) -> str:
    """``pattern`` with every '$' that is an anchor written as ``end``; not those escaped or in a class."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        if ch == "$" and not in_class:
            out.append(end)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def path_regex(pattern: str) -> str:
    """Reference-dialect path regex -> java.util.regex: Unicode classes, and '$'
    only at the very end (java's '$' would also match before a final newline)."""
    return "(?U)" + end_anchored(pattern, r"\z")


def include_matches(relative, pattern: str) -> Column:
    """unanchored search of the include regex in the relative path."""
    return col(relative).rlike(path_regex(pattern))


def exclude_matches(relative, pattern: str) -> Column:
    """True when the file must be dropped; an empty pattern excludes nothing."""
    if not pattern:
        return F.lit(False)
    return col(relative).rlike(path_regex(pattern))


def select_paths(files: DataFrame, include: str = DEFAULT_INCLUDE_PATTERN,
                 exclude: str = DEFAULT_EXCLUDE_PATTERN, relative: str = "relative") -> DataFrame:
    """exclude is tested first, then include."""
    return files.filter(~exclude_matches(relative, exclude) & include_matches(relative, include))


def too_large(size, cap: int | None) -> Column:
    """F5 predicate."""
    if cap is None:
        return F.lit(False)
    return col(size) > F.lit(int(cap))


def too_large_message(size, cap: int) -> Column:
    return F.concat(F.lit("[SKIPPED: file too large ("), col(size).cast("string"),
                    F.lit(f" > {int(cap)})]"))


def long_functions(functions, threshold: int) -> Column:
    """Functions with at least ``threshold`` lines (array filter, no explode)."""
    return F.filter(col(functions), lambda f: f["lines"] >= F.lit(int(threshold)))
