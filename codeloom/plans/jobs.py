"""End-to-end jobs: the reference's command flows composed from the operators.

    files = jobs.load(spark, root="/src")                     # or any file table
    entries, results = jobs.analyze(files, AnalyzeOptions(format="json"))
    jobs.write_document(entries, "/out/tree")                 # ordered text parts

``analyze`` = filters -> (cache) -> pattern or llm descriptions -> tree or
long-function report; ``export`` = filters -> dump in plain / markdown / xml;
``diff`` = snapshot comparison.  Every step is a DataFrame; nothing is
collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import changes as X
from codeloom.operators import dump as D
from codeloom.operators import filters as Fl
from codeloom.operators import gitignore as G
from codeloom.operators import long_report as R
from codeloom.operators import state as S
from codeloom.operators import summary as A
from codeloom.operators import tree as Tr
from codeloom.sources import filetree as FT


@dataclass
class AnalyzeOptions:
    mode: str = "pattern"                    # "pattern" | "llm"
    format: str = "color"                    # "color" | "plain" | "json" | "xml"
    depth: int | None = None
    long: int | None = None                  # long-function report threshold instead of a tree
    no_truncate: bool = False
    no_long_indicator: bool = False
    max_file_size: int | None = None
    include: str = Fl.DEFAULT_INCLUDE_PATTERN
    exclude: str = Fl.DEFAULT_EXCLUDE_PATTERN
    respect_gitignore: bool = True
    language: str = "ru"
    backends: list = field(default_factory=list)
    results: DataFrame | None = None         # stored results table (None: cache disabled)


def load(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """A directory tree as a file table (distributed listing)."""
    return FT.scan_tree(spark, root, include=include, exclude=exclude)


def select(files: DataFrame, include: str, exclude: str, respect_gitignore: bool) -> DataFrame:
    out = Fl.select_paths(files, include, exclude)
    if respect_gitignore:
        # rules come from every .gitignore in the tree, even ones the path filters drop
        out = out.join(G.ignored_paths(files), "relative", "left_anti")
    return out


def analyze(files: DataFrame, opts: AnalyzeOptions = AnalyzeOptions()) -> tuple[DataFrame, DataFrame | None]:
    """(entries, updated results or None).  Entries are (section|node, ..., entry) rows of the document."""
    chosen = select(files, opts.include, opts.exclude, opts.respect_gitignore)
    cfg = A.PatternConfig(max_file_size=opts.max_file_size, no_truncate=opts.no_truncate)
    results = None
    if opts.mode == "llm":
        if opts.results is not None:
            desc, results = S.incremental_describe(chosen, opts.results, opts.backends, opts.language,
                                                   opts.max_file_size)
        else:
            from codeloom.operators.describe import describe_llm
            desc = describe_llm(chosen, opts.backends, opts.language, opts.max_file_size) \
                .withColumn("from_cache", F.lit(False))
        from codeloom.operators.describe import llm_descriptions
        desc = llm_descriptions(desc)
    elif opts.results is not None:
        desc, results = S.incremental_summary(chosen, opts.results, cfg, opts.include, opts.exclude)
    else:
        desc = A.file_summary(chosen, cfg)
    if opts.long is not None:
        render = {"json": R.long_json, "xml": R.long_xml}.get(opts.format, R.long_text)
        return render(desc, opts.long), results
    if opts.format == "json":
        return Tr.tree_json(desc, opts.depth), results
    if opts.format == "xml":
        return Tr.tree_xml(desc, opts.depth), results
    return Tr.tree_plain(desc, opts.depth, opts.no_long_indicator, color=opts.format == "color"), results


def export(files: DataFrame, fmt: str = "plain", options: D.DumpOptions = D.DumpOptions(),
           include: str = Fl.DEFAULT_INCLUDE_PATTERN, exclude: str = Fl.DEFAULT_EXCLUDE_PATTERN,
           respect_gitignore: bool = True, project_name: str = "project",
           generated: str = "1970-01-01T00:00:00Z") -> DataFrame:
    chosen = select(files, include, exclude, respect_gitignore)
    if fmt == "xml":
        return D.dump_xml(chosen, options, project_name, generated)
    if fmt in ("markdown", "md"):
        return D.dump_markdown(chosen, options)
    return D.dump_plain(chosen, options)


def diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed paths with status, changed lines with multiplicity)."""
    return X.snapshot_diff(old, new), X.line_changes(old, new)


def write_document(entries: DataFrame, path: str) -> None:
    """Sink for any renderer: order by its key, one text part per range partition."""
    if "node" in entries.columns:
        Tr.write_tree(entries, path)
    else:
        R.render(entries, path)
