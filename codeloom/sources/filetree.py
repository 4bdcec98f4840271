"""Directory trees as file tables.

``spark.read.format("filetree").option("root", dir).load()`` yields

    path string, relative string, size bigint, mtime timestamp, content binary, error string

Planning opens at most ``listTasks`` directories from the top down; the subtrees below are
listed and read by tasks of their own: regular files, hidden ones included,
symbolic links and directories skipped, relative paths with '/' separators.
Include / exclude patterns, the size cap and Spark's filters on path, relative and size
(``pushFilters``) are applied while listing, so files they reject are never opened, and
directories that cannot hold a pushed prefix are not entered.
Spark's ``binaryFile`` source is not used because it silently skips names
starting with '.' or '_' (``__init__.py``, ``.env``).

``scan_tree`` is the scale path: the listing itself is distributed (one
executor round per directory level, results written to the checkpoint
folder), path filters are Spark predicates, and contents are read on
executors in partitions sized by total bytes.  The data source above keeps
the listing on the driver and suits trees whose listing fits there.

``export_tree`` is the inverse: it writes a file table's contents under a
root directory from the executors (one file per row).
"""

from __future__ import annotations

import datetime
import itertools
import os
import re
from collections import deque
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
                                    StringEndsWith, StringStartsWith)

from codeloom.operators.filters import end_anchored

SCHEMA = "path string, relative string, size bigint, mtime timestamp, content binary, error string"


def posix_path(root) -> str:
    """The file system path of a folder given as a path or ``file:`` URI; other stores can't hold directory trees."""
    uri = urlparse(os.fspath(root))
    if uri.scheme == "file":
        return unquote(uri.path)
    if "://" in os.fspath(root):
        raise ValueError(f"a directory tree needs a file system path, not {root}")
    return os.fspath(root)


class Selection:
    """Which files of a tree are wanted, told from metadata: include / exclude patterns and pushed filters."""

    def __init__(self, include: str | None = None, exclude: str | None = None):
        self.include, self.exclude = include, exclude
        self.filters: list[Filter] = []

    def push(self, f: Filter) -> bool:
        """Takes a filter on path, relative or size; False if it is of another kind."""
        inner = f.child if isinstance(f, Not) else f
        known = isinstance(inner, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual,
                                   StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull))
        if not known or inner.attribute not in (("path",), ("relative",), ("size",)):
            return False
        self.filters.append(f)
        return True

    def wants(self, path: str, relative: str, size: int | None) -> bool:
        if self.exclude and re.search(end_anchored(self.exclude, r"\Z"), relative):
            return False
        if self.include and not re.search(end_anchored(self.include, r"\Z"), relative):
            return False
        row = {"path": path, "relative": relative, "size": size}
        return all(_holds(f, row) is True for f in self.filters)

    def may_hold(self, relative_dir: str) -> bool:
        """Whether wanted files can lie under a directory (False by their common start only)."""
        under = f"{relative_dir}/" if relative_dir else ""
        starts = [f.value for f in self.filters if isinstance(f, StringStartsWith) and f.attribute == ("relative",)]
        starts += [f.value for f in self.filters if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("relative",)]
        return all(v.startswith(under) or under.startswith(v) for v in starts)


def _holds(f: Filter, row: dict) -> bool | None:
    """SQL truth of a pushed filter (None: unknown)."""
    if isinstance(f, Not):
        inner = _holds(f.child, row)
        return None if inner is None else not inner
    have = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return have is None
    if isinstance(f, IsNotNull):
        return have is not None
    if isinstance(f, EqualNullSafe):
        return have == f.value
    if have is None:
        return None
    if isinstance(f, In):
        return True if have in f.value else None if None in f.value else False
    if f.value is None:
        return None
    return {EqualTo: lambda: have == f.value, GreaterThan: lambda: have > f.value, GreaterThanOrEqual: lambda: have >= f.value,
            LessThan: lambda: have < f.value, LessThanOrEqual: lambda: have <= f.value,
            StringStartsWith: lambda: have.startswith(f.value), StringEndsWith: lambda: have.endswith(f.value),
            StringContains: lambda: f.value in have}[type(f)]()


def list_directory(root: str, relative: str):
    """(files, subdirectories) of one directory: (path, relative, size, mtime, error) rows and relative paths.

    Regular files, hidden ones included; links are skipped.
    """
    files, dirs = [], []
    try:
        entries = os.scandir(os.path.join(root, relative) if relative else root)
    except OSError as e:
        return [(os.path.join(root, relative), relative, None, None, str(e))], []
    with entries:
        for e in entries:
            rel = f"{relative}/{e.name}" if relative else e.name
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    dirs.append(rel)
                elif e.is_file(follow_symlinks=False):
                    st = e.stat(follow_symlinks=False)
                    files.append((e.path, rel, st.st_size, st.st_mtime, None))
            except OSError as err:
                files.append((e.path, rel, None, None, str(err)))
    return files, dirs


class _Subtrees(InputPartition):
    """Directories to walk, and files already listed."""

    def __init__(self, dirs, files):
        self.dirs, self.files = dirs, files


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(posix_path(options["root"]))
        self.selection = Selection(options.get("include"), options.get("exclude"))
        self.max_size = int(options["maxSize"]) if options.get("maxSize") else None
        self.tasks = int(options.get("listTasks", 64))

    def pushFilters(self, filters):
        for f in filters:
            if not self.selection.push(f):
                yield f

    def partitions(self):
        """Subtrees for the tasks to list: at most ``listTasks`` directories are opened here, from the top down."""
        todo, files, opened = deque([""]), [], 0
        while todo and len(todo) < self.tasks and opened < self.tasks:
            found, dirs = list_directory(self.root, todo.popleft())
            opened += 1
            files += [r for r in found if r[4] or self.selection.wants(*r[:3])]
            todo += [d for d in dirs if self.selection.may_hold(d)]
        return [_Subtrees([d], []) for d in todo] + [_Subtrees([], files[i::8]) for i in range(min(8, len(files)))] or [_Subtrees([], [])]

    def read(self, partition):
        yield from map(self._row, partition.files)
        todo = deque(partition.dirs)
        while todo:
            found, dirs = list_directory(self.root, todo.popleft())
            todo += [d for d in dirs if self.selection.may_hold(d)]
            yield from (self._row(r) for r in found if r[4] or self.selection.wants(*r[:3]))

    def _row(self, r):
        path, rel, size, mtime, err = r
        ts = datetime.datetime.fromtimestamp(mtime, tz=datetime.timezone.utc) if mtime is not None else None
        content = None
        if err is None and (self.max_size is None or size <= self.max_size):
            try:
                with open(path, "rb") as fh:
                    content = fh.read()
            except OSError as e:
                err = str(e)
        return path, rel, size, ts, content, err


class FileTreeSource(DataSource):
    """Options: root (required), include, exclude, maxSize (content not read above it), listTasks (subtrees
    that are listed and read as tasks).  Filters on path, relative and size are pushed into the listing."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTreeSource)


def scan(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None,
         max_size: int | None = None, list_tasks: int | None = None) -> DataFrame:
    """The file table of a directory tree."""
    register(spark)
    r = spark.read.format("filetree").option("root", root)
    if include:
        r = r.option("include", include)
    if exclude:
        r = r.option("exclude", exclude)
    if max_size is not None:
        r = r.option("maxSize", str(max_size))
    if list_tasks:
        r = r.option("listTasks", str(list_tasks))
    return r.load()


def _writer(root: str):
    def write(batches):
        import pandas as pd
        made = None
        for pdf in batches:
            n = 0
            for rel, content in zip(pdf["relative"], pdf["content"]):
                p = os.path.join(root, rel)
                if os.path.dirname(p) != made:
                    made = os.path.dirname(p)
                    os.makedirs(made, exist_ok=True)
                data = content if isinstance(content, (bytes, bytearray)) else str(content).encode("utf-8")
                with open(p, "wb") as fh:
                    fh.write(data)
                n += 1
            yield pd.DataFrame({"written": [n]})
    return write


def export_tree(files: DataFrame, root: str) -> int:
    """Writes each row's content to ``root/relative`` on the executors; returns the file count."""
    out = files.select("relative", "content").mapInPandas(_writer(posix_path(root)), "written bigint")
    return out.agg(F.sum("written")).first()[0] or 0


# ---------------------------------------------------------------- distributed scan

LISTING_SCHEMA = "kind string, path string, relative string, size bigint, mtime double, error string"


def _list_level(root: str, chunk_rows: int = 50_000):
    """Executors: list one directory level (files, links skipped, subdirectories to visit next).

    Output is yielded in chunks, so a directory holding millions of entries
    never materialises as one frame in a worker."""
    cols = ["kind", "path", "relative", "size", "mtime", "error"]

    def run(batches):
        import pandas as pd
        out = []
        for pdf in batches:
            for rel_dir in pdf["relative"]:
                d = os.path.join(root, rel_dir) if rel_dir else root
                try:
                    it = os.scandir(d)
                except OSError as e:
                    out.append(("error", d, rel_dir, None, None, str(e)))
                    continue
                with it:
                    for e in it:
                        rel = f"{rel_dir}/{e.name}" if rel_dir else e.name
                        try:
                            if e.is_symlink():
                                continue
                            if e.is_dir(follow_symlinks=False):
                                out.append(("dir", e.path, rel, None, None, None))
                            elif e.is_file(follow_symlinks=False):
                                st = e.stat(follow_symlinks=False)
                                out.append(("file", e.path, rel, st.st_size, st.st_mtime, None))
                        except OSError as err:
                            out.append(("file", e.path, rel, None, None, str(err)))
                        if len(out) >= chunk_rows:
                            yield pd.DataFrame(out, columns=cols)
                            out = []
        if out:
            yield pd.DataFrame(out, columns=cols)
    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """S1 metadata: breadth-first listing where every level is listed on the executors.

    The frontier (directories still to list) is a DataFrame repartitioned across
    the cluster each round; file rows of every level are written under the
    checkpoint folder, so no listing passes through the driver.  Rounds go on
    until a level holds no directory.
    """
    from codeloom.session import scratch_path
    from codeloom.sources.tables import parallelism
    root = os.path.realpath(posix_path(root))
    out = scratch_path(spark, "listing")
    frontier = spark.createDataFrame([("",)], "relative string")
    n = parallelism(spark)
    for level in itertools.count():
        listed = frontier.repartition(n).mapInPandas(_list_level(root), LISTING_SCHEMA)
        path = f"{out}/level={level}"
        listed.write.parquet(path)
        frontier = spark.read.parquet(path).filter(F.col("kind") == "dir").select("relative")
        if frontier.isEmpty():
            break
    rows = spark.read.parquet(out).filter(F.col("kind") != "dir").drop("level")
    return rows.select(
        "path", "relative", "size",
        F.when(F.col("mtime").isNotNull(), F.timestamp_micros((F.col("mtime") * 1_000_000).cast("bigint")))
        .alias("mtime"),
        "error")


def _reader(max_size: int | None, budget_bytes: int = 64 * 1024 * 1024):
    """Executors: read file contents, yielding a frame whenever ~``budget_bytes`` are buffered."""
    def run(batches):
        import pandas as pd
        rows, held = [], 0
        for pdf in batches:
            for rec in pdf.itertuples(index=False):
                data, err = None, rec.error
                if err is None and (max_size is None or (rec.size is not None and rec.size <= max_size)):
                    try:
                        with open(rec.path, "rb") as fh:
                            data = fh.read()
                    except OSError as e:
                        err = str(e)
                rows.append((rec.path, rec.relative, rec.size, rec.mtime, data, err))
                held += len(data) if data else 0
                if held >= budget_bytes:
                    yield pd.DataFrame(rows, columns=["path", "relative", "size", "mtime", "content", "error"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "relative", "size", "mtime", "content", "error"])
    return run


def scan_tree(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None,
              max_size: int | None = None, target_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """S1 at scale: distributed listing, path filters as Spark predicates (F1/F2),
    contents read on executors in partitions of about ``target_bytes``."""
    from codeloom.operators.filters import exclude_matches, include_matches
    meta = list_files(spark, root)
    if exclude:
        meta = meta.filter(~exclude_matches("relative", exclude))
    if include:
        meta = meta.filter(include_matches("relative", include))
    total = meta.agg(F.sum("size")).first()[0] or 0
    n = int(total // target_bytes) + 1
    from codeloom.sources.tables import parallelism
    n = max(n, parallelism(spark))
    return meta.repartition(n, "path").mapInPandas(_reader(max_size), SCHEMA)
