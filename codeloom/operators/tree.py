"""Directory tree views of descriptions.

A file is its own node: descriptions are neither aggregated nor exploded.
Directories are the distinct parents of files and the prefixes of these, so
only directory paths are multiplied by their depth.  Sibling order needs only
"am I the last child": ``max(name)`` per parent, map-side combined, so no
window has to hold a whole directory.  The bars in front of a node are those
of its directory, computed once per directory and passed to all its children
by the same join on the parent.  Skewed join keys are left to AQE's skew-join
splitting; the per-parent side holds one row per key.

Renderers emit ``(node, phase, entry)`` rows: phase 0 before a node's
children, 1 after them.  ``sort_key`` orders a document: a node's parts array
for phase 0 and the parts plus a maximal sentinel for phase 1, so children
fall between the two.  Entries never hold more than one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.filters import long_functions
from codeloom.session import materialize

# ---------------------------------------------------------------------------
# Tree drawing characters and empty-tree messages.
# ---------------------------------------------------------------------------
BRANCH, LAST_BRANCH = "├── ", "└── "
BAR, BLANK = "│   ", "    "
EMPTY_PLAIN, EMPTY_JSON, EMPTY_XML = "No matching files found.", "[]", "<files />"
# ANSI styles of the colour view: dim tree lines, bold green files, bold red
# failed files, bold cyan directories.
ANSI_DIM, ANSI_FILE, ANSI_ERROR, ANSI_DIR, ANSI_RESET = "\x1b[90m", "\x1b[1;32m", "\x1b[1;31m", "\x1b[1;36m", "\x1b[0m"
# ---------------------------------------------------------------------------
AFTER_ALL = "\U0010ffff"


def tree_nodes(desc: DataFrame, long_threshold: int = T.LONG_THRESHOLD) -> DataFrame:
    """A3: one row per node: node, parent, name, depth, parts, has_children, d (description or null)."""
    d = F.struct(
        F.col("total_lines").cast("bigint").alias("total_lines"),
        F.col("text").alias("text"),
        F.col("error").alias("error"),
        F.col("symbols").alias("symbols"),
        F.size(long_functions("functions", long_threshold)).cast("bigint").alias("n_long"))
    # read several times (files, directories): written once, descriptions computed once
    files = materialize(desc.select(F.col("relative").alias("node"), d.alias("d")), "tree-files")
    parents = files.select(_parent("node").alias("node")).where(F.col("node") != "").distinct()
    dirs = materialize(parents.select(F.explode(_prefixes(F.split("node", "/"))).alias("node")).distinct(), "tree-dirs")
    # a path that is a file and also the directory of others (not in a real tree) stays one node
    both = files.select("node").join(dirs, "node", "left_semi").distinct()
    files = files.join(both.withColumn("inner", F.lit(True)), "node", "left")
    none = F.lit(None).cast(files.schema["d"].dataType).alias("d")
    rows = files.select("node", "d", F.coalesce("inner", F.lit(False)).alias("has_children")).unionByName(
        dirs.join(both, "node", "left_anti").select("node", none, F.lit(True).alias("has_children")))
    parts = F.split("node", "/")
    return rows.select("node", _parent("node").alias("parent"), F.substring_index("node", "/", -1).alias("name"),
                       F.size(parts).alias("depth"), parts.alias("parts"), "has_children", "d")


def _parent(node: str) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_extract(node, r"(?s)^(.*)/", 1)


def _prefixes(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def sibling_order(nodes: DataFrame) -> DataFrame:
    """Adds ``is_last`` (last child of its parent in byte order of names)."""
    return _with_last(nodes, _last_names(nodes))


def _last_names(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("parent").agg(F.max("name").alias("_last_name"))


def _with_last(nodes: DataFrame, per_parent: DataFrame) -> DataFrame:
    return nodes.join(per_parent, "parent").withColumn("is_last", F.col("name") == F.col("_last_name")).drop("_last_name")


def _with_bars(nodes: DataFrame) -> DataFrame:
    """Adds ``is_last`` and ``prefix``, the bars and blanks of a node's ancestors."""
    last = _last_names(nodes)
    dirs = _with_last(nodes.filter("has_children").select("node", "parent", "name", "parts"), last)
    above = dirs.select("node", F.posexplode(_prefixes(F.col("parts"))).alias("i", "above"))
    own = dirs.select(F.col("node").alias("above"), F.when(F.col("is_last"), F.lit(BLANK)).otherwise(F.lit(BAR)).alias("bar"))
    bars = above.join(own, "above").groupBy(F.col("node").alias("parent")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "bar"))), lambda x: x["bar"]), "").alias("prefix"))
    return _with_last(nodes, last.join(bars, "parent", "left")).withColumn("prefix", F.coalesce("prefix", F.lit("")))


def _root(nodes: DataFrame) -> DataFrame:
    """The root row (depth 0), present when there is at least one node."""
    return nodes.filter(F.col("depth") == 1).agg(F.count("*").alias("n")).filter(F.col("n") > 0).select(
        F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"),
        F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"),
        F.lit(True).alias("has_children"), F.lit(None).cast(nodes.schema["d"].dataType).alias("d"),
        F.lit(True).alias("is_last"))


def sort_key(parts: Column, phase: Column) -> Column:
    return F.when(phase == 0, parts).otherwise(F.concat(parts, F.array(F.lit(AFTER_ALL))))


def _with_empty(entries: DataFrame, nodes: DataFrame, message: str) -> DataFrame:
    empty = nodes.agg(F.count("*").alias("n")).filter(F.col("n") == 0).select(
        F.lit("").alias("node"), F.lit(0).alias("phase"), F.lit(message).alias("entry"))
    return entries.unionByName(empty)


# ------------------------------------------------------------------ D4 plain

def _extras(no_long_indicator: bool) -> Column:
    d = F.col("d")
    parts = [F.when(d["total_lines"].isNotNull(), F.concat(F.lit("["), d["total_lines"].cast("string"), F.lit(" lines]"))),
             F.when((d["text"] != "") & (d["text"] != T.NO_SYMBOLS), F.concat(F.lit("("), d["text"], F.lit(")")))]
    if not no_long_indicator:
        parts.append(F.when(d["n_long"] > 0, F.concat(F.lit("(long: "), d["n_long"].cast("string"), F.lit(")"))))
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined))


def materialized_nodes(desc: DataFrame) -> DataFrame:
    """The node table: every renderer reads it several times (siblings, ancestors, root,
    emptiness), from the files and directories that ``tree_nodes`` writes once."""
    return tree_nodes(desc)


def _paint(style: str, c: Column) -> Column:
    return F.concat(F.lit(style), c, F.lit(ANSI_RESET))


def tree_plain(desc: DataFrame, max_depth: int | None = None, no_long_indicator: bool = False,
               color: bool = False) -> DataFrame:
    """D4 (+W4: levels <= max_depth + 1 are printed); ``color`` adds the terminal styles."""
    nodes = _with_bars(materialized_nodes(desc))
    if max_depth is not None:
        nodes = nodes.filter(F.col("depth") <= max_depth + 1)
    prefix = F.col("prefix")
    connector = F.when(F.col("is_last"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH))
    name = F.col("name")
    if color:
        prefix, connector = _paint(ANSI_DIM, prefix), _paint(ANSI_DIM, connector)
        file_name = F.when(F.col("d.error").isNotNull(), _paint(ANSI_ERROR, name)).otherwise(_paint(ANSI_FILE, name))
        dir_name = _paint(ANSI_DIR, name)
    else:
        file_name = dir_name = name
    out = nodes.select(
        "node",
        F.lit(0).alias("phase"),
        F.concat(prefix, connector,
                 F.when(F.col("d").isNotNull(), F.concat(file_name, _extras(no_long_indicator)))
                 .otherwise(F.concat(dir_name, F.lit("/")))).alias("entry"))
    return _with_empty(out, nodes, EMPTY_PLAIN)


def _description(d: Column) -> Column:
    """All symbols; without any, the description's own text (a model's answer), but for errors."""
    text = F.when(d["error"].isNull(), F.coalesce(d["text"], F.lit(T.NO_SYMBOLS))).otherwise(F.lit(T.NO_SYMBOLS))
    return F.when(F.size(d["symbols"]) == 0, text).otherwise(F.array_join(d["symbols"], ", "))


# ------------------------------------------------------------------ D6 xml

def tree_xml(desc: DataFrame, max_depth: int | None = None) -> DataFrame:
    """<directory> around children, <file> leaves; level max+1 becomes a truncated stub."""
    nodes = materialized_nodes(desc)
    allnodes = nodes.withColumn("is_last", F.lit(False)).unionByName(_root(nodes))
    if max_depth is not None:
        allnodes = allnodes.filter(F.col("depth") <= max_depth + 1)
    name = T.xml_attr_escape("name")
    d = F.col("d")
    full = _description(d)
    file_el = F.concat(F.lit('<file name="'), name, F.lit('" description="'), T.xml_attr_escape(full),
                       F.lit('" long_functions="'), d["n_long"].cast("string"), F.lit('" total_lines="'),
                       F.coalesce(d["total_lines"], F.lit(0)).cast("string"), F.lit('" />'))
    stub = F.concat(F.lit('<file name="'), name, F.lit('" truncated="true" />'))
    opened = F.concat(F.lit('<directory name="'), name, F.lit('">'))
    truncated = F.lit(max_depth is not None) & (F.col("depth") > F.lit(max_depth if max_depth is not None else 0))
    first = (F.when(truncated, stub).when(F.col("has_children"), opened)
             .when(d.isNotNull(), file_el).otherwise(F.concat(F.lit('<file name="'), name, F.lit('" />'))))
    opens = allnodes.select("node", F.lit(0).alias("phase"), first.alias("entry"))
    closes = allnodes.filter(F.col("has_children") & ~truncated).select(
        "node", F.lit(1).alias("phase"),
        # print_xml adds one more newline after the whole buffer
        F.when(F.col("depth") == 0, F.lit("</directory>\n")).otherwise(F.lit("</directory>")).alias("entry"))
    return _with_empty(opens.unionByName(closes), nodes, EMPTY_XML)


# ------------------------------------------------------------------ D5 json

def _indent(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def tree_json(desc: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Pretty JSON, keys in sorted order; JSON depth = tree level + 1."""
    base = materialized_nodes(desc)
    nodes = sibling_order(base).unionByName(_root(base))
    jdepth = F.col("depth") + 1
    if max_depth is not None:
        nodes = nodes.filter(jdepth <= max_depth + 1)
        truncated = jdepth > F.lit(max_depth)
    else:
        truncated = F.lit(False)
    ind = F.col("depth") * 4
    i0, i1, i2 = _indent(ind), _indent(ind + 2), _indent(ind + 4)
    comma = F.when(F.col("is_last"), F.lit("")).otherwise(F.lit(","))
    d = F.col("d")
    has_d = d.isNotNull()
    name = T.json_string("name")
    stub = F.concat(i0, F.lit("{\n"), i1, F.lit('"name": '), name, F.lit(",\n"), i1,
                    F.lit('"truncated": true\n'), i0, F.lit("}"), comma)
    full = _description(d)
    symbols = F.when(F.size(d["symbols"]) == 0, F.concat(i1, F.lit('"symbols": []'))).otherwise(
        F.concat(i1, F.lit('"symbols": [\n'),
                 F.array_join(F.transform(d["symbols"], lambda s: F.concat(i2, T.json_string(s))), ",\n"),
                 F.lit("\n"), i1, F.lit("]")))
    tail_keys = F.concat_ws(
        ",\n",
        F.when(has_d, F.concat(i1, F.lit('"description": '), T.json_string(full))),
        F.when(has_d & d["error"].isNotNull(), F.concat(i1, F.lit('"error": '), T.json_string(d["error"]))),
        F.concat(i1, F.lit('"name": '), name),
        F.when(has_d, symbols))
    open_entry = F.when(truncated, stub).when(
        F.col("has_children"), F.concat(i0, F.lit("{\n"), i1, F.lit('"children": ['))).otherwise(
        F.concat(i0, F.lit("{\n"), tail_keys, F.lit("\n"), i0, F.lit("}"), comma))
    close_entry = F.concat(i1, F.lit("],\n"), tail_keys, F.lit("\n"), i0, F.lit("}"), comma)
    opens = nodes.select("node", F.lit(0).alias("phase"), open_entry.alias("entry"))
    closes = nodes.filter(F.col("has_children") & ~truncated).select(
        "node", F.lit(1).alias("phase"), close_entry.alias("entry"))
    return _with_empty(opens.unionByName(closes), nodes.filter(F.col("depth") > 0), EMPTY_JSON)


def write_tree(entries: DataFrame, path: str) -> None:
    """Sink: order by (parts, phase) so children land between a node's open and close."""
    (entries.select(sort_key(F.when(F.col("node") == "", F.array().cast("array<string>"))
                             .otherwise(F.split("node", "/")), F.col("phase")).alias("k"), "entry")
     .orderBy("k").select("entry").write.mode("overwrite").text(path))
