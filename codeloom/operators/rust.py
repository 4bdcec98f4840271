"""Rust items and function spans as a windowed token job.

Rust is analysed structurally in the reference (an AST visitor).  Here the same
facts come from a token stream and window functions:

1. ``codeloom.operators.rust_scan`` gives the text without comments and literals,
   in chunks; one ``regexp_replace`` puts marks around doc comments, attributes, macro
   openers, impl headers, item keywords and ``{ } ; [ ]``, and a split turns it into
   tokens, each with the newlines up to the next, before the one shuffle by path;
2. running windows over (path, pos): line number, brace depth, bracket depth,
   the last delimiter before each token (its *segment*) and whether a token is
   the first item keyword of its segment (the item *head*);
3. a (path, segment) window: the head's kind, the item's first line (doc
   comments and attributes included) and how the segment ends;
4. (path, level) windows: which block encloses a head, and the line of the
   ``}`` that closes each ``{``;
5. a running window marks tokens inside macro bodies, which are opaque.

Rows are hash-partitioned by path once (one shuffle of tokens); every later
window is keyed by path (plus a sub-key) and reuses that partitioning.  Cutting,
cleaning and tokens of one file run in many tasks; its windows in one, over
sorted rows that spill.

Accepted divergences from a real parser: parenthesised macros holding items, ``{`` inside
``impl`` headers, files that balance yet do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.rust_scan import clean_chunks

ITEM_KEYWORDS = ("fn", "struct", "enum", "trait", "type", "const", "mod", "static", "union")
SYMBOL_KINDS = ("fn", "struct", "enum", "trait", "type", "const", "impl")

# tokens of cleaned text
TOKEN = "(?U)(" + "|".join([
    r"///",                                                 # outer doc comment
    r"\"",                                                  # string or character literal
    r"#!?\[\]",                                             # attribute
    r"\b\w++!\s*+(?:\w++\s*+)?\{",                          # brace macro opener
    r"\bimpl\b[^{;]*+",                                     # whole impl header
    r"\bconst(?=\s++(?:fn|unsafe|async|extern)\b)",         # const as a modifier
    r"\b(?:" + "|".join(ITEM_KEYWORDS) + r")\s++(?:r#)?\w++",  # item keyword + name
    r"\b(?:pub|async|unsafe|extern)\b",                     # modifiers
    r"[{};\[\]]",
]) + ")"
BEGIN, END = "\x01", "\x02"


def _outside_angles(header: Column) -> Column:
    """The header with every ``<...>`` as a space, whatever its depth."""
    pieces = F.regexp_extract_all(header, F.lit("->|[<>]|[^<>-]++|-"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        depth = (F.when(piece == "<", state["depth"] + 1).when(piece == ">", F.greatest(state["depth"] - 1, F.lit(0)))
                 .otherwise(state["depth"]))
        kept = (F.when((state["depth"] > 0) | (piece == ">"), state["kept"]).when(piece == "<", F.concat(state["kept"], F.lit(" ")))
                .otherwise(F.concat(state["kept"], piece)))
        return F.struct(depth.alias("depth"), kept.alias("kept"))
    return F.aggregate(pieces, start, step, lambda state: state["kept"])


def impl_name(header: Column) -> Column:
    """'impl<T> a::Trait<T> for X<T> where ...' -> 'Trait'; inherent impls -> the type."""
    h = F.regexp_replace(_outside_angles(header), r"(?s)^impl\s*", "")
    h = F.regexp_replace(h, r"(?s)\s+where\b.*$", "")
    h = F.regexp_replace(h, r"(?s)\s+for\b.*$", "")
    h = F.regexp_replace(h, r"(?U)^[!\s]+|\s+$", "")
    return F.regexp_replace(F.substring_index(h, "::", -1), r"(?U)^\s+|\s+$", "")


def _tokens(files: DataFrame, n: int, carry: str | None = None) -> DataFrame:
    extra = [carry] if carry else []
    chunks = clean_chunks(files.select("path", "content", *extra), extra, n)
    marked = F.regexp_replace("text", TOKEN, f"{BEGIN}$1{END}")

    def newlines(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    # the first element is the text before the first token
    parts = F.transform(F.split(marked, BEGIN), lambda x, i: F.struct(
        F.when(i > 0, F.substring_index(x, END, 1)).alias("t"), newlines(x).alias("nl")))
    # An explicit partition count: AQE would otherwise coalesce this shuffle by
    # its (small) byte size, although every byte expands into many token rows.
    sent = chunks.select("path", *extra, "chunk", parts.alias("parts")).repartition(n, "path")
    toks = sent.select("path", *extra, "chunk", F.posexplode_outer("parts").alias("i", "z"))
    t = F.col("t")
    first_row = F.coalesce("i", F.lit(0)) == 0
    toks = toks.select("path", (F.shiftleft(F.col("chunk").cast("long"), 32) + F.coalesce("i", F.lit(0))).alias("pos"),
                       *([F.when(first_row, F.col(carry)).alias("_carry")] if carry else []),
                       F.col("z.t").alias("t"), F.coalesce("z.nl", F.lit(0)).alias("nl"))
    c1 = F.substring(t, 1, 1)
    # constant checks only: literals are one mark, macro openers end in '{', modifiers are a
    # fixed word set, everything else is an item head
    cls = (F.when(t.isNull(), F.lit("none"))
           .when(t == "///", F.lit("doc"))
           .when(t == "{", F.lit("open"))
           .when(t == "}", F.lit("close"))
           .when(t == ";", F.lit("semi"))
           .when(t == "[", F.lit("lb"))
           .when(t == "]", F.lit("rb"))
           .when(t == "#![]", F.lit("iattr"))
           .when(c1 == "#", F.lit("attr"))
           .when(t == '"', F.lit("str"))
           .when(t.endswith("{"), F.lit("macro"))
           .when(t.isin("pub", "async", "unsafe", "extern", "const"), F.lit("mod"))
           .when(t.startswith("impl"), F.lit("impl"))
           .otherwise(F.lit("item")))
    kind = (F.when(cls == "impl", F.lit("impl"))
            .when(cls == "item", F.regexp_extract(t, r"^(\w+)", 1)))
    name = (F.when(cls == "impl", impl_name(t))
            .when(cls == "item", F.regexp_extract(t, r"^\w+\s+((?:r#)?\w+)$", 1)))
    return toks.select("path", "pos", *(["_carry"] if carry else []), cls.alias("cls"), kind.alias("kind"), name.alias("name"),
                       (t == "extern").alias("is_extern"), "nl")


def rust_items(files: DataFrame, num_partitions: int | None = None, carry: str | None = None) -> DataFrame:
    """files(path, content) of Rust sources -> (path, symbols array<string>,
    functions array<struct<name string, lines bigint>>, parsed boolean).

    Rows whose content is null pass through as a single row.  ``carry`` names a
    column kept (once per file) and returned, so callers need no join back.
    """
    spark = files.sparkSession
    n = num_partitions or max(spark.sparkContext.defaultParallelism,
                              int(spark.conf.get("spark.sql.shuffle.partitions")))
    tk = _tokens(files, n, carry)
    keep_carry = F.col("_carry").isNotNull() if carry else F.lit(False)

    cls = F.col("cls")
    by_path = Window.partitionBy("path").orderBy("pos")
    prev = by_path.rowsBetween(Window.unboundedPreceding, -1)

    # pass 1 (every token): line numbers, depths, segments, item heads
    is_opener = cls.isin("open", "macro")
    delta = F.when(is_opener, 1).when(cls == "close", -1).otherwise(0)
    bdelta = F.when(cls == "lb", 1).when(cls == "rb", -1).otherwise(0)
    tk = tk.select(
        "*",
        delta.alias("delta"),
        (F.lit(1) + F.coalesce(F.sum("nl").over(prev), F.lit(0))).alias("line"),
        F.coalesce(F.sum(delta).over(prev), F.lit(0)).alias("before"),
        F.coalesce(F.sum(bdelta).over(prev), F.lit(0)).alias("bdepth"),
    )
    is_delim = is_opener | cls.isin("close", "iattr") | ((cls == "semi") & (F.col("bdepth") == 0))
    is_kw = cls.isin("item", "impl")
    tk = tk.select(
        "*",
        is_delim.alias("is_delim"),
        F.coalesce(F.max(F.when(is_delim, F.col("pos"))).over(prev), F.lit(-1)).alias("seg"),
        F.max(F.when(is_kw, F.col("pos"))).over(prev).alias("last_kw"),
    )
    tk = tk.withColumn("is_head", is_kw & (F.col("last_kw").isNull() | (F.col("last_kw") < F.col("seg"))))

    # whole-file checks (balanced braces, never below zero), carried on every row
    whole = Window.partitionBy("path")
    tk = tk.withColumn("bad", (F.sum("delta").over(whole) != 0)
                       | (F.min(F.col("before") + F.col("delta")).over(whole) < 0))

    # pass 2 (delimiters and significant tokens): what each segment's head is and where it starts/ends
    significant = cls.isin("doc", "attr", "mod", "str", "item", "impl")
    tk = tk.filter(F.col("is_delim") | significant | keep_carry)
    by_seg = Window.partitionBy("path", "seg")
    tk = tk.select(
        "*",
        F.max(F.when(F.col("is_head"), F.col("kind"))).over(by_seg).alias("seg_kind"),
        F.min(F.when(significant, F.col("line"))).over(by_seg).alias("seg_line"),
        F.max(F.when(F.col("is_delim"), cls)).over(by_seg).alias("end_cls"),
        F.max(F.when(F.col("is_delim"), F.col("pos"))).over(by_seg).alias("end_pos"),
        F.max(F.col("is_extern")).over(by_seg).alias("seg_extern"),
    )

    # pass 3 (braces and heads): enclosing block of each head, opener matched by each closer
    tk = tk.filter(is_opener | (cls == "close") | F.col("is_head") | keep_carry)
    level = F.when(is_opener, F.col("before") + 1).otherwise(F.col("before"))
    tk = tk.withColumn("level", level)
    block_kind = (F.when(cls == "macro", F.lit("macro"))
                  .when((cls == "open") & F.col("seg_kind").isNull() & F.col("seg_extern"), F.lit("extern"))
                  .when(cls == "open", F.coalesce(F.col("seg_kind"), F.lit("block"))))
    by_level = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tk = tk.select(
        "*",
        F.coalesce(F.last(block_kind, ignorenulls=True).over(by_level), F.lit("file")).alias("encl_kind"),
        F.last(F.when(is_opener, F.col("pos")), ignorenulls=True).over(by_level).alias("open_pos"),
    )

    # pass 4 (macro openers, closers, heads): macro extents and closing lines of bodies
    tk = tk.filter((cls == "macro") | (cls == "close") | F.col("is_head") | keep_carry)
    macro_delta = (F.when(cls == "macro", 1)
                   .when((cls == "close") & (F.col("encl_kind") == "macro"), -1).otherwise(0))
    match_key = F.when(cls == "close", F.col("open_pos")).when(F.col("is_head"), F.col("end_pos"))
    tk = tk.select(
        "*",
        (F.coalesce(F.sum(macro_delta).over(prev), F.lit(0)) > 0).alias("in_macro"),
        match_key.alias("match_key"))
    tk = tk.withColumn("end_line", F.max(F.when(cls == "close", F.col("line")))
                       .over(Window.partitionBy("path", "match_key")))

    kind = F.col("kind")
    keep = (F.col("is_head") & ~F.col("in_macro") & kind.isin(*SYMBOL_KINDS)
            & (F.col("encl_kind") != "extern")                      # foreign items are not visited
            & ~(kind.isin("fn", "const", "type") & (F.col("encl_kind") == "trait"))
            & ~(kind.isin("const", "type") & (F.col("encl_kind") == "impl")))
    is_fn = keep & (kind == "fn") & (F.col("end_cls") == "open") & F.col("end_line").isNotNull()
    sym = F.when(keep, F.struct(F.col("pos"), F.concat(kind, F.lit(" "), F.col("name")).alias("s")))
    fn = F.when(is_fn, F.struct(F.col("pos"), F.col("name").alias("name"),
                                (F.col("end_line") - F.col("seg_line") + 1).cast("bigint").alias("lines")))
    out = tk.groupBy("path").agg(
        F.array_sort(F.collect_list(sym)).alias("_s"),
        F.array_sort(F.collect_list(fn)).alias("_f"),
        F.max("bad").alias("_bad"),
        *([F.first("_carry", ignorenulls=True).alias(carry)] if carry else []))
    parsed = ~F.coalesce(F.col("_bad"), F.lit(False))
    empty_s = F.array().cast("array<string>")
    empty_f = F.array().cast("array<struct<name:string,lines:bigint>>")
    s_list = F.coalesce(F.transform("_s", lambda x: x["s"]), empty_s)
    f_list = F.coalesce(F.transform("_f", lambda x: F.struct(x["name"].alias("name"), x["lines"].alias("lines"))),
                        empty_f)
    return out.select(
        "path", *([carry] if carry else []),
        F.when(parsed, F.array_distinct(s_list)).otherwise(empty_s).alias("symbols"),
        F.when(parsed, f_list).otherwise(empty_f).alias("functions"),
        parsed.alias("parsed"),
    )
