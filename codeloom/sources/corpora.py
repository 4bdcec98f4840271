"""File tables rendered from the test tables (fixtures V1-V8).

Every corpus is a *file table*: ``path, relative, size, mtime, content``.
Texts are rendered from table rows with SQL expressions that Spark and DuckDB
evaluate identically (``chr(10)``, ``repeat``, ``concat`` via ``||``, ``CASE``),
so an independent engine can rebuild the same bytes.  The per-row block
templates are plain SQL text kept in this module; the DuckDB side is in
``codeloom.plans.oracle``.

Scale: a file is the group of one (language, brand, chunk of 1000 part keys),
so file sizes stay bounded when the part table grows; grouping is the only
shuffle and it aggregates narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import parallelism, read_table, spread

NL = "chr(10)"
EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
PART_CHUNK = 1000


def _s(x: str) -> str:
    return f"cast({x} as string)"


def _body(indent: str, cmt: str) -> str:
    return f"repeat('{indent}{cmt} ' || p_name || {NL}, p_size)"


def _deep(block: str) -> str:
    """``block`` in some of the blocks only: one part key of fifty."""
    return f"CASE WHEN p_partkey % 50 IN (1, 2) THEN {block} ELSE '' END"


K = _s("p_partkey")
S = _s("p_size")

# One SQL CASE per language: the block of text that part row renders to.
CODE_TEMPLATES: dict[str, str] = {
    "rs": f"""CASE p_partkey % 4
      WHEN 0 THEN 'fn f_' || {K} || '() {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      WHEN 1 THEN 'struct S' || {K} || ';' || {NL} || 'impl' || {_deep("'<T: ' || repeat('A<[u8; 2], ', 100) || 'u8' || repeat('>', 100) || '>'")}
               || ' S' || {K} || ' {{' || {NL}
               || '    pub fn m_' || {K} || '(&self) {{' || {NL} || {_body('        ', '//')} || '    }}' || {NL} || '}}' || {NL}
      WHEN 2 THEN {_deep("repeat('/* enum N { ', 100) || repeat('*/ ', 100)")} || 'enum E' || {K} || ' {{ A, B }}' || {NL}
               || {_deep("'#[a' || repeat('[b', 100) || repeat(']', 100) || '] '")} || 'trait T' || {K} || ' {{' || {NL}
               || '    fn t_' || {K} || '(&self);' || {NL} || '}}' || {NL}
      ELSE 'const C_' || {K} || ': u32 = ' || {S} || ';' || {NL} || 'type A' || {K} || ' = u32;' || {NL}
               || '/// doc ' || p_name || {NL} || '#[inline]' || {NL} || 'fn g_' || {K} || '() {{' || {NL}
               || {_body('    ', '//')} || '}}' || {NL}
    END""",
    "py": f"""CASE p_partkey % 3
      WHEN 0 THEN 'def f_' || {K} || '(x):' || {NL} || {_body('    ', '#')}
      WHEN 1 THEN 'class C' || {K} || ':' || {NL} || '    async def a_' || {K} || '(self):' || {NL} || {_body('        ', '#')}
      ELSE 'LIMIT_' || {K} || ' = ' || {S} || {NL}
    END""",
    "js": f"""CASE p_partkey % 4
      WHEN 0 THEN 'function f_' || {K} || '(a) {{' || {NL} || {_body('  ', '//')} || '}}' || {NL}
      WHEN 1 THEN 'class C' || {K} || ' {{' || {NL} || {_body('  ', '//')} || '}}' || {NL}
      WHEN 2 THEN 'const K_' || {K} || ' = ' || {S} || ';' || {NL}
      ELSE 'let v_' || {K} || ' = ' || {S} || ';' || {NL}
    END""",
    "go": f"""CASE p_partkey % 3
      WHEN 0 THEN 'func F' || {K} || '(a int) int {{' || {NL} || {_body('    ', '//')} || '    return a' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'type T' || {K} || ' struct {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      ELSE 'const C' || {K} || ' = ' || {S} || {NL}
    END""",
    "java": f"""CASE p_partkey % 3
      WHEN 0 THEN 'public class C' || {K} || ' {{' || {NL} || '    private static int m' || {K} || '(int a) {{' || {NL}
               || {_body('        ', '//')} || '        return a;' || {NL} || '    }}' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'interface I' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      ELSE 'enum E' || {K} || ' {{ A, B }}' || {NL}
    END""",
    "c": f"""CASE p_partkey % 3
      WHEN 0 THEN 'int f_' || {K} || '(int a) {{' || {NL} || {_body('    ', '//')} || '    return a;' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'struct S' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}};' || {NL}
      ELSE 'enum E' || {K} || ' {{ A, B }};' || {NL}
    END""",
    "cpp": f"""CASE p_partkey % 3
      WHEN 0 THEN 'static int f_' || {K} || '(int a) {{' || {NL} || {_body('    ', '//')} || '    return a;' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'class K' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}};' || {NL}
      ELSE 'struct S' || {K} || ' {{ int a; }};' || {NL}
    END""",
    "cs": f"""CASE p_partkey % 3
      WHEN 0 THEN 'public class C' || {K} || ' {{' || {NL} || '    public int Run' || {K} || '(int a) {{' || {NL}
               || '        if (a > 0) {{' || {NL} || {_body('            ', '//')} || '        }}' || {NL}
               || '        return a;' || {NL} || '    }}' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'internal interface I' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      ELSE 'public struct S' || {K} || ' {{ }}' || {NL} || 'enum E' || {K} || ' {{ A, B }}' || {NL}
    END""",
    "rb": f"""CASE p_partkey % 3
      WHEN 0 THEN 'def f_' || {K} || '(a)' || {NL} || {_body('  ', '#')} || 'end' || {NL}
      WHEN 1 THEN 'class C' || {K} || {NL} || {_body('  ', '#')} || 'end' || {NL}
      ELSE 'module M' || {K} || {NL} || 'end' || {NL}
    END""",
    "swift": f"""CASE p_partkey % 4
      WHEN 0 THEN 'func f_' || {K} || '(a: Int) -> Int {{' || {NL} || {_body('    ', '//')} || '    return a' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'public struct S' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      WHEN 2 THEN 'private class C' || {K} || ' {{' || {NL} || '}}' || {NL}
      ELSE 'protocol P' || {K} || ' {{' || {NL} || '}}' || {NL}
    END""",
    "kt": f"""CASE p_partkey % 3
      WHEN 0 THEN 'fun f_' || {K} || '(a: Int): Int {{' || {NL} || {_body('    ', '//')} || '    return a' || {NL} || '}}' || {NL}
      WHEN 1 THEN 'internal object O' || {K} || ' {{' || {NL} || {_body('    ', '//')} || '}}' || {NL}
      ELSE 'enum class E' || {K} || ' {{ A, B }}' || {NL}
    END""",
}
CODE_LANGUAGES = list(CODE_TEMPLATES)


def code_block_sql() -> str:
    """CASE over the language column ``lang`` choosing the block template."""
    whens = "\n".join(f"  WHEN '{lang}' THEN {tpl}" for lang, tpl in CODE_TEMPLATES.items())
    return f"CASE lang\n{whens}\nEND"


# relative path / file key of a (part row, language)
CODE_RELATIVE_SQL = ("'code/' || lang || '/brand' || lpad(replace(p_brand, 'Brand#', ''), 2, '0')"
                     f" || '/chunk' || cast(p_partkey div {PART_CHUNK} as string) || '.' || lang")
DOC_EXTS_SQL = "CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' ELSE 'log' END"
DOC_RELATIVE_SQL = f"source || '/' || lang || '/doc_' || cast(doc_id as string) || '.' || {DOC_EXTS_SQL}"
CHAT_RELATIVE_SQL = "'chats/conv_' || lpad(cast(conv_id as string), 5, '0') || '.md'"
CHAT_BLOCK_SQL = f"'## ' || role || ' ' || cast(turn as string) || {NL} || {NL} || text || {NL} || {NL}"
PAGE_RELATIVE_SQL = ("'web/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
                     " || '/page_' || cast(page_id as string) || '.html'")


def _file_table(df: DataFrame, mtime_seconds) -> DataFrame:
    return df.select(
        F.concat(F.lit("/corpus/"), F.col("relative")).alias("path"),
        F.col("relative"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.timestamp_seconds(mtime_seconds).alias("mtime"),
        F.col("content"),
    )


def code_files(spark: SparkSession, sf_dir: str, languages: list[str] | None = None) -> DataFrame:
    """V1: one file per (language, brand, 1000-key chunk); one construct per part."""
    langs = languages or CODE_LANGUAGES
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    rows = (part.select("*", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
            .select(F.expr(CODE_RELATIVE_SQL).alias("relative"), "p_partkey",
                    F.expr(code_block_sql()).alias("block")))
    files = rows.repartition(parallelism(spark), "relative").groupBy("relative").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))),
                                 lambda x: x["block"]), "").alias("content"),
        F.max("p_partkey").alias("kmax"),
    )
    return _file_table(files, F.lit(EPOCH_2024) + F.col("kmax"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one file per document; text as is."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return _file_table(docs.select(F.expr(DOC_RELATIVE_SQL).alias("relative"), "doc_id",
                                   F.col("text").alias("content")),
                       F.lit(EPOCH_2024) + F.col("doc_id"))


# V8: documents with bytes spliced into the middle (or a NUL at the end), by doc_id % 6
SPLICES = {1: "C3", 2: "80", 3: "E282", 4: "C0AF"}
LATE_NUL = 5


def spliced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document files as bytes: plain, with invalid sequences of several kinds, or with a late NUL."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    kind = F.col("doc_id") % 6
    splice = F.when(kind == LATE_NUL, F.lit(""))
    for k, bytes_ in SPLICES.items():
        splice = splice.when(kind == k, F.lit(bytes_))
    content = F.concat(F.encode(F.substring(text, F.lit(1), half), "UTF-8"), F.unhex(F.coalesce(splice, F.lit(""))),
                       F.encode(F.substring(text, half + 1, F.char_length(text)), "UTF-8"),
                       F.when(kind == LATE_NUL, F.lit(b"\x00")).otherwise(F.lit(b"")))
    return docs.select(F.expr(DOC_RELATIVE_SQL).alias("relative"), content.alias("content")).select(
        F.concat(F.lit("/corpus/"), "relative").alias("path"), "relative", "content")


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one markdown file per conversation, a heading per turn."""
    conv = read_table(spark, sf_dir, "conversations")
    files = (conv.select(F.expr(CHAT_RELATIVE_SQL).alias("relative"), "conv_id", "turn",
                         F.expr(CHAT_BLOCK_SQL).alias("block"))
             .repartition(parallelism(spark), "relative").groupBy("relative", "conv_id").agg(
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))),
                                          lambda x: x["block"]), "").alias("content")))
    return _file_table(files, F.lit(EPOCH_2024) + F.col("conv_id"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: one html file per page under web/<host>/."""
    pages = spread(read_table(spark, sf_dir, "pages"))
    return _file_table(pages.select(F.expr(PAGE_RELATIVE_SQL).alias("relative"), "page_id",
                                    F.col("html").alias("content")),
                       F.lit(EPOCH_2024) + F.col("page_id"))


# V5: per region one toml, yaml and json file; per nation a table/key.
CONFIG_NATION_SQL = {
    "toml": f"'[' || lower(n_name) || ']' || {NL} || 'key = ' || cast(n_nationkey as string) || {NL}"
            f" || 'suppliers = ' || cast(n_supp as string) || {NL}",
    "yaml": f"lower(n_name) || ':' || {NL} || '  suppliers: ' || cast(n_supp as string) || {NL}",
    "json": f"'  \"' || n_name || '\": ' || cast(n_supp as string)",
}
CONFIG_HEAD_SQL = {
    "toml": f"'region = \"' || r_name || '\"' || {NL}",
    "yaml": f"'region: ' || r_name || {NL}",
    "json": f"'{{' || {NL}",
}
CONFIG_SEP = {"toml": "", "yaml": "", "json": "," + "\n"}
CONFIG_TAIL_SQL = {"toml": "''", "yaml": "''", "json": f"{NL} || '}}' || {NL}"}


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: per region one toml, yaml and json file; one block per nation (tables read once)."""
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier")
    n_supp = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_supp"))
    nat = (nation.join(n_supp, "n_nationkey", "left").fillna(0, ["n_supp"])
           .join(region, nation.n_regionkey == region.r_regionkey))
    fmts = ["toml", "yaml", "json"]

    def by_fmt(table: dict) -> F.Column:
        expr = None
        for fmt in fmts:
            e = F.expr(table[fmt])
            expr = F.when(F.col("fmt") == fmt, e) if expr is None else expr.when(F.col("fmt") == fmt, e)
        return expr

    per = (nat.select("r_regionkey", "r_name", "n_nationkey", "n_name", "n_supp",
                      F.explode(F.array(*[F.lit(f) for f in fmts])).alias("fmt"))
           .select("r_regionkey", "r_name", "fmt", "n_nationkey", by_fmt(CONFIG_NATION_SQL).alias("block"))
           .groupBy("r_regionkey", "r_name", "fmt").agg(
               F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "block"))),
                           lambda x: x["block"]).alias("blocks"))
           .select(F.concat(F.lit("config/"), F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_"))),
                            F.lit("."), F.col("fmt")).alias("relative"),
                   "r_regionkey",
                   F.concat(by_fmt(CONFIG_HEAD_SQL),
                            F.when(F.col("fmt") == "json", F.array_join("blocks", CONFIG_SEP["json"]))
                            .otherwise(F.array_join("blocks", "")),
                            by_fmt(CONFIG_TAIL_SQL))
                   .alias("content")))
    return _file_table(per, F.lit(EPOCH_2024) + F.col("r_regionkey"))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus in one file table (the mixed tree)."""
    parts = [code_files(spark, sf_dir), doc_files(spark, sf_dir), chat_files(spark, sf_dir),
             page_files(spark, sf_dir), config_files(spark, sf_dir)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# V6: versions of results keyed (path, mode, params)
PATTERN_PARAMS = '{"exclude":"","include":"","version":1}'


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysed version per event: (path, mode, params, mtime_ms, text, event_id)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("/corpus/events/u"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit(".log")).alias("path"),
        F.col("event_type").alias("mode"),
        F.lit(PATTERN_PARAMS).alias("params"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
        .alias("_us"),
        F.col("props").alias("text"),
        "event_id",
    ).select("path", "mode", "params", F.floor(F.col("_us") / 1000).cast("bigint").alias("mtime_ms"),
             "text", "event_id")


# V7: two snapshots of the document files
def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rel = F.expr(DOC_RELATIVE_SQL)
    old = docs.filter(F.col("doc_id") % 10 != 0).select(rel.alias("relative"), F.col("text").alias("content"))
    new = docs.filter(F.col("doc_id") % 10 != 1).select(
        rel.alias("relative"),
        F.when(F.col("doc_id") % 7 == 0,
               F.concat(F.col("text"), F.lit("\nmodified "), F.col("doc_id").cast("string")))
        .otherwise(F.col("text")).alias("content"))
    return old, new
