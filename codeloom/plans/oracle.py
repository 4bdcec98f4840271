"""Independent DuckDB SQL for the correctness check.

The corpora are rebuilt from the same fixture SQL text (``codeloom.sources.corpora``)
by DuckDB.  Expected results are then computed a different way from Spark:
regex languages use DuckDB's RE2 engine with the reference's *original*
patterns (no JVM flags, no possessive rewrites), and Rust expectations come
in closed form from the part columns (symbol names from ``p_partkey``, spans
from ``p_size``), not from any parser.
"""

from __future__ import annotations

from codeloom.functions.patterns import LANGUAGE_PATTERNS
from codeloom.sources import corpora as C

SYMBOLS_SHOWN = 10


def _duck(sql: str) -> str:
    return sql.replace(" div ", " // ")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def code_files_cte(langs: list[str] | None = None) -> str:
    langs = langs or C.CODE_LANGUAGES
    lang_list = "[" + ", ".join(q(x) for x in langs) + "]"
    return f"""
code_blocks AS (
  SELECT {_duck(C.CODE_RELATIVE_SQL)} AS relative, p_partkey, p_size, p_name, lang,
         {_duck(C.code_block_sql())} AS block
  FROM part, (SELECT unnest({lang_list}) AS lang) l
),
code_files AS (
  SELECT '/corpus/' || relative AS path, relative, string_agg(block, '' ORDER BY p_partkey) AS content,
         max(p_partkey) AS kmax, any_value(lang) AS lang
  FROM code_blocks GROUP BY relative
)"""


def doc_files_cte(name: str = "doc_files") -> str:
    return f"""
{name} AS (
  SELECT '/corpus/' || ({C.DOC_RELATIVE_SQL}) AS path, {C.DOC_RELATIVE_SQL} AS relative,
         text AS content, doc_id AS kmax
  FROM documents
)"""


def chat_files_cte() -> str:
    return f"""
chat_files AS (
  SELECT '/corpus/' || relative AS path, relative,
         string_agg(block, '' ORDER BY turn) AS content, any_value(conv_id) AS kmax
  FROM (SELECT {C.CHAT_RELATIVE_SQL} AS relative, conv_id, turn, {C.CHAT_BLOCK_SQL} AS block FROM conversations)
  GROUP BY relative
)"""


def page_files_cte() -> str:
    return f"""
page_files AS (
  SELECT '/corpus/' || ({C.PAGE_RELATIVE_SQL}) AS path, {C.PAGE_RELATIVE_SQL} AS relative,
         html AS content, page_id AS kmax
  FROM pages
)"""


def config_files_cte() -> str:
    parts = []
    for fmt in ("toml", "yaml", "json"):
        sep = q(C.CONFIG_SEP[fmt]).replace("\n", "' || chr(10) || '")
        parts.append(f"""
  SELECT 'config/' || lower(replace(r_name, ' ', '_')) || '.{fmt}' AS relative, r_regionkey AS kmax,
         {C.CONFIG_HEAD_SQL[fmt]} || string_agg({C.CONFIG_NATION_SQL[fmt]}, {sep} ORDER BY n_nationkey)
           || {C.CONFIG_TAIL_SQL[fmt]} AS content
  FROM nat GROUP BY r_regionkey, r_name""")
    union = "\n  UNION ALL".join(parts)
    return f"""
nat AS (
  SELECT n.n_nationkey, n.n_name, r.r_regionkey, r.r_name, coalesce(s.n_supp, 0) AS n_supp
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT s_nationkey, count(*) AS n_supp FROM supplier GROUP BY s_nationkey) s
    ON s.s_nationkey = n.n_nationkey
),
config_files AS (
  SELECT '/corpus/' || relative AS path, relative, content, kmax FROM ({union}
  )
)"""


def pattern_values() -> str:
    """(ext, kind_rank, kind, pattern) rows of the original regex table."""
    rows = []
    for exts, pats in LANGUAGE_PATTERNS:
        for ext in exts:
            for rank, (kind, pat) in enumerate(pats):
                rows.append(f"({q(ext)}, {rank}, {q(kind)}, {q(pat)})")
    return "pats(ext, kind_rank, kind, pat) AS (VALUES " + ",\n  ".join(rows) + ")"


def regex_symbols_ctes(files: str, prefix: str = "rx") -> str:
    """Ordered distinct symbols per file for regex languages, via RE2."""
    return f"""
{prefix}_m AS (
  SELECT f.relative, p.kind_rank, p.kind, regexp_extract_all(f.content, p.pat, 1) AS names
  FROM {files} f JOIN pats p ON p.ext = regexp_extract(f.relative, '[^.]*$', 0)
),
{prefix}_u AS (
  SELECT relative, kind_rank, kind, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM {prefix}_m
),
{prefix}_d AS (
  SELECT relative, kind, name, kind || ' ' || name AS sym, min(CAST(kind_rank AS BIGINT) * 1000000000 + i) AS o
  FROM {prefix}_u GROUP BY relative, kind, name
),
{prefix}_s AS (
  SELECT relative, list(sym ORDER BY o) AS syms FROM {prefix}_d GROUP BY relative
)"""


RUST_SYMBOLS_SQL = """CASE p_partkey % 4
  WHEN 0 THEN ['fn f_' || cast(p_partkey as string)]
  WHEN 1 THEN ['struct S' || cast(p_partkey as string), 'impl S' || cast(p_partkey as string), 'fn m_' || cast(p_partkey as string)]
  WHEN 2 THEN ['enum E' || cast(p_partkey as string), 'trait T' || cast(p_partkey as string)]
  ELSE ['const C_' || cast(p_partkey as string), 'type A' || cast(p_partkey as string), 'fn g_' || cast(p_partkey as string)]
END"""
RUST_FN_NAME_SQL = """CASE p_partkey % 4 WHEN 0 THEN 'f_' WHEN 1 THEN 'm_' WHEN 3 THEN 'g_' END || cast(p_partkey as string)"""
RUST_FN_LINES_SQL = """CASE p_partkey % 4 WHEN 0 THEN p_size + 2 WHEN 1 THEN p_size + 2 WHEN 3 THEN p_size + 4 END"""


def rust_expect_cte() -> str:
    return f"""
rs_s AS (
  SELECT relative, flatten(list({RUST_SYMBOLS_SQL} ORDER BY p_partkey)) AS syms,
         count(*) FILTER (WHERE p_partkey % 4 <> 2) AS n_functions,
         count(*) FILTER (WHERE p_partkey % 4 <> 2 AND {RUST_FN_LINES_SQL} >= 20) AS n_long
  FROM code_blocks WHERE lang = 'rs' GROUP BY relative
)"""


LINE_COUNT_SQL = ("(length(content) - length(replace(content, chr(10), ''))"
                  " + CASE WHEN content = '' OR suffix(content, chr(10)) THEN 0 ELSE 1 END)")


def describe_text_sql(syms: str) -> str:
    return (f"CASE WHEN len({syms}) = 0 THEN 'no symbols' ELSE array_to_string(list_slice({syms}, 1, {SYMBOLS_SHOWN}), ', ')"
            f" || CASE WHEN len({syms}) > {SYMBOLS_SHOWN} THEN ', …' ELSE '' END END")


def file_summary_sql(corpus_cte: str, files: str, with_rust: bool) -> str:
    rust = ("," + rust_expect_cte()) if with_rust else ""
    syms = "coalesce(rs_s.syms, rx_s.syms, [])" if with_rust else "coalesce(rx_s.syms, [])"
    nfun = "coalesce(rs_s.n_functions, 0)" if with_rust else "0"
    nlong = "coalesce(rs_s.n_long, 0)" if with_rust else "0"
    rjoin = "LEFT JOIN rs_s ON rs_s.relative = f.relative" if with_rust else ""
    return f"""WITH {corpus_cte},
{pattern_values()},
{regex_symbols_ctes(files)}{rust}
SELECT f.relative,
       CAST({LINE_COUNT_SQL.replace('content', 'f.content')} AS BIGINT) AS total_lines,
       CAST(len({syms}) AS BIGINT) AS n_symbols,
       CAST({nfun} AS BIGINT) AS n_functions,
       CAST({nlong} AS BIGINT) AS n_long,
       {describe_text_sql(syms)} AS text,
       CAST(NULL AS VARCHAR) AS error
FROM {files} f LEFT JOIN rx_s ON rx_s.relative = f.relative {rjoin}"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes if c)


def symbol_rows_sql(corpus_cte: str, files: str) -> str:
    return _with(corpus_cte, pattern_values(), regex_symbols_ctes(files)) + """
SELECT relative, CAST(row_number() OVER (PARTITION BY relative ORDER BY o) AS BIGINT) AS pos, kind, name
FROM rx_d"""


def _rust_rows_cte() -> str:
    return f"""
rs_parts AS (
  SELECT relative, p_partkey, {RUST_SYMBOLS_SQL} AS syms FROM code_blocks WHERE lang = 'rs'
),
rs_rows AS (
  SELECT relative, p_partkey, unnest(syms) AS sym, generate_subscripts(syms, 1) AS j FROM rs_parts
),
rs_sym AS (
  SELECT relative, CAST(row_number() OVER (PARTITION BY relative ORDER BY p_partkey, j) AS BIGINT) AS pos,
         split_part(sym, ' ', 1) AS kind, substr(sym, strpos(sym, ' ') + 1) AS name
  FROM rs_rows
)"""


def rust_symbol_rows_sql() -> str:
    return _with(code_files_cte(["rs"]), _rust_rows_cte()) + "\nSELECT relative, pos, kind, name FROM rs_sym"


def _mixed_ctes() -> str:
    return ",".join([code_files_cte(), config_files_cte(), chat_files_cte(), """
mixed AS (
  SELECT relative, content FROM code_files UNION ALL SELECT relative, content FROM config_files
  UNION ALL SELECT relative, content FROM chat_files
)"""])


def _all_symbol_rows() -> str:
    return _with(_mixed_ctes(), pattern_values(), regex_symbols_ctes("mixed"), _rust_rows_cte(), """
all_sym AS (
  SELECT relative, CAST(row_number() OVER (PARTITION BY relative ORDER BY o) AS BIGINT) AS pos, kind, name
  FROM rx_d
  UNION ALL SELECT relative, pos, kind, name FROM rs_sym
)""")


def symbols_all_sql() -> str:
    return _all_symbol_rows() + "\nSELECT relative, pos, kind, name FROM all_sym"


def symbol_distinct_sql() -> str:
    return _all_symbol_rows() + """
SELECT relative, kind, CAST(count(*) AS BIGINT) AS n_symbols, CAST(min(pos) AS BIGINT) AS first_pos
FROM all_sym GROUP BY relative, kind"""


def _rust_fn_cte() -> str:
    return f"""
rs_fn AS (
  SELECT relative, p_partkey, {RUST_FN_NAME_SQL} AS name, CAST({RUST_FN_LINES_SQL} AS BIGINT) AS lines,
         CAST(row_number() OVER (PARTITION BY relative ORDER BY p_partkey) AS BIGINT) AS pos
  FROM code_blocks WHERE lang = 'rs' AND p_partkey % 4 <> 2
)"""


def function_spans_sql(min_lines: int = 0) -> str:
    return _with(code_files_cte(["rs"]), _rust_fn_cte()) + f"""
SELECT relative, pos, name, lines FROM rs_fn WHERE lines >= {min_lines}"""


def long_count_sql(threshold: int) -> str:
    return _with(code_files_cte(["rs"]), _rust_fn_cte()) + f"""
SELECT relative, CAST(count(*) AS BIGINT) AS n_long FROM rs_fn WHERE lines >= {threshold} GROUP BY relative"""


def _long_cte(threshold: int) -> str:
    return _with(code_files_cte(["rs"]), _rust_fn_cte(), f"""
lf AS (
  SELECT f.relative, CAST({LINE_COUNT_SQL.replace('content', 'f.content')} AS BIGINT) AS total_lines,
         list(struct_pack(p_partkey := r.p_partkey, name := r.name, lines := r.lines) ORDER BY r.p_partkey) AS fns
  FROM code_files f JOIN rs_fn r ON r.relative = f.relative
  WHERE r.lines >= {threshold}
  GROUP BY f.relative, f.content
)""")


def long_files_sql(threshold: int) -> str:
    return _long_cte(threshold) + """
SELECT relative, total_lines, CAST(len(fns) AS BIGINT) AS n_long,
       array_to_string(list_transform(fns, lambda x: x.name), ',') AS names
FROM lf"""


def long_text_sql(threshold: int) -> str:
    return _long_cte(threshold) + """
SELECT 1 AS section, relative,
       relative || ' [' || cast(total_lines as string) || ' lines]' || chr(10)
       || array_to_string(list_transform(fns, lambda x: '  └── ' || x.name || ': ' || cast(x.lines as string) || ' lines'), chr(10))
       || chr(10) AS entry
FROM lf"""


def long_json_sql(threshold: int) -> str:
    nl = "chr(10)"
    return _long_cte(threshold) + f"""
SELECT 1 AS section, relative,
       '  {{' || {nl} || '    "file": ' || to_json(relative) || ',' || {nl} || '    "long_functions": [' || {nl}
       || array_to_string(list_transform(fns, lambda x: '      {{' || {nl} || '        "lines": ' || cast(x.lines as string)
            || ',' || {nl} || '        "name": ' || to_json(x.name) || {nl} || '      }}'), ',' || {nl})
       || {nl} || '    ],' || {nl} || '    "total_lines": ' || cast(total_lines as string) || {nl} || '  }}'
       || CASE WHEN relative = max(relative) OVER () THEN '' ELSE ',' END AS entry
FROM lf
UNION ALL SELECT 0, '', CASE WHEN (SELECT count(*) FROM lf) > 0 THEN '[' ELSE '[]' END
UNION ALL SELECT 2, '', ']' WHERE (SELECT count(*) FROM lf) > 0"""


def xml_attr_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
            f" '\"', '&quot;'), '''', '&apos;')")


def long_xml_sql(threshold: int) -> str:
    nl = "chr(10)"
    return _long_cte(threshold) + f"""
SELECT 1 AS section, relative,
       '  <file path="' || {xml_attr_sql('relative')} || '" total_lines="' || cast(total_lines as string) || '">' || {nl}
       || array_to_string(list_transform(fns, lambda x: '    <function name="' || {xml_attr_sql('x.name')}
            || '" lines="' || cast(x.lines as string) || '" />'), {nl})
       || {nl} || '  </file>' AS entry
FROM lf
UNION ALL SELECT 0, '', '<long-functions>'
UNION ALL SELECT 2, '', '</long-functions>'"""


# ------------------------------------------------------------------ scalars

def doc_scalar_sql(expr: str, alias: str) -> str:
    return _with(doc_files_cte()) + f"\nSELECT relative, {expr} AS {alias} FROM doc_files"


def page_scalar_sql(expr: str, alias: str) -> str:
    return f"SELECT page_id, {expr} AS {alias} FROM pages"


LINE_COUNT_SPLIT_SQL = ("CAST(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10)))"
                        " - CASE WHEN suffix(content, chr(10)) THEN 1 ELSE 0 END END AS BIGINT)")


def head_lines_sql(n: int) -> str:
    lines = ("CASE WHEN content = '' THEN []::VARCHAR[] WHEN suffix(content, chr(10))"
             " THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END")
    return (f"array_to_string(list_slice({lines}, 1, {n}), chr(10))"
            f" || CASE WHEN len({lines}) > {n} THEN chr(10) || '[...truncated...]' ELSE '' END")


UNITS_SQL = "['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB']"


def human_size_expr(b: str) -> str:
    """The reference's float formula: unit = floor(log2(b)/10) capped, '%.1f'."""
    i = f"least(CAST(floor(log2({b}) / 10) AS INTEGER), 5)"
    return (f"CASE WHEN {b} = 0 THEN '0 B' ELSE printf('%.1f', {b} / pow(1024, {i})) || ' ' || {UNITS_SQL}[{i} + 1] END")


def human_size_sql() -> str:
    b = "(CAST(strlen(text) AS BIGINT) * CAST(pow(1024, doc_id % 5) AS BIGINT))"
    return f"SELECT doc_id, {b} AS bytes, {human_size_expr(b)} AS human FROM documents"


def iso_time_sql(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST({C.EPOCH_2024} + {seconds} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def xml_body_sql(x: str) -> str:
    esc = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"CASE WHEN contains({x}, ']]>') THEN {esc} ELSE '<![CDATA[' || {x} || ']]>' END"


def describe_text_query_sql() -> str:
    full = ("CASE WHEN len(syms) = 0 THEN 'no symbols' ELSE array_to_string(syms, ', ') END")
    return _with(code_files_cte(), pattern_values(), regex_symbols_ctes("code_files"),
                 rust_expect_cte()) + f"""
SELECT f.relative, {describe_text_sql('syms')} AS text, {full} AS full_text
FROM (SELECT f.relative, coalesce(rs_s.syms, rx_s.syms, []) AS syms FROM code_files f
      LEFT JOIN rx_s ON rx_s.relative = f.relative LEFT JOIN rs_s ON rs_s.relative = f.relative) f"""


def _is_cont(h: str, j: int) -> str:
    return f"substring({h}, {2 * j - 1}, 1) IN ('8', '9', 'A', 'B')"


def byte_truncate_sql(x: str, cap: int = 8000) -> str:
    """Cut by inspecting the hex of the UTF-8 bytes: the first byte after the cut
    must not be a continuation byte (10xxxxxx)."""
    h = f"hex(encode({x}))"
    k = (f"CASE WHEN NOT {_is_cont(h, cap + 1)} THEN {cap} WHEN NOT {_is_cont(h, cap)} THEN {cap - 1}"
         f" WHEN NOT {_is_cont(h, cap - 1)} THEN {cap - 2} ELSE {cap - 3} END")
    return (f"CASE WHEN strlen({x}) > {cap} THEN decode(unhex(substring({h}, 1, 2 * ({k}))))"
            f" || chr(10) || chr(10) || '[...file truncated...]' ELSE {x} END")


PROMPT_SUFFIX_SQL = {"en": "in English", "ru": "по-русски"}


def prompt_sql(lang: str) -> str:
    return f"md5({_prompt_expr(lang)})"


COMPLETION_BODY_SQL = ("'{\"choices\":[{\"message\":{\"content\":' || CASE event_id % 3"
                       " WHEN 0 THEN '\"  ' || event_type || ' ' || CAST(user_id AS STRING) || '  \"'"
                       " WHEN 1 THEN props ELSE 'null' END || '}}]}'")


def parse_completion_sql() -> str:
    v = "json_extract(body, '$.choices[0].message.content')"
    return f"""SELECT event_id,
       CASE WHEN json_type({v}) = 'VARCHAR' THEN trim(json_extract_string(body, '$.choices[0].message.content')) END AS text,
       CASE WHEN json_type({v}) = 'VARCHAR' THEN NULL ELSE 'no content in response' END AS error
FROM (SELECT event_id, {COMPLETION_BODY_SQL} AS body FROM events)"""


def _all_paths_cte() -> str:
    return ",".join([code_files_cte(), doc_files_cte(), chat_files_cte(), page_files_cte(), config_files_cte(), """
all_files AS (
  SELECT path, relative, content, kmax FROM code_files UNION ALL SELECT path, relative, content, kmax FROM doc_files
  UNION ALL SELECT path, relative, content, kmax FROM chat_files UNION ALL SELECT path, relative, content, kmax FROM page_files
  UNION ALL SELECT path, relative, content, kmax FROM config_files
)"""])


def lang_tag_sql() -> str:
    from codeloom.functions.text import FENCE_LANGUAGE
    ext = "regexp_extract(regexp_extract(relative, '[^/]*$', 0), '^.+\\.([^.]*)$', 1)"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FENCE_LANGUAGE.items())
    return _with(_all_paths_cte()) + f"\nSELECT relative, CASE {ext} {whens} ELSE '' END AS lang FROM all_files"


def path_filter_sql(include: str, exclude: str) -> str:
    cond = f"regexp_matches(relative, {q(include)})"
    if exclude:
        cond = f"NOT regexp_matches(relative, {q(exclude)}) AND " + cond
    return _with(_all_paths_cte()) + f"\nSELECT relative FROM all_files WHERE {cond}"


def size_guard_sql(cap: int) -> str:
    too_big = f"strlen(f.content) > {cap}"
    return _with(doc_files_cte(), pattern_values(), regex_symbols_ctes("doc_files")) + f"""
SELECT f.relative,
       CASE WHEN {too_big} THEN NULL ELSE CAST({LINE_COUNT_SQL.replace('content', 'f.content')} AS BIGINT) END AS total_lines,
       CAST(CASE WHEN {too_big} THEN 0 ELSE len(coalesce(rx_s.syms, [])) END AS BIGINT) AS n_symbols,
       CAST(0 AS BIGINT) AS n_functions, CAST(0 AS BIGINT) AS n_long,
       CASE WHEN {too_big} THEN '[ERROR]' ELSE {describe_text_sql('coalesce(rx_s.syms, [])')} END AS text,
       CASE WHEN {too_big} THEN '[SKIPPED: file too large (' || cast(strlen(f.content) as string) || ' > {cap})]' END AS error
FROM doc_files f LEFT JOIN rx_s ON rx_s.relative = f.relative"""


# ------------------------------------------------------------------ dump

def _dump_base(files_cte: str, files: str, max_size: int | None, max_lines: int | None) -> str:
    size = "CAST(strlen(content) AS BIGINT)"
    chain = f"CASE WHEN {size} = 0 THEN '[EMPTY FILE]'"
    if max_size is not None:
        chain += (f" WHEN {size} > {max_size} THEN '[SKIPPED: file size ' || {human_size_expr(size)}"
                  f" || ' > limit ' || {human_size_expr(str(max_size))} || ']'")
    chain += " WHEN contains(left(content, 1024), chr(0)) THEN '[BINARY FILE SKIPPED]' END"
    body = "content" if max_lines is None else head_lines_sql(max_lines)
    return _with(files_cte) + f""",
st AS (
  SELECT relative, {size} AS size, kmax, {chain} AS reason, {body} AS body FROM {files}
)"""


def _nl_missing(x: str) -> str:
    return f"CASE WHEN suffix({x}, chr(10)) THEN '' ELSE chr(10) END"


def dump_plain_sql(max_size: int | None, detailed: bool) -> str:
    head = "'==== File: ' || relative || ' ===='"
    if detailed:
        head = (f"'==== File: ' || relative || ' (size: ' || {human_size_expr('size')} || ', modified: '"
                f" || {iso_time_sql('kmax')} || ') ===='")
    return _dump_base(doc_files_cte(), "doc_files", max_size, None) + f"""
SELECT 1 AS section, relative,
       CASE WHEN reason IS NULL THEN {head} || chr(10) || body || {_nl_missing('body')}
            ELSE {head} || chr(10) || reason || chr(10) END AS entry
FROM st"""


def dump_markdown_sql(max_size: int | None, max_lines: int | None, detailed: bool) -> str:
    from codeloom.functions.text import FENCE_LANGUAGE
    head = "'## `' || relative || '`' || chr(10) || chr(10)"
    if detailed:
        head += (f" || chr(10) || '*Size: ' || {human_size_expr('size')} || '*, *Modified: '"
                 f" || {iso_time_sql('kmax')} || '*' || chr(10) || chr(10) || chr(10)")
    ext = "regexp_extract(regexp_extract(relative, '[^/]*$', 0), '^.+\\.([^.]*)$', 1)"
    lang = "CASE " + ext + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FENCE_LANGUAGE.items()) + " ELSE '' END"
    return _dump_base(doc_files_cte(), "doc_files", max_size, max_lines) + f"""
SELECT 1 AS section, relative,
       CASE WHEN reason IS NULL THEN {head} || '```' || {lang} || chr(10) || body || {_nl_missing('body')} || '```' || chr(10)
            ELSE {head} || '```' || chr(10) || reason || chr(10) || '```' || chr(10) END AS entry
FROM st"""


def dump_xml_sql(max_size: int | None, project: str, generated: str) -> str:
    path = xml_attr_sql("relative")
    mt = f"' mtime=\"' || cast({C.EPOCH_2024} + kmax as string) || '\"'"
    header = ('<?xml version="1.0" encoding="UTF-8"?>' + "' || chr(10) || '" +
              f'<project name="{project}" generated="{generated}">' + "' || chr(10) || '" + "  <files>")
    return _dump_base(page_files_cte(), "page_files", max_size, None) + f"""
SELECT 1 AS section, relative,
       CASE WHEN reason IS NULL THEN '    <file path="' || {path} || '" size="' || cast(size as string) || '"' || {mt}
                 || '>' || chr(10) || '      ' || {xml_body_sql('body')} || chr(10) || '    </file>'
            ELSE '    <file path="' || {path} || '" size="' || cast(size as string) || '"' || {mt}
                 || ' error="' || {xml_attr_sql('reason')} || '" />' END AS entry
FROM st
UNION ALL SELECT 0, '', '{header}'
UNION ALL SELECT 2, '', '  </files>' || chr(10) || '</project>'"""


def dump_status_sql(max_size: int) -> str:
    return _dump_base(doc_files_cte(), "doc_files", max_size, None) + """
SELECT relative, CASE WHEN reason IS NULL THEN 'content' WHEN reason = '[EMPTY FILE]' THEN 'empty'
                      WHEN reason LIKE '[SKIPPED%' THEN 'skipped' ELSE 'binary' END AS status,
       reason
FROM st"""


# ------------------------------------------------------------------ tree

def _tree_ctes() -> str:
    return _with(_mixed_ctes(), pattern_values(), regex_symbols_ctes("mixed"), rust_expect_cte(), f"""
descs AS (
  SELECT f.relative, CAST({LINE_COUNT_SQL.replace('content', 'f.content')} AS BIGINT) AS total_lines,
         coalesce(rs_s.syms, rx_s.syms, []) AS syms, CAST(coalesce(rs_s.n_long, 0) AS BIGINT) AS n_long
  FROM mixed f LEFT JOIN rx_s ON rx_s.relative = f.relative LEFT JOIN rs_s ON rs_s.relative = f.relative
),
pre AS (
  SELECT relative, parts, unnest(range(1, len(parts) + 1)) AS k
  FROM (SELECT relative, string_split(relative, '/') AS parts FROM descs)
),
nodes0 AS (
  SELECT array_to_string(parts[1:k], '/') AS node, any_value(parts[1:k]) AS nparts, any_value(k) AS depth,
         any_value(parts[k]) AS name, any_value(array_to_string(parts[1:k - 1], '/')) AS parent,
         bool_or(k < len(parts)) AS has_children, max(CASE WHEN k = len(parts) THEN relative END) AS frel
  FROM pre GROUP BY 1
),
nodes AS (
  SELECT n.*, d.total_lines, d.syms, d.n_long, d.relative IS NOT NULL AS has_d,
         {describe_text_sql('d.syms')} AS text,
         n.name = max(n.name) OVER (PARTITION BY n.parent) AS is_last
  FROM nodes0 n LEFT JOIN descs d ON d.relative = n.frel
)""")


def tree_nodes_sql() -> str:
    return _tree_ctes() + """
SELECT node, parent, name, CAST(depth AS INTEGER) AS depth, has_children,
       CASE WHEN has_d THEN total_lines END AS total_lines, CASE WHEN has_d THEN text END AS text
FROM nodes"""


def sibling_order_sql() -> str:
    return _tree_ctes() + "\nSELECT node, parent, is_last FROM nodes"


def tree_plain_sql(max_depth: int | None) -> str:
    keep = f"WHERE n.depth <= {max_depth + 1}" if max_depth is not None else ""
    extras = ("concat_ws(' ', CASE WHEN n.total_lines IS NOT NULL THEN '[' || cast(n.total_lines as string) || ' lines]' END,"
              " CASE WHEN n.text <> '' AND n.text <> 'no symbols' THEN '(' || n.text || ')' END,"
              " CASE WHEN n.n_long > 0 THEN '(long: ' || cast(n.n_long as string) || ')' END)")
    return _tree_ctes() + f""",
anc AS (
  SELECT n.node, i, a.is_last
  FROM (SELECT node, nparts, unnest(range(1, depth)) AS i FROM nodes) n
  JOIN nodes a ON a.node = array_to_string(n.nparts[1:i], '/')
),
bars AS (
  SELECT node, string_agg(CASE WHEN is_last THEN '    ' ELSE '│   ' END, '' ORDER BY i) AS prefix FROM anc GROUP BY node
)
SELECT n.node, 0 AS phase,
       coalesce(b.prefix, '') || CASE WHEN n.is_last THEN '└── ' ELSE '├── ' END || n.name
       || CASE WHEN n.has_d THEN CASE WHEN {extras} = '' THEN '' ELSE ' ' || {extras} END ELSE '/' END AS entry
FROM nodes n LEFT JOIN bars b ON b.node = n.node {keep}"""


def tree_xml_sql(max_depth: int | None) -> str:
    name = xml_attr_sql("name")
    full = "CASE WHEN len(syms) = 0 THEN 'no symbols' ELSE array_to_string(syms, ', ') END"
    trunc = f"depth > {max_depth}" if max_depth is not None else "false"
    keep = f"WHERE depth <= {max_depth + 1}" if max_depth is not None else ""
    return _tree_ctes() + f""",
alln AS (
  SELECT node, name, depth, has_children, has_d, syms, n_long, total_lines FROM nodes
  UNION ALL SELECT '', '', 0, true, false, NULL, NULL, NULL
)
SELECT node, 0 AS phase,
       CASE WHEN {trunc} THEN '<file name="' || {name} || '" truncated="true" />'
            WHEN has_children THEN '<directory name="' || {name} || '">'
            WHEN has_d THEN '<file name="' || {name} || '" description="' || {xml_attr_sql(full)}
                 || '" long_functions="' || cast(n_long as string) || '" total_lines="'
                 || cast(coalesce(total_lines, 0) as string) || '" />'
            ELSE '<file name="' || {name} || '" />' END AS entry
FROM alln {keep}
UNION ALL
SELECT node, 1, CASE WHEN depth = 0 THEN '</directory>' || chr(10) ELSE '</directory>' END
FROM alln WHERE has_children AND NOT ({trunc}) {('AND depth <= ' + str(max_depth + 1)) if max_depth is not None else ''}"""


def tree_json_sql(max_depth: int | None) -> str:
    nl = "chr(10)"
    trunc = f"depth + 1 > {max_depth}" if max_depth is not None else "false"
    keep = f"WHERE depth + 1 <= {max_depth + 1}" if max_depth is not None else ""
    i0, i1, i2 = "repeat(' ', depth * 4)", "repeat(' ', depth * 4 + 2)", "repeat(' ', depth * 4 + 4)"
    comma = "CASE WHEN is_last THEN '' ELSE ',' END"
    full = "CASE WHEN len(syms) = 0 THEN 'no symbols' ELSE array_to_string(syms, ', ') END"
    symbols = (f"CASE WHEN len(syms) = 0 THEN {i1} || '\"symbols\": []' ELSE {i1} || '\"symbols\": [' || {nl}"
               f" || array_to_string(list_transform(syms, lambda s: {i2} || to_json(s)), ',' || {nl})"
               f" || {nl} || {i1} || ']' END")
    tail = (f"concat_ws(',' || {nl}, CASE WHEN has_d THEN {i1} || '\"description\": ' || to_json({full}) END,"
            f" {i1} || '\"name\": ' || to_json(name), CASE WHEN has_d THEN {symbols} END)")
    return _tree_ctes() + f""",
alln AS (
  SELECT node, name, depth, has_children, has_d, syms, is_last FROM nodes
  UNION ALL SELECT '', '', 0, true, false, NULL, true
)
SELECT node, 0 AS phase,
       CASE WHEN {trunc} THEN {i0} || '{{' || {nl} || {i1} || '"name": ' || to_json(name) || ',' || {nl}
                 || {i1} || '"truncated": true' || {nl} || {i0} || '}}' || {comma}
            WHEN has_children THEN {i0} || '{{' || {nl} || {i1} || '"children": ['
            ELSE {i0} || '{{' || {nl} || {tail} || {nl} || {i0} || '}}' || {comma} END AS entry
FROM alln {keep}
UNION ALL
SELECT node, 1, {i1} || '],' || {nl} || {tail} || {nl} || {i0} || '}}' || {comma}
FROM alln WHERE has_children AND NOT ({trunc}) {('AND depth + 1 <= ' + str(max_depth + 1)) if max_depth is not None else ''}"""


# ------------------------------------------------------------------ state (V6) and changes (V7)

def _events_cte() -> str:
    return f"""
ev AS (
  SELECT '/corpus/events/u' || lpad(cast(user_id as string), 4, '0') || '.log' AS path, event_type AS mode,
         {q(C.PATTERN_PARAMS)} AS params, epoch_us(ts) // 1000 AS mtime_ms, props AS text, event_id
  FROM events
),
stored AS (
  SELECT path, mode, params, arg_max(mtime_ms, event_id) AS mtime_ms, arg_max(text, event_id) AS text
  FROM ev WHERE event_id % 3 <> 0 GROUP BY path, mode, params
),
now AS (SELECT path, max(mtime_ms) AS mtime_ms FROM ev GROUP BY path),
hits AS (
  SELECT s.* FROM stored s JOIN now n ON n.path = s.path AND n.mtime_ms = s.mtime_ms
  WHERE s.mode = 'click' AND s.params = {q(C.PATTERN_PARAMS)}
)"""


def cache_hits_sql() -> str:
    return _with(_events_cte()) + "\nSELECT path, mode, mtime_ms, text FROM hits"


def cache_misses_sql() -> str:
    return _with(_events_cte()) + "\nSELECT path, mtime_ms FROM now WHERE path NOT IN (SELECT path FROM hits)"


def cache_upsert_sql() -> str:
    return _with(_events_cte()) + """
SELECT path, mode, params, arg_max(mtime_ms, event_id) AS mtime_ms, arg_max(text, event_id) AS text
FROM ev GROUP BY path, mode, params"""


def incremental_sql(langs: list[str], cached: bool) -> str:
    inner = file_summary_sql(code_files_cte(langs), "code_files", with_rust="rs" in langs)
    flag = "length(relative) % 3 = 1" if cached else "false"
    return f"SELECT *, {flag} AS from_cache FROM ({inner})"


def _snapshots_cte() -> str:
    return f"""
docs AS (SELECT doc_id, {C.DOC_RELATIVE_SQL} AS relative, text FROM documents),
old AS (SELECT relative, text AS content FROM docs WHERE doc_id % 10 <> 0),
new AS (
  SELECT relative, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'modified ' || cast(doc_id as string)
                        ELSE text END AS content
  FROM docs WHERE doc_id % 10 <> 1
),
diff AS (
  SELECT coalesce(o.relative, n.relative) AS relative,
         CASE WHEN o.relative IS NULL THEN 'added' WHEN n.relative IS NULL THEN 'removed' ELSE 'modified' END AS status
  FROM old o FULL OUTER JOIN new n ON o.relative = n.relative
  WHERE o.relative IS NULL OR n.relative IS NULL OR md5(o.content) <> md5(n.content)
)"""


def snapshot_diff_sql() -> str:
    return _with(_snapshots_cte()) + "\nSELECT relative, status FROM diff"


def _lines_of(tbl: str) -> str:
    lines = ("CASE WHEN content = '' THEN []::VARCHAR[] WHEN suffix(content, chr(10))"
             " THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END")
    return (f"SELECT relative, line, count(*) AS n FROM (SELECT relative, unnest({lines}) AS line FROM {tbl}"
            f" WHERE relative IN (SELECT relative FROM diff WHERE status = 'modified')) GROUP BY relative, line")


def line_changes_sql() -> str:
    return _with(_snapshots_cte(), f"""
ol AS ({_lines_of('old')}),
nl AS ({_lines_of('new')}),
d AS (
  SELECT coalesce(ol.relative, nl.relative) AS relative, coalesce(ol.line, nl.line) AS line,
         coalesce(nl.n, 0) - coalesce(ol.n, 0) AS delta
  FROM ol FULL OUTER JOIN nl ON ol.relative = nl.relative AND ol.line = nl.line
)""") + """
SELECT relative, CASE WHEN delta > 0 THEN '+' ELSE '-' END AS change, line, false AS mark, CAST(abs(delta) AS BIGINT) AS n
FROM d WHERE delta <> 0"""


# ------------------------------------------------------------------ describe

def _prompt_expr(lang: str) -> str:
    return (f"'Describe the purpose of this ' || relative || ' file in one line (max 20 words) "
            f"{PROMPT_SUFFIX_SQL[lang]}:' || chr(10) || chr(10) || content")


def describe_llm_sql(cap: int | None) -> str:
    cap = (1 << 62) if cap is None else cap
    return _with(doc_files_cte(), f"""
p AS (SELECT relative, content, {_prompt_expr('en')} AS prompt FROM doc_files),
h AS (SELECT relative, content, prompt, md5(prompt) AS h FROM p)""") + f"""
SELECT relative,
       CASE WHEN strlen(content) > {cap} THEN '[ERROR]'
            WHEN substr(h, 1, 1) NOT IN ('0','1','2','3','4','5','6','7') THEN 'primary ' || substr(h, 1, 8)
            WHEN substr(h, 1, 1) = '0' OR substr(h, 2, 1) = 'f' THEN '[ERROR]'
            ELSE 'fallback ' || cast(strlen(prompt) as string) END AS text,
       CASE WHEN strlen(content) > {cap} THEN '[SKIPPED: file too large (' || cast(strlen(content) as string) || ' > {cap})]'
            WHEN substr(h, 1, 1) NOT IN ('0','1','2','3','4','5','6','7') THEN NULL
            WHEN substr(h, 1, 1) = '0' OR substr(h, 2, 1) = 'f' THEN 'all backends failed' END AS error,
       CASE WHEN strlen(content) > {cap} THEN NULL
            WHEN substr(h, 1, 1) NOT IN ('0','1','2','3','4','5','6','7') THEN 'primary'
            WHEN substr(h, 1, 1) = '0' OR substr(h, 2, 1) = 'f' THEN NULL ELSE 'fallback' END AS backend
FROM h"""


def request_body_sql(model: str) -> str:
    return _with(doc_files_cte()) + f"""
SELECT relative, md5(CAST(json_object('max_tokens', 150,
         'messages', [json_object('content', {_prompt_expr('en')}, 'role', 'user')],
         'model', {q(model)}, 'temperature', 0.2) AS VARCHAR)) AS body_md5
FROM doc_files"""


def register_language_sql(ext: str, kind: str, pattern: str) -> str:
    return _with(doc_files_cte(), f"""
m AS (
  SELECT relative, regexp_extract_all(content, {q(pattern)}, 1) AS names FROM doc_files
  WHERE regexp_extract(relative, '[^.]*$', 0) = {q(ext)}
),
u AS (SELECT relative, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM m),
d AS (SELECT relative, name, min(i) AS o FROM u GROUP BY relative, name)""") + f"""
SELECT relative, CAST(row_number() OVER (PARTITION BY relative ORDER BY o) AS BIGINT) AS pos,
       {q(kind)} AS kind, name FROM d"""


# ------------------------------------------------------------------ sources (S) and ignore rules

def corpus_scan_sql() -> str:
    return _with(doc_files_cte()) + f"""
SELECT relative, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS content_md5, false AS is_binary,
       {LINE_COUNT_SPLIT_SQL} AS total_lines
FROM doc_files"""


def gitignore_sql() -> str:
    return f"""WITH docs AS (
  SELECT {C.DOC_RELATIVE_SQL} AS relative, source, lang, doc_id,
         CAST(substr(source, 4) AS INTEGER) AS n, {C.DOC_EXTS_SQL} AS ext FROM documents
),
kept_docs AS (
  SELECT relative FROM docs
  WHERE NOT (source = 'src1'
             OR (source = 'src2' AND lang = 'en' AND ext = 'txt')
             OR (ext = 'log' AND NOT (n % 3 = 0 AND starts_with(cast(doc_id as string), '1'))))
)
SELECT relative FROM kept_docs
UNION ALL SELECT '.gitignore'
UNION ALL SELECT DISTINCT source || '/.gitignore' FROM docs WHERE source <> 'src1'"""


def sort_files_sql() -> str:
    return _with(_all_paths_cte()) + """
SELECT relative, CAST(row_number() OVER (ORDER BY relative) AS BIGINT) AS position FROM all_files"""


def sym_none_sql() -> str:
    """Markdown documents have headings; the other extensions have no patterns."""
    return _with(doc_files_cte(), f"""
heads AS (SELECT relative, list_distinct(regexp_extract_all(content, '(?m)^#+\\s+(.+)', 1)) AS names,
          regexp_extract_all(content, '(?m)^#+\\s+(.+)', 1) AS every FROM doc_files WHERE suffix(relative, '.md')),
first_seen AS (SELECT relative, list_transform(list_sort(list_transform(names, lambda x: [lpad(list_position(every, x)::VARCHAR, 12, '0'), x])),
          lambda p: 'heading ' || p[2]) AS syms FROM heads)""") + f"""
SELECT relative, CASE WHEN suffix(relative, '.md') THEN {describe_text_sql('syms')} ELSE 'no symbols' END AS text,
       CAST(coalesce(len(syms), 0) AS BIGINT) AS n_symbols FROM doc_files LEFT JOIN first_seen USING (relative)"""


def incremental_describe_sql(cap: int | None) -> str:
    return (f"SELECT relative, text, error, CASE WHEN length(relative) % 4 = 0 AND error IS NULL THEN NULL ELSE backend END"
            f" AS backend, length(relative) % 4 = 0 AND error IS NULL AS from_cache FROM ({describe_llm_sql(cap)})")


# ------------------------------------------------------------------ chunked files (S3-S5, P3), P9, P14, D7

def _spliced_cte() -> str:
    """What the spliced documents decode to: one U+FFFD per maximal invalid part."""
    return f"""
sp AS (SELECT {C.DOC_RELATIVE_SQL} AS relative, doc_id % 6 AS kind, coalesce(text, '') AS t FROM documents),
lossy AS (SELECT relative, kind, t,
    t[1:length(t) // 2] || CASE WHEN kind IN (1, 2, 3) THEN chr(65533) WHEN kind = 4 THEN chr(65533) || chr(65533) ELSE '' END
    || t[length(t) // 2 + 1:length(t)] || CASE WHEN kind = 5 THEN chr(0) ELSE '' END AS content,
    strlen(t) + CASE kind WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS size FROM sp)"""


def read_strict_sql() -> str:
    return _with(_spliced_cte()) + """
SELECT relative, CASE WHEN kind IN (0, 5) THEN md5(content) END AS text_md5,
       CASE WHEN kind NOT IN (0, 5) THEN 'stream did not contain valid UTF-8' END AS error FROM lossy"""


def read_lossy_sql() -> str:
    return _with(_spliced_cte()) + """
SELECT relative, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS text_md5 FROM lossy"""


def is_binary_sql(prefix: int) -> str:
    return _with(_spliced_cte()) + f"""
SELECT relative, CAST(size AS BIGINT) AS size, kind = 5 AS is_binary, kind = 5 AND size <= {prefix} AS early_nul,
       kind IN (0, 5) AS valid, CAST({LINE_COUNT_SQL} AS BIGINT) AS total_lines FROM lossy"""


def display_path_sql() -> str:
    return _with(doc_files_cte()) + """
SELECT relative, relative AS display, '/corpus/' || relative AS absolute_display FROM doc_files"""


def cache_key_sql() -> str:
    return """
SELECT DISTINCT source, lang, CAST(json_object('exclude', 'tmp|' || lang, 'include', source || '/.*"\\.(md|txt)$', 'version', 1) AS VARCHAR)
       AS params FROM documents"""


def empty_tree_sql() -> str:
    return _with(doc_files_cte()) + """
SELECT view, '' AS node, entry FROM (VALUES ('plain', 'No matching files found.'), ('json', '[]'), ('xml', '<files />')) v(view, entry)
WHERE NOT EXISTS (SELECT 1 FROM doc_files WHERE suffix(relative, '.nothing'))"""
