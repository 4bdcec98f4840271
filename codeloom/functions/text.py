"""Scalar Column -> Column functions (built-in Spark expressions only, no UDFs).

Every function here stays inside whole-stage codegen; none of them looks at
more than one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's output byte for byte.
# ---------------------------------------------------------------------------
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
TRUNCATED_LINES_MARK = "\n[...truncated...]"
TRUNCATED_FILE_MARK = "\n\n[...file truncated...]"
NO_SYMBOLS = "no symbols"
ELLIPSIS = "…"
ERROR_TEXT = "[ERROR]"
PROMPT_HEAD, PROMPT_TAIL = "Describe the purpose of this ", " file in one line (max 20 words) "
PROMPT_SUFFIX = {"en": "in English", "ru": "по-русски"}
LANGUAGE_ALIASES = {"en": "en", "english": "en", "ru": "ru", "russian": "ru"}
LLM_CONTENT_CAP_BYTES = 8000
SYMBOLS_SHOWN = 10
LONG_THRESHOLD = 20
MAX_FILE_SIZE = 10 * 1024 * 1024
BINARY_PREFIX = 1024
# markdown fence language by path extension
FENCE_LANGUAGE = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "cs": "csharp", "rb": "ruby", "swift": "swift", "kt": "kotlin", "toml": "toml",
    "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "html": "html",
    "htm": "html", "css": "css", "sh": "bash", "bash": "bash",
}
# ---------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_ext(relative) -> Column:
    """Text after the last '.' of the whole relative path (whole path if none)."""
    return F.substring_index(col(relative), ".", -1)


def basename(relative) -> Column:
    return F.substring_index(col(relative), "/", -1)


def path_extension(relative) -> Column:
    """Extension of the last path component; names like '.env' have none ('')."""
    return F.regexp_extract(basename(relative), r"^.+\.([^.]*)$", 1)


def lang_tag(relative) -> Column:
    ext = path_extension(relative)
    expr = None
    for k, v in FENCE_LANGUAGE.items():
        expr = (F.when(ext == k, F.lit(v)) if expr is None else expr.when(ext == k, F.lit(v)))
    return expr.otherwise(F.lit(""))


def newline_count(content) -> Column:
    c = col(content)
    return (F.length(c) - F.length(F.replace(c, F.lit(NL), F.lit("")))).cast("bigint")


def line_count(content) -> Column:
    """Lines as '\\n'-terminated; an unterminated last line counts; '' has 0."""
    c = col(content)
    tail = F.when((c == "") | c.endswith(NL), F.lit(0)).otherwise(F.lit(1))
    return (newline_count(c) + tail).cast("bigint")


def split_lines(content) -> Column:
    """array<string> of lines: split at '\\n' (a preceding '\\r' is dropped), no empty tail."""
    c = F.replace(col(content), F.lit("\r\n"), F.lit(NL))
    parts = F.split(c, NL, -1)
    return (F.when(c == "", F.array().cast("array<string>"))
            .when(c.endswith(NL), F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def head_lines(content, n: int) -> Column:
    lines = split_lines(content)
    head = F.array_join(F.slice(lines, 1, F.lit(int(n))) if n > 0 else F.array().cast("array<string>"), NL)
    return F.when(F.size(lines) > F.lit(int(n)), F.concat(head, F.lit(TRUNCATED_LINES_MARK))).otherwise(head)


def human_size(nbytes) -> Column:
    """'0 B' or '%.1f <unit>' with unit = floor(log2(n)/10), ties to even.

    Exact integer arithmetic (no floating log2): unit i is the largest with
    1024**i <= n; tenths are rounded half-to-even.
    """
    b = col(nbytes).cast("decimal(38,0)")
    unit = F.lit(0)
    for i in range(1, len(SIZE_UNITS)):
        unit = F.when(b >= F.lit(1024 ** i).cast("decimal(38,0)"), F.lit(i)).otherwise(unit)
    scale = F.pow(F.lit(1024), unit).cast("decimal(38,0)")
    t = b * 10
    q = F.floor(t / scale).cast("decimal(38,0)")
    r = t - q * scale
    up = (r * 2 > scale) | ((r * 2 == scale) & (q % 2 == 1))
    tenths = F.when(up, q + 1).otherwise(q).cast("decimal(38,0)")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    txt = F.concat(F.floor(tenths / 10).cast("decimal(38,0)").cast("string"), F.lit("."),
                   (tenths % 10).cast("int").cast("string"), F.lit(" "),
                   F.element_at(units, unit + 1))
    return F.when(b == 0, F.lit("0 B")).otherwise(txt)


def iso_time(ts) -> Column:
    """RFC 3339, whole seconds, 'Z' for UTC (session time zone)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def epoch_seconds(ts) -> Column:
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / 1_000_000).cast("bigint")


def epoch_millis(ts) -> Column:
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / 1_000).cast("bigint")


def xml_attr_escape(s) -> Column:
    c = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_text_escape(s) -> Column:
    c = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_body(content) -> Column:
    c = col(content)
    return F.when(F.contains(c, F.lit("]]>")), xml_text_escape(c)).otherwise(
        F.concat(F.lit("<![CDATA["), c, F.lit("]]>")))


def json_string(s) -> Column:
    """A JSON string literal (quoted, escaped) for one string column."""
    whole = F.to_json(F.struct(col(s).alias("v")))  # {"v":...}, or {} for null
    return F.substring(whole, F.lit(6), F.greatest(F.length(whole) - 6, F.lit(0)))


def describe_text(symbols, no_truncate: bool = False) -> Column:
    s = col(symbols)
    if no_truncate:
        shown = s
    else:
        shown = F.concat(F.slice(s, 1, SYMBOLS_SHOWN),
                         F.when(F.size(s) > SYMBOLS_SHOWN, F.array(F.lit(ELLIPSIS)))
                         .otherwise(F.array().cast("array<string>")))
    return F.when(F.size(s) == 0, F.lit(NO_SYMBOLS)).otherwise(F.array_join(shown, ", "))


def is_binary(content_bin, prefix: int | None = None) -> Column:
    """A NUL byte within the first ``prefix`` bytes (None: anywhere); empty content is not binary."""
    b = col(content_bin)
    part = b if prefix is None else F.substring(b, 1, prefix)
    return F.coalesce(F.instr(part.cast("string"), F.lit("\u0000")) > 0, F.lit(False))


def as_text_strict(content_bin) -> Column:
    """UTF-8 text, or NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(col(content_bin).cast("string"))


def as_text_lossy(content_bin) -> Column:
    """UTF-8 text with invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(col(content_bin).cast("string"))


def byte_length(s) -> Column:
    return F.octet_length(col(s))


def byte_truncate(content, cap: int = LLM_CONTENT_CAP_BYTES) -> Column:
    """Over ``cap`` bytes: cut at the last char boundary <= cap and append a marker."""
    c = col(content)
    b = F.encode(c, "UTF-8")
    # a prefix is valid UTF-8 exactly when the cut falls on a boundary (at most 3 tries)
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(b, 1, cap - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(c) > cap, F.concat(cut, F.lit(TRUNCATED_FILE_MARK))).otherwise(c)


def normalize_language(lang: str) -> str:
    key = lang.lower()
    if key not in LANGUAGE_ALIASES:
        raise ValueError(f"invalid language: {lang}")
    return LANGUAGE_ALIASES[key]


def build_prompt(relative, content, language: str = "ru", cap: int | None = None) -> Column:
    """The prompt on a file's whole text, or on its first ``cap`` bytes (see ``byte_truncate``)."""
    suffix = PROMPT_SUFFIX[normalize_language(language)]
    body = col(content) if cap is None else byte_truncate(content, cap)
    return F.concat(F.lit(PROMPT_HEAD), col(relative), F.lit(f"{PROMPT_TAIL}{suffix}:\n\n"), body)


def unicode_trim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


def completion_text(body) -> Column:
    """``choices[0].message.content`` when it is a JSON string, trimmed; else NULL."""
    v = F.try_parse_json(col(body))
    node = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    is_str = F.schema_of_variant(node) == F.lit("STRING")
    return F.when(is_str, unicode_trim(F.try_variant_get(node, "$", "string")))


def completion_error(body) -> Column:
    return F.when(completion_text(body).isNull(), F.lit("no content in response"))
