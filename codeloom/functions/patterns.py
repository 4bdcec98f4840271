"""Symbol extraction for regex-described languages (one Spark expression, no UDF).

Contract: for each (kind, pattern) of a language *in list order*, every
non-overlapping match in text order contributes ``"<kind> <capture 1>"``; the
list is then deduplicated keeping first occurrences.  Rust is not regex-based:
see ``codeloom.operators.rust``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import col, file_ext

# ---------------------------------------------------------------------------
# Extension groups and their ordered (kind, pattern) lists.
# These must equal the reference's tables for identical symbol lists.
# ---------------------------------------------------------------------------
LANGUAGE_PATTERNS: list[tuple[tuple[str, ...], list[tuple[str, str]]]] = [
    (("py",), [
        ("class", r"(?m)^\s*class\s+(\w+)"),
        ("def", r"(?m)^\s*def\s+(\w+)\s*\("),
        ("async def", r"(?m)^\s*async\s+def\s+(\w+)\s*\("),
        ("const", r"(?m)^\s*([A-Z][A-Z0-9_]+)\s*="),
    ]),
    (("js", "jsx", "ts", "tsx"), [
        ("function", r"(?m)^\s*function\s+(\w+)\s*\("),
        ("class", r"(?m)^\s*class\s+(\w+)"),
        ("const", r"(?m)^\s*const\s+(\w+)\s*="),
        ("let", r"(?m)^\s*let\s+(\w+)\s*="),
    ]),
    (("go",), [
        ("func", r"(?m)^\s*func\s+(\w+)\s*\("),
        ("type", r"(?m)^\s*type\s+(\w+)\s+(?:struct|interface)"),
        ("const", r"(?m)^\s*const\s+(\w+)"),
    ]),
    (("java",), [
        ("class", r"(?m)^\s*(?:public\s+)?class\s+(\w+)"),
        ("interface", r"(?m)^\s*(?:public\s+)?interface\s+(\w+)"),
        ("enum", r"(?m)^\s*(?:public\s+)?enum\s+(\w+)"),
        ("method", r"(?m)^\s*(?:public|private|protected)\s+(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*\{"),
    ]),
    (("c", "h", "cpp", "hpp", "cc", "cxx"), [
        ("struct", r"(?m)^\s*struct\s+(\w+)"),
        ("class", r"(?m)^\s*class\s+(\w+)"),
        ("enum", r"(?m)^\s*enum\s+(\w+)"),
        ("function", r"(?m)^\s*\w+\s+(\w+)\s*\([^)]*\)\s*\{"),
    ]),
    (("cs",), [
        ("class", r"(?m)^\s*(?:public|private|internal)?\s*class\s+(\w+)"),
        ("interface", r"(?m)^\s*(?:public|private|internal)?\s*interface\s+(\w+)"),
        ("enum", r"(?m)^\s*(?:public|private|internal)?\s*enum\s+(\w+)"),
        ("struct", r"(?m)^\s*(?:public|private|internal)?\s*struct\s+(\w+)"),
        ("method", r"(?m)^\s*(?:public|private|internal)?\s*(?:async\s+)?(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*\{"),
    ]),
    (("rb",), [
        ("class", r"(?m)^\s*class\s+(\w+)"),
        ("module", r"(?m)^\s*module\s+(\w+)"),
        ("def", r"(?m)^\s*def\s+(\w+)\s*\("),
    ]),
    (("swift",), [
        ("class", r"(?m)^\s*(?:public|private|internal)?\s*class\s+(\w+)"),
        ("struct", r"(?m)^\s*(?:public|private|internal)?\s*struct\s+(\w+)"),
        ("enum", r"(?m)^\s*(?:public|private|internal)?\s*enum\s+(\w+)"),
        ("protocol", r"(?m)^\s*(?:public|private|internal)?\s*protocol\s+(\w+)"),
        ("func", r"(?m)^\s*(?:public|private|internal)?\s*func\s+(\w+)\s*\("),
    ]),
    (("kt",), [
        ("class", r"(?m)^\s*(?:public|private|internal)?\s*class\s+(\w+)"),
        ("interface", r"(?m)^\s*(?:public|private|internal)?\s*interface\s+(\w+)"),
        ("enum", r"(?m)^\s*(?:public|private|internal)?\s*enum\s+(\w+)"),
        ("object", r"(?m)^\s*(?:public|private|internal)?\s*object\s+(\w+)"),
        ("fun", r"(?m)^\s*(?:public|private|internal)?\s*fun\s+(\w+)\s*\("),
    ]),
    (("toml",), [
        ("table", r"(?m)^\s*\[([a-zA-Z_][a-zA-Z0-9_.-]*)\]"),
        ("key", r"(?m)^\s*([a-zA-Z_][a-zA-Z0-9_.-]*)\s*="),
    ]),
    (("yaml", "yml"), [
        ("key", r"(?m)^\s*([a-zA-Z_][a-zA-Z0-9_-]*)\s*:"),
    ]),
    (("json",), [
        ("key", r'(?m)^\s*"([^"]+)"\s*:'),
    ]),
    (("md",), [
        ("heading", r"(?m)^#+\s+(.+)"),
    ]),
]
# ---------------------------------------------------------------------------

# The JVM regex engine backtracks recursively: ``(?:\w+\s+)*(\w+)\s*\(`` over a
# long run of words overflows the thread stack and kills the executor.  These
# possessive forms accept exactly the same texts (a word followed by blanks is
# only consumed when no '(' follows) and run in linear time.
_JVM_SAFE_TAIL = r"(?:\w++\s++(?!\())*+(\w++)\s*+\([^)]*+\)\s*+\{"
_JVM_REWRITES = {
    r"(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*\{": _JVM_SAFE_TAIL,
}

# Flags that align java.util.regex with the reference's regex dialect:
# U = Unicode \w \s, m = multi-line ^, d = only '\n' ends a line.
JVM_FLAGS = "(?Umd)"


def jvm_pattern(pattern: str) -> str:
    """Translate one reference pattern to an equivalent java.util.regex pattern."""
    p = pattern
    if p.startswith("(?m)"):
        p = p[len("(?m)"):]
    for slow, safe in _JVM_REWRITES.items():
        p = p.replace(slow, safe)
    return JVM_FLAGS + p


@dataclass
class LanguageRegistry:
    """Extension -> ordered (kind, pattern) list.  Extend with ``register``."""

    groups: list[tuple[tuple[str, ...], list[tuple[str, str]]]] = field(
        default_factory=lambda: [(exts, list(pats)) for exts, pats in LANGUAGE_PATTERNS])

    def register(self, exts, patterns: list[tuple[str, str]]) -> "LanguageRegistry":
        """Add (or replace) a language: ``patterns`` are (kind, reference-dialect regex)."""
        exts = tuple([exts] if isinstance(exts, str) else exts)
        kept = []
        for g_exts, g_pats in self.groups:
            rest = tuple(e for e in g_exts if e not in exts)
            if rest:
                kept.append((rest, g_pats))
        kept.append((exts, list(patterns)))
        return LanguageRegistry(kept)

    def extensions(self) -> list[str]:
        return [e for exts, _ in self.groups for e in exts]

    def patterns_for(self, ext: str) -> list[tuple[str, str]]:
        for exts, pats in self.groups:
            if ext in exts:
                return pats
        return []


DEFAULT_REGISTRY = LanguageRegistry()


def _language_symbols(content: Column, patterns: list[tuple[str, str]]) -> Column:
    def prefixed(kind: str):
        return lambda x: F.concat(F.lit(kind + " "), x)

    per_kind = [
        F.transform(F.regexp_extract_all(content, F.lit(jvm_pattern(p)), F.lit(1)), prefixed(kind))
        for kind, p in patterns
    ]
    return F.array_distinct(F.flatten(F.array(*per_kind)))


def regex_symbols(relative, content, registry: LanguageRegistry = DEFAULT_REGISTRY) -> Column:
    """array<string> of distinct symbols in first-seen order; [] for unknown extensions.

    One CASE over the extension: only the matching branch is evaluated, and each
    pattern is a literal, so it is compiled once per task.
    """
    ext = file_ext(relative)
    c = col(content)
    expr = None
    for exts, pats in registry.groups:
        cond = ext.isin(*exts)
        branch = _language_symbols(c, pats)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return expr.otherwise(F.array().cast("array<string>"))
