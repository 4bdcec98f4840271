"""Rust text without comments and literals, as a parallel prefix over an automaton with counters.

Whether a place of a Rust file is code, string, raw string or comment depends on all text
before it.  A file is cut at line ends into chunks of about ``CHUNK`` characters, and every
chunk is turned into a map from the mode at its start to the mode at its end (``mode_map``):
one entry for code, one for strings, one per number of hashes of raw strings, and one per
nesting depth of block comments that the chunk closes, with the net depth for all deeper
ones.  Maps are composed in chunk order, which gives each chunk the mode it starts in, and
all chunks are then cleaned on their own (``clean``).  Depth is counted, so any nesting is
right, and a huge file is many tasks; the composition reads one small row per chunk.  Files
of one chunk start in code and need no map.

Cleaned text has as many newlines as the original.  A comment is a space, an outer doc
comment ``///``, a string or character literal ``"``; an attribute keeps only its brackets
(``#[]``), and an impl header none, both at any nesting depth.

Chunks end after lines that end a statement or block, or a row of data ending in a comma, so an item's
keyword and name, an impl header or a macro opener lie in one chunk.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: a chunk goes on to the next line end that is safe to cut at
CUT = (r"(?s).{1," + str(CHUNK) + r"}(?:.*?(?:[;{}]|\n[ \t]*+[-0-9\"'(\[&][^\n]*,)[ \t\r]*\n|.*+)")

#: modes: code, string, raw string of k hashes (even), block comment of depth d (odd)
CODE, STRING = 0, 1


def _raw(k: int) -> int:
    return 2 + 2 * k


def _comment(d: int) -> int:
    return 1 + 2 * d


EVENT = re.compile(r"""//[^\n]*+|/\*|\b[bc]?r(\#*+)"|"|'(?:[^'\\\n]|\\'|\\[^\n']{1,10}+)'""")
STRING_END = re.compile(r'(?:[^"\\]++|\\[\s\S])*+"')
COMMENT_EDGE = re.compile(r"/\*|\*/")
QUOTE = re.compile(r'"(#*+)')
BRACKET = re.compile(r"[\[\]]")
HEADER_EDGE = re.compile(r"[\[\]{;]")
CONSTRUCT = re.compile(r"\#!?\[|\bimpl\b")
NO_BRACKETS = str.maketrans("[];", "(),")


def _leave(text: str, at: int, mode: int) -> tuple[int, int]:
    """(place, mode) where a literal or comment ends in ``text``; (length, mode) if it does not."""
    if mode == STRING:
        m = STRING_END.match(text, at)
        return (m.end(), CODE) if m else (len(text), mode)
    if mode % 2 == 0:
        end = '"' + "#" * (mode // 2 - 1)
        to = text.find(end, at)
        return (to + len(end), CODE) if to >= 0 else (len(text), mode)
    depth = mode // 2
    for m in COMMENT_EDGE.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end(), CODE
    return len(text), _comment(depth)


def _enter(m: re.Match) -> int:
    """The mode after an event."""
    token = m.group()
    if token == "/*":
        return _comment(1)
    if token[0] in "/'":
        return CODE
    return STRING if token == '"' else _raw(len(m.group(1)))


def end_mode(text: str, at: int, mode: int, known: dict[int, int]) -> int:
    """The mode at the end of ``text``; ``known`` remembers it by places that are code."""
    seen = []
    while True:
        if mode == CODE:
            if at in known:
                mode = known[at]
                break
            seen.append(at)
            m = EVENT.search(text, at)
            if not m:
                break
            at, mode = m.end(), _enter(m)
        else:
            at, mode = _leave(text, at, mode)
            if mode != CODE:
                break
    known.update(dict.fromkeys(seen, mode))
    return mode


def mode_map(text: str) -> tuple[int, int, list[int], list[int], int]:
    """End modes by start mode: code, string, raw strings by hashes, comments by depth, and the net depth.

    Raw strings of more hashes and comments of more depth than listed are not left in ``text``.
    """
    known: dict[int, int] = {}
    code = end_mode(text, 0, CODE, known)
    string = end_mode(text, 0, STRING, known)
    raw: list[int] = []
    for m in QUOTE.finditer(text):
        while len(raw) <= len(m.group(1)):
            raw.append(end_mode(text, m.start() + 1 + len(raw), CODE, known))
    left: list[int] = []
    depth = 0
    for m in COMMENT_EDGE.finditer(text):
        depth += 1 if m.group() == "/*" else -1
        if depth < -len(left):
            left.append(end_mode(text, m.end(), CODE, known))
    return code, string, raw, left, depth


def then(mode: int, chunk: tuple[int, int, list[int], list[int], int]) -> int:
    """The mode after a chunk that starts in ``mode``."""
    code, string, raw, left, net = chunk
    if mode in (CODE, STRING):
        return string if mode == STRING else code
    if mode % 2 == 0:
        k = mode // 2 - 1
        return raw[k] if k < len(raw) else mode
    depth = mode // 2
    return left[depth - 1] if depth <= len(left) else _comment(depth + net)


def clean(text: str, mode: int = CODE) -> str:
    """``text`` that starts in ``mode``, without comments and literals."""
    out, at = [], 0
    while True:
        if mode != CODE:
            to, mode = _leave(text, at, mode)
            out.append("\n" * text.count("\n", at, to))
            at = to
            if mode != CODE:
                break
        m = EVENT.search(text, at)
        if not m:
            out.append(text[at:])
            break
        out.append(text[at:m.start()])
        token, at, mode = m.group(), m.end(), _enter(m)
        if token[0] != "/":
            out.append('"')
        elif token == "/*":
            head = text[m.start():m.start() + 4]
            out.append("///" if head.startswith("/**") and head not in ("/***", "/**/") else " ")
        else:
            out.append("///" if token.startswith("///") and not token.startswith("////") else " ")
    return _without_brackets("".join(out))


def _without_brackets(text: str) -> str:
    """Attributes as ``#[]`` and impl headers with round brackets; brackets are counted."""
    out, at = [], 0
    while m := CONSTRUCT.search(text, at):
        out.append(text[at:m.start()])
        end, depth = len(text), 0 if m.group() == "impl" else 1
        for d in (HEADER_EDGE if m.group() == "impl" else BRACKET).finditer(text, m.end()):
            depth += {"[": 1, "]": -1}.get(d.group(), 0)
            if m.group() == "impl" and d.group() in "{;" and depth <= 0:
                end = d.start()
                break
            if m.group() != "impl" and not depth:
                end = d.end()
                break
        part = text[m.start():end]
        out.append(part.translate(NO_BRACKETS) if m.group() == "impl" else m.group() + "]" + "\n" * part.count("\n"))
        at = end
    out.append(text[at:])
    return "".join(out)


def _maps(batches):
    for batch in batches:
        rows = [mode_map(t) for t in batch["text"].to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch["path"], batch["chunk"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                         ["path", "chunk", "code", "string", "raw", "left", "net"])


def _compose(batches):
    path, mode = None, CODE
    for batch in batches:
        starts = []
        for row in batch.to_pylist():
            if row["path"] != path:
                path, mode = row["path"], CODE
            starts.append(mode)
            mode = then(mode, (row["code"], row["string"], row["raw"], row["left"], row["net"]))
        yield pa.RecordBatch.from_arrays([batch["path"], batch["chunk"], pa.array(starts, pa.int64())], ["path", "chunk", "mode"])


def _cleaner(batches):
    for batch in batches:
        texts = [None if t is None else clean(t, m) for t, m in zip(batch["text"].to_pylist(), batch["mode"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names if c not in ("text", "mode")], pa.array(texts, pa.string())],
                                         [*[c for c in batch.schema.names if c not in ("text", "mode")], "text"])


def clean_chunks(files: DataFrame, carry: list[str], n: int) -> DataFrame:
    """path, ``carry`` (on the first chunk), chunk, text: the cleaned chunks of files (path, content)."""
    names = [F.col(c) for c in carry]
    whole = F.col("content").isNull() | (F.length("content") <= CHUNK)
    small = files.where(whole).select("path", *names, F.lit(0).alias("chunk"), F.lit(CODE).cast("long").alias("mode"),
                                      F.col("content").alias("text"))
    pieces = files.where(~whole).select("path", *names, F.posexplode(F.filter(
        F.regexp_extract_all("content", F.lit(CUT), F.lit(0)), lambda x: x != "")).alias("chunk", "text"))
    pieces = pieces.repartition(n, "path", "chunk")
    maps = pieces.select("path", "chunk", "text").mapInArrow(
        _maps, "path string, chunk int, code long, string long, raw array<long>, left array<long>, net long")
    modes = maps.repartition(n, "path").sortWithinPartitions("path", "chunk").mapInArrow(_compose, "path string, chunk int, mode long")
    first = F.col("chunk") == 0
    big = pieces.join(modes, ["path", "chunk"]).select(
        "path", *[F.when(first, c).alias(c_) for c, c_ in zip(names, carry, strict=True)], "chunk", "mode", "text")
    every = small.union(big)
    fields = [f for f in every.schema.fields if f.name not in ("text", "mode")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"
    return every.mapInArrow(_cleaner, schema)
