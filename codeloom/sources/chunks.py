"""Chunked file tables: files as rows of bounded bytes, with decoding that carries state across chunk edges.

A chunk table has ``path, relative, chunk, before, bytes, last`` and ``error``: chunk number
``chunk`` of a file holds at most ``size`` bytes, ``before`` the (at most) three bytes in front
of them, and ``last`` marks the final one.  No row grows with its file, and a large file is
read, checked and decoded by many tasks.

UTF-8 is self-synchronising, so three bytes are all the state that a decoder carries: the
unfinished character at the end of the chunk before (``_unfinished``) is put in front, and
the chunk's own unfinished end is left to the next.  Every operator is then a projection of
single rows and a map-side combined aggregate by file.

Empty files are one chunk without bytes; a file that cannot be read is one chunk with ``error``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SCHEMA = "path string, relative string, chunk long, before binary, bytes binary, last boolean, error string"

# the start of a character of two to four bytes whose end is missing, as upper-case hex at the end of a chunk
UNFINISHED = (r"(?:(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])"
              r"|(?:E0[AB][0-9A-F]|E[1-9A-CEF][89AB][0-9A-F]|ED[89][0-9A-F]|F0[9AB][0-9A-F]|F[1-3][89AB][0-9A-F]|F48[0-9A-F])"
              r"|(?:F0[9AB][0-9A-F]|F[1-3][89AB][0-9A-F]|F48[0-9A-F])[89AB][0-9A-F])$")
REPLACEMENT = "�"


def chunk_table(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of a file table (path, relative, content as binary, and error if it has one)."""
    if size < 4:
        raise ValueError("chunks hold at least four bytes")
    error = F.col("error") if "error" in files.columns else F.when(F.col("content").isNull(), F.lit("unreadable"))
    length = F.coalesce(F.octet_length("content"), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size))
    rows = files.select("path", "relative", "content", error.alias("error"), length.alias("length"), F.posexplode(starts).alias("chunk", "at"))
    content = F.coalesce("content", F.lit(b""))
    back = F.least("at", F.lit(3))
    return rows.select("path", "relative", F.col("chunk").cast("long").alias("chunk"),
                       F.substring(content, F.col("at") - back + 1, back).alias("before"),
                       F.substring(content, F.col("at") + 1, F.lit(size)).alias("bytes"),
                       (F.col("at") + size >= F.col("length")).alias("last"), "error")


def _span_reader(size: int):
    """Chunks of spans (path, relative, first, until, final, error): a file is opened once a span."""
    def run(batches):
        import pyarrow as pa
        names = ["path", "relative", "chunk", "before", "bytes", "last", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.string()]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for spans in batches:
            for r in spans.to_pylist():
                data, err = b"", r["error"]
                base = max(r["first"] * size - 3, 0)
                if err is None:
                    try:
                        with open(r["path"], "rb") as fh:
                            fh.seek(base)
                            data = fh.read((r["until"] + 1) * size - base)
                    except OSError as e:
                        data, err = b"", str(e)
                for chunk in range(r["first"], r["until"] + 1):
                    at = chunk * size - base
                    rows.append((r["path"], r["relative"], chunk, data[max(at - 3, 0):at], data[at:at + size], chunk == r["final"], err))
                    held += size
                    if held >= CHUNK_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()
    return run


def scan_chunks(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None,
                size: int = CHUNK_BYTES, target_bytes: int = 128 << 20) -> DataFrame:
    """The chunk table of a directory tree: listed on the executors, and read by byte ranges."""
    from codeloom.operators.filters import exclude_matches, include_matches
    from codeloom.sources.filetree import list_files
    from codeloom.sources.tables import parallelism
    meta = list_files(spark, os.fspath(root))
    if exclude:
        meta = meta.filter(~exclude_matches("relative", exclude))
    if include:
        meta = meta.filter(include_matches("relative", include))
    total = meta.agg(F.sum("size")).first()[0] or 0
    n = max(int(total // target_bytes) + 1, parallelism(spark))
    # consecutive small chunks are read together
    span = max(CHUNK_BYTES // size, 1)
    final = F.greatest(F.floor((F.coalesce("size", F.lit(0)) - 1) / size), F.lit(0)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("final"), F.lit(span).cast("long"))
    spans = meta.select("path", "relative", final.alias("final"), "error").select(
        "path", "relative", F.explode(starts).alias("first"), "final", "error").withColumn(
        "until", F.least(F.col("first") + span - 1, "final"))
    return spans.repartition(n, "path", "first").mapInArrow(_span_reader(size), SCHEMA)


# ---------------------------------------------------------------- decoding

def _unfinished(data: Column) -> Column:
    """Bytes of the unfinished character at the end (0 to 3)."""
    tail = F.hex(F.substring(data, F.greatest(F.octet_length(data) - 2, F.lit(1)), F.lit(3)))
    # the longest start counts: of four bytes before three before two
    pairs = F.when(F.octet_length(data) == 0, F.lit("")).otherwise(tail)
    found = [F.regexp_extract(F.substring(pairs, -2 * k, 2 * k), "^" + UNFINISHED, 0) for k in (3, 2, 1)]
    return F.coalesce(*[F.when(F.length(x) == 2 * k, F.lit(k)) for k, x in zip((3, 2, 1), found, strict=True)], F.lit(0))


def aligned(before: str = "before", data: str = "bytes", last: str = "last") -> Column:
    """The chunk's bytes from and to character edges: with the unfinished end before it, and without its own
    unless the file ends here."""
    b, c = F.col(before), F.col(data)
    front, back = _unfinished(b), F.when(F.col(last), F.lit(0)).otherwise(_unfinished(c))
    head = F.substring(b, F.octet_length(b) - front + 1, front)
    return F.concat(head, F.substring(c, F.lit(1), F.octet_length(c) - back))


def read_strict(chunks: DataFrame) -> DataFrame:
    """S3 on chunks: every chunk's text, null (and an error) where the file's bytes are not UTF-8 there."""
    text = F.try_validate_utf8(aligned().cast("string"))
    error = F.coalesce("error", F.when(text.isNull(), F.lit("stream did not contain valid UTF-8")))
    return chunks.select("path", "relative", "chunk", F.when(F.col("error").isNull(), text).alias("text"), error.alias("error"))


def read_lossy(chunks: DataFrame) -> DataFrame:
    """S4 on chunks: every chunk's text with invalid sequences replaced, as if the file were decoded whole."""
    return chunks.select("path", "relative", "chunk",
                         F.when(F.col("error").isNull(), F.make_valid_utf8(aligned().cast("string"))).alias("text"), "error")


def file_facts(chunks: DataFrame, prefix: int | None = None, size: int = CHUNK_BYTES) -> DataFrame:
    """Per file: relative, size, is_binary (S5, in the first ``prefix`` bytes), valid (S3), total_lines (P3) and error.

    ``size`` is the chunk size of the table.  One narrow row per chunk is shuffled, after a map-side combine.
    """
    c = F.col("bytes")
    length = F.octet_length(c).cast("long")
    seen = c if prefix is None else F.substring(c, F.lit(1), F.least(F.greatest(
        F.lit(prefix) - F.col("chunk") * size, F.lit(0)), length).cast("int"))
    per = chunks.select(
        "path", "relative", "chunk", length.alias("n"), "error", "last",
        (_occurrences(seen, "00") > 0).alias("nul"), _occurrences(c, "0A").alias("newlines"),
        F.try_validate_utf8(aligned().cast("string")).isNotNull().alias("valid"),
        (F.col("last") & (length > 0) & (F.substring(c, length.cast("int"), F.lit(1)) != F.lit(b"\n"))).alias("open"))
    ok = F.max("error").isNull()
    facts = per.groupBy("path", "relative").agg(
        F.when(ok, F.sum("n")).alias("size"), F.when(ok, F.bool_or("nul")).alias("is_binary"), F.when(ok, F.bool_and("valid")).alias("valid"),
        F.when(ok, F.sum("newlines") + F.max(F.col("open").cast("long"))).alias("total_lines"), F.max("error").alias("error"))
    return facts


def _occurrences(data: Column, byte: str) -> Column:
    """How often a byte (two hex digits) occurs."""
    # ISO-8859-1 has one character per byte, so the count is that of characters removed
    text = F.decode(data, "ISO-8859-1")
    return (F.length(text) - F.length(F.replace(text, F.lit(chr(int(byte, 16))), F.lit("")))).cast("long")
