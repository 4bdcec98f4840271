"""Substring dedup: remove words covered by a window of ``WINDOW`` words that also starts earlier.

Difference-cover anchors.  ``COVER`` is a difference cover modulo ``PERIOD``: for any
two positions p, q there is a shift d < PERIOD with (p + d) and (q + d) both in the
cover.  So two equal windows share an anchor of ``WINDOW - PERIOD + 1`` words at the
same shift, and it is enough to hash anchors at cover positions (4 of 13).

Copies of a whole earlier text are settled first: every window of theirs starts earlier
there.  For the other texts:

1. Every document sends the distinct hashes of its anchors; hashes that two or more
   documents send (or that repeat inside one) are repeated.
2. Extension: windows around a repeated anchor, and only those, send their full hash
   (96 bits); all but the first occurrence of a hash are copies.  A document sends
   each hash once; later occurrences inside it are copies already.
3. Copies are gathered by document and their words removed.

Scale: text is shuffled once (by doc_id) and reused by the three steps; digests of texts are
compared by a map-side combined minimum; anchors are
8 + 8 bytes each, three tenths of the words; only windows near repeated anchors
travel.  A hash has at most one row per document, and ranks stream over sorted rows,
so no group is held in memory and no pairs are made.

Defined results: windows are ordered by (doc_id, start); a null doc_id counts as the
largest.  Rows with one doc_id are read as one document's versions: equal starts are
not earlier, so repeated rows are judged alike and keep their text.  Null or empty
text has no words; kept text is then empty.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.frames import partitions
from codeloom.llm.wordscan import Words, inside, window_hash

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
NULL_ID = (1 << 63) - 1
#: bytes of text scanned at once
CHUNK = 4 << 20


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """Slices of a batch with at most about ``limit`` bytes of text (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in text, hash) of all anchors."""
    start, text = inside(words.first, ANCHOR)
    place = start - words.first[text]
    chosen = np.isin(place % PERIOD, COVER)
    start, text, place = start[chosen], text[chosen], place[chosen]
    return text, place, window_hash(hashes, ANCHOR)[start] if len(start) else np.zeros(0, np.uint64)


def _send_anchors(batches):
    for batch in batches:
        for part in chunks(batch):
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            words = Words(part["text"])
            text, _, h = _anchors(words, words.hashes())
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[text[new]])],
                                             ["hash", "doc_id"])


def _candidates(part: pa.RecordBatch):
    """Windows near repeated anchors: (words, text, start, hash 1, hash 2, is the first such in its text)."""
    words = Words(part["text"])
    h = words.hashes()
    text, place, anchor = _anchors(words, h)
    lists = part["repeated"]
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    flat = np.asarray(lists.flatten()).view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # an anchor is repeated if another document has it or its own has it twice
    mark = np.zeros(len(anchor), bool)
    if len(anchor):
        order = np.lexsort((anchor, text))
        same = (anchor[order][1:] == anchor[order][:-1]) & (text[order][1:] == text[order][:-1])
        mark[order[1:]] |= same
        mark[order[:-1]] |= same
        if len(flat):
            key = np.rec.fromarrays([np.concatenate((owner, text)), np.concatenate((flat, anchor))], names="t,h")
            _, code = np.unique(key, return_inverse=True)
            told = np.zeros(code.max() + 1, bool)
            told[code[:len(flat)]] = True
            mark |= told[code[len(flat):]]
    begin, of = inside(words.first, WINDOW)
    if not len(begin) or not mark.any():
        e = np.zeros(0, np.int64)
        return words, e, e, e.view(np.uint64), e.view(np.uint64), np.zeros(0, bool)
    # window at s is a candidate if an anchor in s .. s + PERIOD - 1 is marked
    at = np.zeros(len(h) + 1, np.int64)
    at[words.first[text[mark]] + place[mark] + 1] = 1
    total = np.cumsum(at)
    near = total[np.minimum(begin + PERIOD, len(h))] - total[begin] > 0
    begin, of = begin[near], of[near]
    h1, h2 = window_hash(h, WINDOW)[begin], window_hash(h, WINDOW, 1)[begin]
    order = np.lexsort((begin, h1, of))
    first = np.ones(len(begin), bool)
    a, b = order[1:], order[:-1]
    first[a] = (h1[a] != h1[b]) | (of[a] != of[b]) | (h2[a] != h2[b])
    return words, of, begin - words.first[of], h1, h2, first


def _digest(part: pa.RecordBatch) -> np.ndarray:
    """Tells versions of one doc_id apart."""
    return np.array([zlib.crc32((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in part["text"]], dtype=np.uint32).view(np.int32)


def _send_windows(batches):
    for batch in batches:
        for part in chunks(batch):
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            _, of, start, h1, h2, first = _candidates(part)
            of, start, h1, h2 = of[first], start[first], h1[first], h2[first]
            version = _digest(part) if len(of) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array((h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)),
                 pa.array(ids[of]), pa.array(start.astype(np.int32)), pa.array(version[of] if len(of) else version)],
                ["h1", "h2", "doc_id", "start", "version"])


def _result(doc_id, n, removed, kept) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
         pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _kept_copies(part: pa.RecordBatch):
    """Copies of an earlier document's whole text: every window starts earlier there."""
    words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part["text"]]
    gone = [len(w) >= WINDOW for w in words]
    yield _result(part["doc_id"], [len(w) for w in words], [len(w) * g for w, g in zip(words, gone, strict=True)],
                  [b"" if g else b" ".join(w) for w, g in zip(words, gone, strict=True)])


def _kept(batches):
    for batch in batches:
        for part in chunks(batch):
            later_copy = part["later"].to_numpy(zero_copy_only=False).astype(bool)
            yield from _kept_copies(part.filter(pa.array(later_copy)))
            part = part.filter(pa.array(~later_copy))
            words, of, start, _, _, first = _candidates(part)
            version = _digest(part)
            covered = np.zeros(len(words.start) + 1, np.int64)

            def cover(begins, covered=covered):
                np.add.at(covered, begins, 1)
                np.add.at(covered, begins + WINDOW, -1)
            later = ~first
            if later.any():
                cover(words.first[of[later]] + start[later])
            for i, copies in enumerate(part["copies"]):
                if copies.is_valid:
                    begins = [c["start"] for c in copies.as_py() if c["version"] == version[i]]
                    if begins:
                        cover(words.first[i] + np.array(begins, dtype=np.int64))
            gone = np.cumsum(covered)[:-1] > 0
            n = words.counts
            removed, kept = [], []
            for i, text in enumerate(part["text"]):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                out = gone[words.first[i]:words.first[i + 1]]
                k = int(out.sum())
                if k:
                    own = [w for w, g in zip(own, out.tolist(), strict=True) if not g]
                removed.append(k)
                kept.append(b" ".join(own))
            yield _result(part["doc_id"], n, removed, kept)


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_text, kept_sha256."""
    n = partitions(df)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    rows = df.select(key.alias("doc_id"), F.col(text).cast("string").alias("text"),
                     F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256).alias("digest"))
    ids = rows.select("doc_id", "digest")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copied = (ids.join(first, "digest").where("doc_id > first").groupBy("doc_id")
              .agg(F.collect_set("digest").alias("copied")))
    texts = rows.repartition(n, "doc_id").join(copied, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False)).alias("later"))
    anchors = texts.where("not later").select("doc_id", "text").mapInArrow(_send_anchors, "hash long, doc_id long")
    many = Window.partitionBy("hash")
    repeated = (anchors.withColumn("n", F.count(F.lit(1)).over(many)).where("n > 1")
                .groupBy("doc_id").agg(F.collect_list("hash").alias("repeated")))
    marked = texts.join(repeated, "doc_id", "left")
    windows = marked.where("not later").select("doc_id", "text", "repeated").mapInArrow(
        _send_windows, "h1 long, h2 int, doc_id long, start int, version int")
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "start")
    copies = (windows.withColumn("place", F.rank().over(order)).where("place > 1")
              .groupBy("doc_id").agg(F.collect_list(F.struct("start", "version")).alias("copies")))
    out = marked.join(copies, "doc_id", "left").select("doc_id", "text", "later", "repeated", "copies").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
