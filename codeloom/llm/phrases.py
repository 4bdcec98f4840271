"""Phrase collocations per language by Toivonen's method: a sample proposes, a full pass counts, failures expand.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``; a phrase is up to three words running inside one piece.

1. A quarter of the texts (by hash) is mined at ``SAMPLE_LEAST``: its words and pairs that are
   frequent there are the proposal.
2. One pass over all texts counts the proposal and its negative border: every word, every
   pair of proposed words, every triple of proposed pairs.
3. A border phrase that reaches ``LEAST`` was missed by the sample.  It joins the proposal, and a
   further pass counts the phrases that only now have all their parts in it.  Passes repeat until
   no border phrase fails (at most three full passes, as words are all counted in the first).
4. The passes so far count keys of ``KEY_BITS`` bits.  Phrases that share a key only add up, so the keys
   that reach ``LEAST`` hold every frequent phrase.  A last pass counts the phrases of these keys by
   their text: the frequent phrases and their counts are exact.

Proposal and reached keys travel as bitmaps of hashed phrases: at most ``MAX_BITS`` bits whatever the input.
A hash collision proposes a phrase too many, which is then counted and dropped; it never loses one.
Bits are only ever added, so a key is counted in exactly one pass.

Scale: most phrases are rare, and these never leave a task as text.  A task sends its keys with their
counts in sorted blocks, one for each of ``BUCKETS`` ranges of keys, about five bytes a key; Spark groups
the blocks by range, and a group is summed by one sort.  In the last pass a task sends each phrase of
``HELD`` counted ones once, and Spark adds counts by phrase text with map-side combine.  Tables of frequent
phrases meet by broadcast while their counted rows are few, else by keys salted ``SALTS`` ways.
The first phrases of a language are cut by a limit in each task before they meet.

Defined results: a long text is cut behind breaks and counted in parts; null or empty text has no words; null lang is ``und``; null or repeated
doc_ids and repeated rows count as often as they occur; ties go by phrase in byte order; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.frames import BROADCAST_ROWS, small
from codeloom.llm.substring_dedup import chunks
from codeloom.llm.wordscan import Words, mix, window_hash
from codeloom.session import materialize

LEAST = 10
TOP = 2000
#: a candidate goes if a longer one around it has this share (percent) of its count
COVERED = 50
LONGEST = 3
SAMPLE = 4
SAMPLE_LEAST = 2
MAX_BITS = 1 << 27
BITS_A_PHRASE = 12
SALTS = 8
#: bytes of text counted at once: index arrays take some forty times as much
CHUNK = 1 << 20
#: keys, and counted phrases, that a task holds before it merges and sends them, and chunks of text
HELD_KEYS = 1 << 20
HELD = 1 << 21
HELD_CHUNKS = 8
#: a key is the bucket and 32 bits within it
BUCKETS = 1 << 9
KEY_BITS = 41
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BETWEEN = BREAK.copy()
BETWEEN[[9, 32]] = True
COUNTS = "lang string, k int, phrase string, f long"
BLOCKS = "k int, bucket int, keys binary, counts binary"
REACHED = "k int, bucket int, keys binary, n long"


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) & np.uint64(bits - 1)).astype(np.int64)


def _lang_hash(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode("utf-8", "surrogatepass")) + 1], np.uint64))[0]


def _held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _texts_of(words: Words, first: np.ndarray, k: int) -> pa.Array:
    """The phrases of ``k`` words from word ``first``, joined by one space."""
    begin, end = words.start[first], words.end[first + k - 1]
    odd = np.zeros(len(first), bool)
    for j in range(1, k):
        odd |= words.start[first + j] - words.end[first + j - 1] != 1
    length = end - begin
    stop = np.cumsum(length)
    # places within a chunk fit 32 bits
    place = np.repeat((begin - stop + length).astype(np.int32), length)
    place += np.arange(len(place), dtype=np.int32)
    data = words.raw[place]
    data[data == 9] = 32
    plain = pa.Array.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(np.concatenate(([0], stop)).astype(np.int64)), pa.py_buffer(data)])
    if odd.any():  # several spaces or tabs between two words
        own = [b" ".join(words.raw[words.start[i + j]:words.end[i + j]].tobytes() for j in range(k)) for i in first[odd].tolist()]
        values = np.array(plain.to_pylist(), dtype=object)
        values[odd] = own
        plain = pa.array(values.tolist(), pa.large_binary())
    return plain.cast(pa.large_string()).cast(pa.string())


def _phrases(part: pa.RecordBatch):
    """(words, lang number of each word, language names, hashes by k, whether a phrase of k words starts here)."""
    words = Words(part["text"], lower=True, separator=BETWEEN)
    names, code = np.unique(np.array(part["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    of = np.repeat(code, words.counts)
    salt = np.array([_lang_hash(x) for x in names], np.uint64)
    piece = np.cumsum(BREAK[words.raw], dtype=np.int32)[words.start] if len(words.start) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    h = words.hashes()
    hashes, whole = {}, {}
    for k in range(1, LONGEST + 1):
        n = max(len(h) - k + 1, 0)
        hashes[k] = window_hash(h, k) ^ salt[of[:n]] if n else np.zeros(0, np.uint64)
        whole[k] = (piece[k - 1:] == piece[:n]) & (text[k - 1:] == text[:n]) if n else np.zeros(0, bool)
    return words, of, names, hashes, whole


def _proposed(hashes, bitmap: np.ndarray, k: int) -> np.ndarray:
    """Whether both parts of ``k - 1`` words of every phrase are in the bitmap."""
    if not len(hashes[k]):
        return np.zeros(0, bool)
    inside = _held(bitmap, _slots(hashes[k - 1], len(bitmap) * 8))
    return inside[:-1] & inside[1:]


def _wanted(hashes, whole, k: int, proposal=None, before=None) -> np.ndarray:
    """Where the phrases of ``k`` words start: all, or those whose parts are in ``proposal`` and were not in ``before``."""
    at = whole[k]
    if k > 1 and proposal is not None:
        at = at & _proposed(hashes, proposal.value, k)
        if before is not None:
            at &= ~_proposed(hashes, before.value, k)
    return np.flatnonzero(at)


def _merged(packed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts up to 255) of keys packed with their counts in the lowest byte."""
    both = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.uint64)
    keys = both >> np.uint64(8)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat(both & np.uint64(255), first) if len(keys) else both
    return keys[first], np.minimum(counts, np.uint64(255)).astype(np.uint8)


def _blocks(k: int, packed: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = _merged(packed)
    cuts = np.searchsorted(keys, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32))
    binary = lambda values, size: pa.Array.from_buffers(pa.binary(), BUCKETS, [
        None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(values)])
    block = pa.RecordBatch.from_arrays([pa.array(np.full(BUCKETS, k), pa.int32()), pa.array(np.arange(BUCKETS), pa.int32()),
                                        binary(keys.astype(np.uint32), 4), binary(counts, 1)], ["k", "bucket", "keys", "counts"])
    return block.filter(pa.array(np.diff(cuts) > 0))


def _key_counter(levels: tuple[int, ...], proposal=None, before=None):
    """Counts the keys of the phrases of ``levels`` (see ``_wanted``)."""
    def run(batches):
        held, n = {k: [] for k in levels}, 0
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                _, _, _, hashes, whole = _phrases(part)
                for k in levels:
                    keys = mix(hashes[k][_wanted(hashes, whole, k, proposal, before)]) & np.uint64((1 << KEY_BITS) - 1)
                    keys, f = np.unique(keys, return_counts=True)
                    held[k].append(keys << np.uint64(8) | np.minimum(f, 255).astype(np.uint64))
                    n += len(keys)
                if n >= HELD_KEYS:
                    yield from (_blocks(k, packed) for k, packed in held.items())
                    held, n = {k: [] for k in levels}, 0
        yield from (_blocks(k, packed) for k, packed in held.items())
    return run


def _reaching(least: int):
    """The keys of a bucket whose counts add up to ``least``: more, never fewer, beyond 255."""
    def run(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32).astype(np.uint64)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8)
        keys, counts = _merged([keys << np.uint64(8) | counts])
        keys = keys[counts >= min(least, 255)].astype(np.uint32)
        return pa.table({"k": table["k"][:1], "bucket": table["bucket"][:1], "keys": pa.array([keys.tobytes()], pa.binary()),
                         "n": pa.array([len(keys)], pa.int64())})
    return run


def _count_keys(texts: DataFrame, least: int, levels, proposal=None, before=None) -> DataFrame:
    """The keys that reach ``least``, by level and bucket."""
    blocks = texts.mapInArrow(_key_counter(levels, proposal, before), BLOCKS)
    return blocks.groupBy("k", "bucket").applyInArrow(_reaching(least), REACHED).where("n > 0")


def _unproposed(proposal):
    """Reached keys of words and pairs that are not in ``proposal``."""
    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x, np.uint32) for x in batch["keys"].to_pylist()]
            found = [x[~_held(proposal.value, x.astype(np.int64) & (len(proposal.value) * 8 - 1))] for x in found]
            missed = pa.RecordBatch.from_arrays([batch["k"], batch["bucket"], pa.array([x.tobytes() for x in found], pa.binary()),
                                                 pa.array([len(x) for x in found], pa.int64())], ["k", "bucket", "keys", "n"])
            yield missed.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))
    return run


def _counter(reached):
    """Counts the phrases whose keys and parts are in the bitmap ``reached``, and all words under k = 0."""
    def send(held):
        parts, langs = [x[0] for x in held], [x[1] for x in held]
        for k in range(1, LONGEST + 1):
            h, f, first = (np.concatenate([x[2][k][i] for x in held]) for i in range(3))
            of = np.repeat(np.arange(len(held)), [len(x[2][k][0]) for x in held])
            _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
            f = np.bincount(inverse, f, len(one)).astype(np.int64)
            for i in range(len(held)):
                mine = np.flatnonzero(of[one] == i)
                at = first[one[mine]]
                names, code = langs[i]
                yield _counts(pa.array(names, pa.string()).take(pa.array(code[at])), k, _texts_of(parts[i], at, k), f[mine])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                words, of, names, hashes, whole = _phrases(part)
                names = names.tolist()
                # with the number of words under k = 0
                yield _counts(pa.array(names, pa.string()), 0, pa.array([""] * len(names), pa.string()), np.bincount(of, minlength=len(names)))
                counted = {}
                for k in range(1, LONGEST + 1):
                    at = _wanted(hashes, whole, k, reached)
                    at = at[_held(reached.value, _slots(hashes[k][at], len(reached.value) * 8))]
                    h, first, f = np.unique(hashes[k][at], return_index=True, return_counts=True)
                    counted[k] = h, f.astype(np.int32), at[first].astype(np.int32)
                    n += len(h)
                held.append((words, (names, of), counted))
                if n >= HELD or len(held) >= HELD_CHUNKS:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)
    return run


def _counts(lang: pa.Array, k: int, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(f), k), pa.int32()), phrase, pa.array(f, pa.int64())],
                                      ["lang", "k", "phrase", "f"])


def _marker(bits: int):
    """Bitmap parts (chunk of 2^16 bits, bytes) of keys."""
    def run(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for keys in batch["keys"].to_pylist():
                slots = np.frombuffer(keys, np.uint32).astype(np.int64) & (bits - 1)
                np.bitwise_or.at(bitmap, slots >> 3, (np.uint8(1) << (slots & 7).astype(np.uint8)))
        step = min(1 << 13, len(bitmap))
        chunk = bitmap.reshape(-1, step)
        held = np.flatnonzero(chunk.any(axis=1))
        for some in np.array_split(held, len(held) // 128 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk[i].tobytes() for i in some], pa.binary())],
                                             ["chunk", "bits"])
    return run


def _bits(keys: DataFrame) -> int:
    bits, n = 1 << 16, keys.agg(F.sum("n")).first()[0] or 0
    while bits < min(MAX_BITS, BITS_A_PHRASE * n):
        bits *= 2
    return bits


def _bitmap(keys: DataFrame, bits: int, base: np.ndarray | None = None) -> np.ndarray:
    """Bitmap of ``keys`` on top of ``base``: ``bits`` bits, whatever the input."""
    out = np.zeros(bits // 8, np.uint8) if base is None else base.copy()
    # at most 2 tasks, so the parts are at most twice the bitmap
    parts = keys.select("keys").coalesce(2).mapInArrow(_marker(bits), "chunk long, bits binary")
    for r in parts.collect():
        step = len(r["bits"])
        out[r["chunk"] * step:(r["chunk"] + 1) * step] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """(lang, k, phrase, f): all phrases of up to three words with f >= ``least``, and words in all under k = 0.

    ``docs`` has lang and text, neither null.
    """
    spark = docs.sparkSession
    part = docs.where(F.pmod(F.xxhash64("text", "lang"), F.lit(sample)) == 0)
    proposal = materialize(_count_keys(part, sample_least, (1, 2)), "phrase-proposal")
    bits = _bits(proposal)
    bitmap = _bitmap(proposal, bits)
    before, levels, reached = None, (1, 2, 3), None
    while True:
        shipped = spark.sparkContext.broadcast(bitmap)
        more = materialize(_count_keys(docs, least, levels, shipped, before), "phrase-keys")
        reached = more if reached is None else reached.unionByName(more)
        # the border phrases of this pass that are frequent after all; triples have no extension
        failed = materialize(more.where("k < 3").mapInArrow(_unproposed(shipped), REACHED), "phrase-failures")
        if failed.isEmpty():
            break
        before, levels, bitmap = shipped, (2, 3), _bitmap(failed, bits, bitmap)
    shipped = spark.sparkContext.broadcast(_bitmap(reached, _bits(reached)))
    counted = docs.mapInArrow(_counter(shipped), COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counted.where((F.col("f") >= least) | (F.col("k") == 0)), "phrase-counts")


def _salted(left: DataFrame, right: DataFrame, rows: int, keys: list[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` (``rows`` rows, one a key): broadcast, or by salted keys beyond the bound."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    again = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.withColumn("salt", salt).join(again, [*keys, "salt"], how).drop("salt")


def _part(k: int, at: int) -> tuple[Column, Column]:
    """The first ``at`` words of a phrase of ``k``, and the rest."""
    words = F.split("phrase", " ")
    return (F.array_join(F.slice(words, 1, at), " "), F.array_join(F.slice(words, at + 1, k - at), " "))


def _parts_of(text: Column) -> Column:
    """A text, or if it is long its parts of about ``CHUNK`` characters, cut behind breaks: no phrase runs over these."""
    cut = r"(?s).{1," + str(CHUNK) + r"}[^.,;:!?\x0A-\x0D]*+(?:[.,;:!?\x0A-\x0D]|\z)"
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def collocations(df: DataFrame, top: int = TOP, least: int = LEAST, lang: str = "lang", text: str = "text", **sampling) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(_parts_of(whole)).alias("text"))
    found = frequent_phrases(docs, least, **sampling)
    rows = found.count()
    parts = found.where("k in (1, 2)").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    cuts = None
    for k in range(2, LONGEST + 1):
        for at in range(1, k):
            first, rest = _part(k, at)
            one = found.where(F.col("k") == k).select("lang", "k", "phrase", F.col("f").alias("a"), F.lit(at).alias("cut"),
                                                      first.alias("first"), rest.alias("rest"))
            cuts = one if cuts is None else cuts.union(one)
    cuts = _salted(cuts, parts.select("lang", F.col("part").alias("first"), F.col("of").alias("l")), rows, ["lang", "first"], "inner")
    cuts = _salted(cuts, parts.select("lang", F.col("part").alias("rest"), F.col("of").alias("r")), rows, ["lang", "rest"], "inner")
    # decimal products are exact for counts under 10^15
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = (cuts.withColumn("share", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"))
            .withColumn("expected", exact("l") * exact("r")).withColumn("score", F.expr("share div expected")))
    best = cuts.groupBy("lang", "k", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    triples = found.where("k = 3")
    around = triples.select("lang", F.explode(F.array(_part(3, 2)[0], _part(3, 1)[1])).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        (F.col("k") == LONGEST) | F.col("around").isNull() | (100 * F.col("around") < COVERED * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = small(found.where("k = 0").select("lang", F.col("f").alias("n")))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
        "n", F.col("best.score").cast("long").alias("score"))


def oracle_sql(top: int = TOP, least: int = LEAST) -> str:
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(
       regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[.,;:!?\\x0A-\\x0D]'), lambda p: regexp_extract_all(p, '[^\\x20\\x09]+'))) AS w FROM documents),
grams AS (SELECT lang, unnest([1, 2, 3]) AS k, w FROM pieces),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
       lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM grams WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= {least}),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, c.cut,
       ((1000000 * c.a::HUGEINT * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c
       JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') AND x.k = c.cut
       JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') AND y.k = c.k - c.cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, phrase, max(a) AS around FROM (
       SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around USING (lang, phrase) WHERE k = 3 OR around IS NULL OR 100 * around < {COVERED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
