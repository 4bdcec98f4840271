"""Benchmark decontamination by winnowing: least k-gram hashes of sliding windows, joined, then extended.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased; a window is ``WINDOW``
consecutive words of an item, or all words of a shorter one.

1. Documents are cut into segments of ``STEP`` words that overlap by ``WINDOW - 1``, so every window
   of a document lies in one segment, and a very long text is many rows.
2. Fingerprints: in every run of ``RUN`` words (fewer for items of fewer), the least hash of its runs of
   ``GRAM`` words.  Equal runs have equal fingerprints, so no shared window is missed.
3. Documents' fingerprints, each once a segment, meet the benchmark's.  Hits are extended: the windows with
   a fingerprint hit, and only those, are compared as whole texts, so what counts is equal word by word.
4. Windows that occur in the same items carry one key, and documents with the same keys share one
   list of items, so a passage held by many documents and items is never expanded into all pairs.

Everything is DataFrame functions.  Scale: rows are written once under a number of their own, and cut and
fingerprinted in one pass (about two fingerprints for five words); these meet the benchmark's by broadcast while
it is counted small, else by keys salted ``SALTS`` ways.  Texts are read again only for rows with hits, and
only matched windows travel after that.

Defined results: null or empty text has no words; an item without words is in no document; rows
with one doc_id are judged each on its own; items with one item_id count once; an item without
item_id marks words, but isn't listed or counted; without items the digest is that of the empty
string; extra columns are ignored; an empty table of documents gives an empty result, an empty
benchmark no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.frames import BROADCAST_ROWS, small
from codeloom.session import materialize

#: what is between the words of lower-cased text (a positive class; a negated one of ranges runs five times as long)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
GRAM = 4
RUN = 7
#: new words of a segment
STEP = 2048
SALTS = 8
WINDOW_TYPE = "array<struct<first:bigint,size:int,window:string>>"


def words_of(text: Column) -> Column:
    """The words of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is fast, and right for ASCII alone
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")  # none before, after or without a word


def _once(value: Column) -> Column:
    """``value`` computed once per row: the optimizer does not copy it through a generator."""
    return F.explode(F.array(value))


def segments(rows: DataFrame, text: str) -> DataFrame:
    """rows with text cut into: ..., n_words, begin (place of the first word, from 0) and list (the segment's words)."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != text]
    whole = rows.select(*others, _once(words_of(F.col(text))).alias("list"))
    n = F.size("list")
    many = F.transform(F.sequence(F.lit(0), n - 1, F.lit(STEP)), lambda at: F.struct(
        at.cast("long").alias("begin"), F.slice("list", at + 1, STEP + WINDOW - 1).alias("list")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("list")))
    return whole.select(*others, n.cast("long").alias("n_words"), F.explode(F.when(n <= STEP, one).otherwise(many)).alias("part")).select(
        *others, "n_words", "part.begin", "part.list")


def _doubled(rows: DataFrame, column: str, width: int, join) -> DataFrame:
    """``column`` with ``join`` of every ``width`` neighbours in place of the first: two overlapping halves at
    a time, so in log2(width) passes.  The last ``width - 1`` entries are of fewer neighbours."""
    others = [c for c in rows.columns if c != column]
    have = 1
    while have < width:
        step = min(have, width - have)
        both = F.zip_with(column, F.slice(column, F.lit(step + 1), F.size(column)), join)
        rows = rows.select(*others, _once(both).alias(column))
        have += step
    return rows


def runs_of(lengths: list[int]) -> list[int]:
    """Lengths of the runs whose fingerprints find windows of ``lengths`` words."""
    return sorted({min(RUN, m) for m in lengths})


def fingerprints(rows: DataFrame, runs: list[int]) -> DataFrame:
    """Segments (..., list) with ``f<m>``: the fingerprint of every run of m words, by its start."""
    for m in runs:
        k = min(GRAM, m)
        if k == 1:
            own = rows.select("*", _once(F.transform("list", lambda x: F.xxhash64(x))).alias("run"))
        else:
            own = _doubled(rows.withColumn("run", F.col("list")), "run", k, lambda a, b: F.xxhash64(a, b))
        own = _doubled(own, "run", m - k + 1, lambda a, b: F.least(a, b))
        rows = own.withColumn(f"f{m}", F.slice("run", F.lit(1), F.greatest(F.size("run") - (m - 1), F.lit(0)))).drop("run")
    return rows


def _windows(m: int, wanted) -> Column:
    """(first, size, window) of the runs of ``m`` words of ``list`` that start in the segment and have a wanted fingerprint."""
    last = F.least(F.size("list") - (m - 1), F.lit(STEP))
    runs = F.slice(f"f{min(RUN, m)}", F.lit(1), F.greatest(last, F.lit(0)))
    starts = F.filter(F.transform(runs, lambda h, i: F.when(wanted(h), i + 1)), lambda i: i.isNotNull())
    return F.transform(starts, lambda i: F.struct(
        (F.col("begin") + i - 1).alias("first"), F.lit(m).alias("size"), F.array_join(F.slice("list", i, F.lit(m)), " ").alias("window")))


def _among(m: int):
    return lambda h: F.array_contains("hits", F.struct(F.lit(min(RUN, m)).alias("size"), h.alias("hash")))


def _of_size(size: Column, lengths: list[int]) -> Column:
    """The fingerprint column of an item's own length."""
    out = F.array().cast("array<bigint>")
    for m in lengths:
        # as many as the item has windows
        out = F.when(size == m, F.slice(f"f{min(RUN, m)}", F.lit(1), F.least(F.size("list") - (m - 1), F.lit(STEP)))).otherwise(out)
    return out


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt: str) -> DataFrame:
    """``left`` joined with the written table ``right``: broadcast, or by salted keys beyond the bound."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    again = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(again, [*keys, "__salt"], how).drop("__salt")


def _set_of(column: str) -> list[Column]:
    """Three aggregates that tell sets of (distinct) values apart, with map-side combine."""
    h = F.xxhash64(column)
    return [F.count(F.lit(1)).alias("many"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("mixed")]


def _set_key() -> Column:
    return F.sha2(F.concat_ws(":", "many", "total", "mixed"), 256)


def decontaminate(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(rows, "winnow-rows")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    items = materialize(segments(items, "text").where("n_words > 0"), "winnow-items")
    own = F.least("n_words", F.lit(WINDOW))
    lengths = sorted(r["n"] for r in items.select(own.alias("n")).distinct().collect())  # at most WINDOW
    runs = runs_of(lengths)

    # the benchmark's fingerprints, and its windows as texts
    items = fingerprints(items, runs).withColumn("f", _of_size(own, lengths))
    marks = materialize(items.select(F.least(own, F.lit(RUN)).cast("int").alias("size"), F.explode(F.array_distinct("f")).alias("hash"))
                        .distinct(), "winnow-marks")
    texts = F.transform("f", lambda h, i: F.array_join(F.slice("list", i + 1, own.cast("int")), " "))
    windows = materialize(items.select("item", F.explode(F.array_distinct(texts)).alias("window")).distinct(), "winnow-windows")
    known = windows.where("item is not null").groupBy("window").agg(*_set_of("item")).select("window", _set_key().alias("items"))
    known = materialize(windows.select("window").distinct().join(known, "window", "left"), "winnow-known")

    # documents' fingerprints, each once a segment, among them
    parts = materialize(fingerprints(segments(rows, "text"), runs).select(
        "row", "doc_id", "n_words", "begin", *[F.array_distinct(f"f{m}").alias(f"f{m}") for m in runs]), "winnow-parts")
    base = parts.where("begin = 0").select("row", "doc_id", "n_words")
    found = [parts.select("row", "begin", F.lit(m).alias("size"), F.explode(f"f{m}").alias("hash")) for m in runs]
    found = reduce(DataFrame.union, found, base.limit(0).select("row", "n_words", F.lit(0), "n_words").toDF("row", "begin", "size", "hash"))
    hits = _meet(found, marks, ["size", "hash"], "left_semi", "row").groupBy("row", "begin").agg(
        F.collect_set(F.struct("size", "hash")).alias("hits"))
    hits = materialize(hits, "winnow-hits")

    # extension: the windows of those fingerprints, each in the segment where it starts
    hit_rows = small(materialize(hits.select("row").distinct(), "winnow-hit-rows"))
    near = segments(rows.join(hit_rows, "row", "left_semi").select("row", "text"), "text").join(small(hits), ["row", "begin"])
    near = fingerprints(near.select("row", "begin", "hits", "list"), runs)
    around = F.concat(F.array().cast(WINDOW_TYPE), *[_windows(m, _among(m)) for m in lengths])
    near = near.select("row", F.explode(around).alias("w")).select("row", "w.*")
    matched = materialize(_meet(near, known, ["window"], "inner", "row").select("row", "first", "size", "items"), "winnow-matched")

    # words covered: every window adds what reaches beyond those that start before it
    last = F.col("first") + F.col("size")
    before = Window.partitionBy("row").orderBy("first", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max(last).over(before), F.lit(0)), F.col("first"))
    covered = matched.select("row", F.greatest(last - reach, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))

    # documents with the same sets of windows' items share one list
    keys = matched.where("items is not null").select("row", "items").distinct()
    lists = keys.groupBy("row").agg(*_set_of("items")).select("row", _set_key().alias("list"))
    lists = materialize(lists, "winnow-lists")
    speaker = lists.groupBy("list").agg(F.min("row").alias("row"))
    one = known.where("items is not null").groupBy("items").agg(F.min("window").alias("window"))
    members = one.join(windows.where("item is not null"), "window").select("items", "item")
    named = (speaker.join(keys, "row").select("list", "items").join(members, "items").select("list", "item").distinct()
             .groupBy("list").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("ids"))
             .select("list", "n_items", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")))
    named = materialize(named, "winnow-named")
    found = covered.join(_meet(lists, named, ["list"], "inner", "row").drop("list"), "row", "left")
    found = small(materialize(found, "winnow-found"))
    out = base.join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def oracle_sql() -> str:
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS t
       FROM (SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spans AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2),
       lambda i: array_to_string(w[i:i + size - 1], ' '))) AS t FROM docs, sizes WHERE len(w) >= size),
matched AS (SELECT s.r, s.i, s.size, x.item_id FROM spans s JOIN windows x ON x.t = s.t AND x.size = s.size),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM matched) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM matched WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
