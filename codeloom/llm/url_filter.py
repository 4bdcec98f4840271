"""URL filter: host/path rules, and a character language-model ratio for the rest.

A rule ``host/path`` fits its host and all subdomains if the URL's path starts with
``/path``; the longest rule wins.  URLs that rules accept and reject train two
character models: Markov chains of variable order (0 to ``CONTEXT`` characters of
context, each order smoothed by the one below).  A URL's score is the mean
log-likelihood difference per character.  The threshold is calibrated on
rule-judged pages that are kept out of training: the value with the best mean of
the two classes' shares judged right.

Scale: the model is a table of counted grams (1 to ``CONTEXT`` + 1 characters as they are), which
grows with the URLs.  A character's log-likelihood is a sum over its grams and contexts, so a
URL is scored by joining its grams with the table and summing: grams above a share of all
counts are at most ``BROADCAST_ROWS`` and broadcast, the others meet their weights in a shuffle.
Weights are whole micro-nats, so sums do not depend on order.

Defined results: a null URL, or one without ``://``, has an empty host and path and
fits no rule; a URL without characters scores 0; a table without both accepted and
rejected URLs scores everything 0 with threshold 0 (allow); repeated pages are
judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.llm.frames import BROADCAST_ROWS
from codeloom.session import materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
START = "\x02"  # before the first character
CONTEXT = 5
BASE = 256  # the lowest order smooths towards 1 / BASE
SMOOTHING = 4.0
CALIBRATION_FOLDS = 5
BIN = 10_000  # micro-nats per calibration bin
BINS = 1_000  # bins on either side of 0; scores beyond share the outermost


def _fold_case(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = _fold_case(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(df: DataFrame, url: str, *columns: str) -> DataFrame:
    """``columns`` with every (gram, last) of each URL; ``last``: no character follows."""
    chars = F.filter(F.split(F.coalesce(F.col(url), F.lit("")), ""), lambda c: c != "")
    df = df.select(*columns, chars.alias("__chars")).where(F.size("__chars") > 0)
    n, padded = F.size("__chars"), F.concat(F.array(*[F.lit(START)] * CONTEXT), F.col("__chars"))
    df = df.select(*columns, n.alias("__n"), padded.alias("__padded"))
    at = F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__at")
    df = df.select(*columns, "__n", "__padded", at)
    # the longest gram of a place; the others are its ends
    longest = F.array_join(F.slice("__padded", F.col("__at"), CONTEXT + 1), "")
    df = df.select(*columns, longest.alias("__long"), (F.col("__at") == F.col("__n")).alias("last"))
    return df.select(*columns, "last", F.explode(F.array(*[F.substring("__long", CONTEXT + 1 - k, k + 1)
                                                            for k in range(CONTEXT + 1)])).alias("gram"))


def train(pages: DataFrame, url: str = "url", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(grams, base) of rows (url, label allow/block).

    grams: gram, n, ``inner`` and ``final`` (weights with and without a following character).
    base: one row (each, once): what every character and every URL adds.
    """
    one = lambda c, what: F.count_if(F.col(label).eqNullSafe(what) & c)
    every, follows = F.lit(True), ~F.col("last")
    counts = materialize(_grams(pages, url, label).groupBy("gram").agg(
        one(every, "allow").alias("a"), one(every, "block").alias("b"),
        one(follows, "allow").alias("ctx_a"), one(follows, "block").alias("ctx_b")), "url-counts")
    length = F.char_length("gram")
    chars = counts.where(length == 1).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("chars_a"),
                                          F.coalesce(F.sum("b"), F.lit(0)).alias("chars_b"))
    begun = pages.where(F.char_length(url) > 0).agg(F.count_if(F.col(label) == "allow").alias("urls_a"),
                                                    F.count_if(F.col(label) == "block").alias("urls_b"))
    totals = materialize(chars.crossJoin(begun), "url-totals")
    total = {c: totals.select(c).scalar() for c in totals.columns}
    known = (total["chars_a"] > 0) & (total["chars_b"] > 0)
    whole = lambda c: F.when(known, F.round(1e6 * c)).otherwise(0).cast("long")
    context = lambda a, b: F.log((b + SMOOTHING) / SMOOTHING) - F.log((a + SMOOTHING) / SMOOTHING)
    # the lowest order, then each by the one below: P(gram) = (n + SMOOTHING * P(end)) / (n(context) + SMOOTHING)
    levels, below = [], None
    for k in range(CONTEXT + 1):
        rows = counts.where(length == k + 1)
        if k:
            heads = counts.where(length == k).select(F.col("gram").alias("head"), F.col("ctx_a").alias("of_a"),
                                                     F.col("ctx_b").alias("of_b"))
            ends = below.select(F.col("gram").alias("end"), F.col("p_a").alias("low_a"), F.col("p_b").alias("low_b"))
            rows = (rows.withColumns({"end": F.substring("gram", 2, k), "head": F.substring("gram", 1, k)})
                    .join(ends, "end").join(heads, "head", "left"))
            first = F.col("head") == START * k
            rows = rows.withColumns({f"of_{x}": F.when(first, total[f"urls_{x}"]).otherwise(
                F.coalesce(f"of_{x}", F.lit(0))) for x in "ab"})
        else:
            rows = rows.withColumns({f"low_{x}": F.lit(1.0 / BASE) for x in "ab"} | {
                f"of_{x}": total[f"chars_{x}"] for x in "ab"})
        rows = rows.withColumns({f"p_{x}": (F.col(x) + SMOOTHING * F.col(f"low_{x}")) / (F.col(f"of_{x}") + SMOOTHING)
                                 for x in "ab"})
        # log P less the order below and less the context's share, which unseen grams have too
        seen = F.log1p(F.col("a") / (SMOOTHING * F.col("low_a"))) - F.log1p(F.col("b") / (SMOOTHING * F.col("low_b")))
        after = whole(context(F.col("ctx_a"), F.col("ctx_b"))) if k < CONTEXT else F.lit(0).cast("long")
        below = materialize(rows.select("gram", (F.col("a") + F.col("b")).alias("n"), "p_a", "p_b",
                                        whole(seen).alias("final"), (whole(seen) + after).alias("inner")), "url-order")
        levels.append(below.select("gram", "n", "inner", "final"))
    grams = levels[0]
    for x in levels[1:]:
        grams = grams.unionByName(x)
    base = materialize(totals.select(
        whole(context(F.col("chars_a"), F.col("chars_b"))).alias("each"),
        (CONTEXT * whole(context(F.col("urls_a"), F.col("urls_b")))).alias("once")), "url-base")
    return materialize(grams, "url-model"), base


def score(df: DataFrame, model: tuple[DataFrame, DataFrame], row: str = "__row", url: str = "url") -> DataFrame:
    """``df`` plus ``score``: whole micro-nats per character, positive: like accepted URLs; ``row`` numbers the rows."""
    grams, base = model
    hot = F.col("n") * BROADCAST_ROWS >= grams.agg(F.sum("n")).scalar()
    weight = F.when(F.col("last"), F.col("final")).otherwise(F.col("inner"))
    # hot grams are at most BROADCAST_ROWS by their share
    met = _grams(df, url, row).join(F.broadcast(grams.where(hot).drop("n")), "gram", "left")
    parts = met.where("final is not null").groupBy(row).agg(F.sum(weight).alias("w"))
    cold = grams.where(~hot).drop("n")
    if not cold.isEmpty():
        rest = met.where("final is null").select(row, "gram", "last").join(cold, "gram")
        parts = parts.union(rest.groupBy(row).agg(F.sum(weight).alias("w")))
    sums = parts.groupBy(row).agg(F.sum("w").alias("__sum"))
    n = F.char_length(F.coalesce(F.col(url), F.lit("")))
    whole = F.coalesce("__sum", F.lit(0)) + n * base.select("each").scalar() + base.select("once").scalar()
    return df.join(sums, row, "left").withColumn(
        "score", F.when(n > 0, F.floor(whole / n)).otherwise(0).cast("long")).drop("__sum")


def calibrate(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row (threshold): the bin edge that judges both classes best (the lowest of equals)."""
    bins = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin")
    table = scored.groupBy(bins).agg(F.count_if(F.col(label) == "allow").alias("a"),
                                     F.count_if(F.col(label) == "block").alias("b"))
    # at most 2 * BINS + 1 rows from here on
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    right = (1 - F.coalesce(F.sum("a").over(before), F.lit(0)) / F.greatest(F.sum("a").over(every), F.lit(1))
             + F.coalesce(F.sum("b").over(before), F.lit(0)) / F.greatest(F.sum("b").over(every), F.lit(1)))
    both = (F.sum("a").over(every) > 0) & (F.sum("b").over(every) > 0)
    best = table.select("bin", F.when(both, right).alias("right")).where(F.col("right").isNotNull())
    top = best.agg(F.max(F.struct(F.col("right"), (-F.col("bin")).alias("low"))).alias("t"))
    return materialize(top.select(F.coalesce(-F.col("t.low") * BIN, F.lit(0)).cast("long").alias("threshold")), "url-threshold")


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score, calibration."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, what in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(what)).otherwise(by_rule)
    held = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % CALIBRATION_FOLDS == 0
    judged = base.withColumns({"label": by_rule, "calibration": held})
    ready = materialize(judged.withColumn("__row", F.monotonically_increasing_id()), "url-pages")
    model = train(ready.where(F.col("label").isNotNull() & ~F.col("calibration")))
    out = materialize(score(ready, model), "url-scores")
    threshold = calibrate(out.where(F.col("label").isNotNull() & F.col("calibration"))).select("threshold").scalar()
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "calibration")
