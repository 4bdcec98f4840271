"""Rule-based quality filter: one threshold table compiled into one Spark projection.

Metrics of a text (null: empty) over its words ``[^\\x20\\x09-\\x0D]+`` and its
``\\n``-split lines; every document gets a verdict from its own row, so the whole
operator is a single map stage without user functions, joins or shuffles.

Defined results: a text without words has all counts 0 and fails the base rules;
repeated rows are judged alike; extra columns are kept by :func:`filter_quality`
and ignored by :func:`quality_metrics`; an empty table gives an empty result.
Three-word windows are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.frames import WORD, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STOP_WORDS = (
    "the of and to in a is that it for on with as be at this by from or an are was",  # en
    "le la les de des un une et en que qui dans pour est au du il elle",  # fr
    "der die das und ist in den von zu mit sich auf ein eine dem für",  # de
    "el los las y que en un una por con es del al se no lo",  # es
)
#: (metric, least, most): a document is kept if every ratio lies within its bounds
THRESHOLDS = (
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", 0.0, 0.2),
    ("stop_word_ratio", 0.01, 1.0),
    ("dup_line_ratio", 0.0, 0.5),
    ("shout_ratio", 0.0, 0.2),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NS = "__quality"


def stop_words() -> list[str]:
    return sorted({w for line in STOP_WORDS for w in line.split()})


def _with_arrays(df: DataFrame, text: str) -> DataFrame:
    t = text_or_empty(text)
    return df.withColumns({
        f"{NS}_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        f"{NS}_lines": F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
    })


def _with_counts(df: DataFrame, text: str) -> DataFrame:
    """The base counts; each step is its own projection so nothing is computed twice."""
    t = text_or_empty(text)
    words, lines = F.col(f"{NS}_words"), F.col(f"{NS}_lines")
    n = F.size(words)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3),
                                       lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{NS}_n_lines": F.size(lines),
        f"{NS}_stops": F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words()))),
        f"{NS}_shouts": F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!!")))),
        f"{NS}_grams": grams,
    })
    grams = F.col(f"{NS}_grams")
    some = F.size(F.array_distinct(grams)) < F.size(grams)
    df = df.withColumn(f"{NS}_sorted", F.when(some, F.array_sort(F.transform(
        grams, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(f"{NS}_sorted")
    at = lambda j: F.get(s, j)["h"]
    df = df.withColumn(f"{NS}_places", F.array_sort(F.transform(
        F.filter(s, lambda x, j: x["h"].eqNullSafe(at(j - 1)) | x["h"].eqNullSafe(at(j + 1))), lambda x: x["i"])))
    p = F.col(f"{NS}_places")
    # a window covers three words, or fewer where the next one begins earlier
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
                          F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col(f"{NS}_stops") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col(f"{NS}_n_lines"), F.lit(1)),
        "shout_ratio": F.col(f"{NS}_shouts") / n,
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    ratios = _ratios()
    ok = F.lit(True)
    for metric, least, most in thresholds:
        ok = ok & ratios[metric].between(least, most)
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_metrics(df: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per row of ``df``: doc_id, the base counts, base_failed, the ratios and kept."""
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = _with_counts(_with_arrays(base, "text"), "text")
    return counted.select("doc_id", *METRICS, base_failed().alias("base_failed"),
                          (~base_failed() & verdict(thresholds)).alias("kept"),
                          *[r.alias(m) for m, r in _ratios().items()])


def filter_quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that the rules keep, with their own columns only.

    The verdict is computed as a column and its row emitted by a generator: as a predicate the
    optimizer would push it below the counts and evaluate their expressions many times.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    base = df.select(whole, F.col(text).alias("text"))
    counted = _with_counts(_with_arrays(base, "text"), "text")
    judged = counted.select("__row", (~base_failed() & verdict(thresholds)).alias("__kept"))
    return judged.select(F.explode(F.when(F.col("__kept"), F.array("__row"))).alias("__row")).select("__row.*")


def oracle_sql(thresholds=THRESHOLDS) -> str:
    """DuckDB SQL for the query's rows, from exploded words and lines instead of array functions."""
    sql_ratio = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stops / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
    }
    rules = " AND ".join(f"({sql_ratio[m]}) BETWEEN {lo} AND {hi}" for m, lo, hi in thresholds)
    stops = ", ".join(f"'{w}'" for w in stop_words())
    spaces = "[ \\t\\n\\x0B\\x0C\\r]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos
          FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
grams AS (SELECT rid, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words
          WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM grams WHERE c IS NOT NULL
          QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
counted AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
            count(*) FILTER (lower(word) IN ({stops})) AS n_stops, count(*) FILTER (word LIKE '%!!') AS n_shouts
            FROM words GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
          WHERE regexp_replace(line, '{spaces}', '', 'g') <> '' GROUP BY rid),
base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_stops, 0) AS n_stops, coalesce(n_shouts, 0) AS n_shouts, coalesce(n_lines, 0) AS n_lines
         FROM docs LEFT JOIN counted USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept FROM judged"""
