"""Incremental state: results memoised per file version.

A *results* table holds one row per ``(path, mode, params)`` with the file's
``mtime_ms`` at the time of analysis plus the outputs.  Lookups are joins:
a hit needs the key and the current ``mtime_ms``; misses are an anti-join.
Upserts are a ``max_by`` per key over (old rows, new rows) — partial
aggregation keeps a hot path to one row per map task.  New results are
always written to a *new* snapshot directory, never over the one being read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.summary import PatternConfig, file_summary
from codeloom.session import materialize, scratch_path
from codeloom.sources.tables import parallelism

PATTERN_CACHE_VERSION = 1
#: counted paths of hits that may be broadcast
BROADCAST_HITS = 100_000
KEY = ["path", "mode", "params"]
RESULT_SCHEMA = ("path string, mode string, params string, mtime_ms bigint, text string, total_lines bigint, "
                 "symbols array<string>, functions array<struct<name:string,lines:bigint>>")
RESULT_COLUMNS = ["path", "mode", "params", "mtime_ms", "text", "total_lines", "symbols", "functions"]


def pattern_params(include: str, exclude: str, version: int = PATTERN_CACHE_VERSION) -> str:
    """P14 (pattern mode): canonical JSON, keys sorted."""
    return json.dumps({"exclude": exclude, "include": include, "version": version},
                      sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pattern_params_of(include, exclude, version: int = PATTERN_CACHE_VERSION):
    """P14 (pattern mode) of columns: the same canonical JSON, one key a row."""
    return F.to_json(F.struct(T.col(exclude).alias("exclude"), T.col(include).alias("include"), F.lit(version).alias("version")))


def llm_params(language: str, backends: list[dict]) -> str:
    """P14 (llm mode): language plus model and temperature of the *first* backend."""
    first = backends[0] if backends else {}
    bp = {}
    if "model" in first:
        bp["model"] = first["model"]
    temp = (first.get("options") or {}).get("temperature")
    if temp is not None:
        bp["temperature"] = temp
    return json.dumps({"backend_params": bp, "language": T.normalize_language(language)},
                      sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def with_mtime_ms(files: DataFrame) -> DataFrame:
    return files.withColumn("mtime_ms", T.epoch_millis("mtime"))


def cache_hits(results: DataFrame, files: DataFrame, mode: str, params: str) -> DataFrame:
    """Stored rows whose key matches and whose mtime_ms equals the file's current one."""
    current = files.select("path", "mtime_ms")
    return (results.filter((F.col("mode") == mode) & (F.col("params") == params))
            .join(current, ["path", "mtime_ms"], "left_semi"))


def cache_misses(files: DataFrame, results: DataFrame, mode: str, params: str) -> DataFrame:
    """Files with no valid stored result (absent or stale)."""
    return files.join(cache_hits(results, files, mode, params).select("path"), "path", "left_anti")


def cache_upsert(results: DataFrame, new: DataFrame, order_col: str | None = None) -> DataFrame:
    """New rows replace the stored row of the same key; other keys of a path stay.

    Among several new rows of one key the one with the largest ``order_col``
    (insertion order) wins; without it, or on a tie, the one with the newest ``mtime_ms``, then
    the largest by its other columns.
    """
    cols = [c for c in results.columns if c != "_v"]
    old = results.select(*cols, F.lit(0).cast("bigint").alias("_v"))
    order = (F.col(order_col).cast("bigint") + 1) if order_col else F.lit(1).cast("bigint")
    fresh = new.select(*cols, order.alias("_v"))
    rest = [c for c in cols if c not in KEY]
    ranked = ["_v", *sorted(rest, key=lambda c: c != "mtime_ms")]
    merged = old.unionByName(fresh).groupBy(*KEY).agg(F.max(F.struct(*ranked)).alias("_r"))
    return merged.select(*KEY, *[F.col("_r." + c).alias(c) for c in rest])


def incremental_summary(files: DataFrame, results: DataFrame, cfg: PatternConfig = PatternConfig(),
                        include: str = "", exclude: str = "") -> tuple[DataFrame, DataFrame]:
    """C4 (pattern mode): hits from the cache, misses recomputed, errors never stored.

    The size guard runs before the cache lookup.  Cached rows keep their
    symbols and functions; ``text`` is derived from the symbols with the
    current truncation flag.  Returns (descriptions, updated results).
    """
    params = pattern_params(include, exclude)
    f = with_mtime_ms(files)
    guard = F.lit(False) if cfg.max_file_size is None else F.col("size") > F.lit(int(cfg.max_file_size))
    small = f.filter(~guard)
    hits = cache_hits(results, small, "pattern", params)
    from_cache = hits.join(small.select("path", "relative"), "path").select(
        "path", "relative", "total_lines", "symbols", "functions",
        T.describe_text("symbols", cfg.no_truncate).alias("text"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    # contents stay where they are beside few hits; beside many they move once, by path, and are not sorted
    paths = materialize(hits.select("path"), "hit-paths")
    few = paths.count() <= BROADCAST_HITS
    todo = (f.join(F.broadcast(paths), "path", "left_anti") if few else
            f.repartition(parallelism(f.sparkSession), "path").join(paths.hint("shuffle_hash"), "path", "left_anti"))
    # read twice (descriptions and new results): materialise once
    fresh = materialize(file_summary(todo, cfg, balance=few), "fresh-descriptions")
    desc = from_cache.unionByName(fresh)
    stored = fresh.filter(F.col("error").isNull()).join(f.select("path", "mtime_ms"), "path").select(
        "path", F.lit("pattern").alias("mode"), F.lit(params).alias("params"), "mtime_ms", "text",
        "total_lines", "symbols", "functions")
    return desc, cache_upsert(results, stored)


def write_results(results: DataFrame, spark: SparkSession, name: str = "results") -> str:
    """Persist a results snapshot under the shared checkpoint folder; returns its path."""
    path = scratch_path(spark, name)
    results.write.mode("errorifexists").parquet(path)
    return path


def incremental_describe(files: DataFrame, results: DataFrame, backends: list, language: str = "ru",
                         max_file_size: int | None = None,
                         max_concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C4 (llm mode): the cache is consulted *before* the size guard; only
    successful descriptions are stored.  Fresh answers are checkpointed so the
    backends are called exactly once per miss.  Returns (descriptions, results)."""
    from codeloom.operators.describe import describe_llm
    params = llm_params(language, [{"model": b.model, "options": b.options} for b in backends])
    f = with_mtime_ms(files)
    hits = cache_hits(results, f, "llm", params)
    from_cache = hits.join(f.select("path", "relative"), "path").select(
        "path", "relative", "text", F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("backend"), F.lit(True).alias("from_cache"))
    todo = f.join(hits.select("path"), "path", "left_anti")
    fresh = materialize(describe_llm(todo, backends, language, max_file_size, max_concurrency),
                        "fresh-llm-descriptions")
    desc = from_cache.unionByName(fresh.withColumn("from_cache", F.lit(False)))
    stored = fresh.filter(F.col("error").isNull()).join(f.select("path", "mtime_ms"), "path").select(
        "path", F.lit("llm").alias("mode"), F.lit(params).alias("params"), "mtime_ms", "text",
        F.lit(None).cast("bigint").alias("total_lines"), F.array().cast("array<string>").alias("symbols"),
        F.array().cast("array<struct<name:string,lines:bigint>>").alias("functions"))
    return desc, cache_upsert(results, stored)
