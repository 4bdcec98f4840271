"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (decontamination, mixing, near_dup, packing, phrases, pii, quality_mil, quality_rules, substring_dedup, topk,
                          toxicity, url_filter, whitening)
from codeloom.session import prepare
from codeloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERIES["pipeline"] = lambda spark, sf_dir: corpus_pipeline.run(prepare(spark), sf_dir)


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_mixing", mixing.oracle_sql())
def op1_mixing(spark, sf_dir):
    """Words taken from every document by the mix of all sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    documents, _ = mixing.plan_mix(docs, carry=["doc_id"])
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    """Every document's pieces, packed into sequences of 1024 tokens."""
    return packing.with_digest(packing.pack(read_table(spark, sf_dir, "documents")))


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    """Words left in every document without windows of 20 words that start earlier elsewhere."""
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_quality_rules", quality_rules.oracle_sql())
def op5_quality_rules(spark, sf_dir):
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.quality_metrics(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.METRICS, "base_failed", "kept")


@query("op6_quality_mil")
def op6_quality_mil(spark, sf_dir):
    """Quality score of every document."""
    return quality_mil.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_topk", topk.oracle_sql())
def op7_topk(spark, sf_dir):
    """The 20 highest integer inner products of every query vector."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


@query("op8_pii")
def op8_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.with_digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


@query("op9_url_filter")
def op9_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op10_near_dup")
def op10_near_dup(spark, sf_dir):
    """Near-duplicate component of every document, on four-word shingles."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    """Whitened components of every vector, with exact deviations."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).drop("deviation_digits")


@query("op12_phrases", phrases.oracle_sql())
def op12_phrases(spark, sf_dir):
    """The first 2000 collocations of every language."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


@query("op13_decontamination", decontamination.oracle_sql())
def op13_decontamination(spark, sf_dir):
    """Words of every document inside windows of benchmark items."""
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
