"""From raw documents to packed training sequences: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; a stage judges every row that its predecessor kept.

1. quality rules: documents that the rules reject go;
2. near-duplicates (shingles of five words, similarity 0.8): one document of each group stays;
3. personal data: found spans are replaced by their kind;
4. mixing: documents are taken as often as their source's target asks for (0 to 3 times);
5. packing: pieces of the tokenised documents in sequences of 1024 tokens.

SQL can express neither the learned spans of stage 3 nor the tokenizer of stage 5, so
``ORACLE_SQL`` is None.  The tests run ``run`` and hold every written stage against a plain version:
DuckDB's verdicts and copies for quality and mixing, brute force for near-duplicates, plain patterns for
personal data, the tokenizer for packing.
Nulls, empty texts, repeated rows and empty tables: see the stages' operators.  ``n_chars``
is kept up to date where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import mixing, near_dup, packing, pii, quality_rules
from codeloom.session import materialize, prepare

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.with_digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
