"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target: its weight's share of the budget (all words), held at
``max_repeat`` times its own size, the excess reshared by weight until none is
above.  Documents are shuffled by a seeded hash; a source is read up to
``max_repeat`` times in that order.  The virtual finish time of a copy is the
source's words up to and including it, divided by the source's target.  All
copies are range-sorted by finish time and taken while their running total
stays within the budget.

Scale: sizes are counted once; the running sum inside a source is a global
running sum over (source, shuffle key) less the words of the sources before it,
so a hot source is spread over many ranges.  A source is served until its target is
reached: copies that would begin after it are not sorted (all earlier ones spend the
budget), so every source ends within one document of its target.

Defined results: null or blank text has size 0 and is taken 0 times; a null
source is one source, ordered last; a null doc_id hashes as ''; repeated rows
are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.frames import running, small, word_count
from codeloom.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def shuffle_key(doc_id: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, source_before, target.

    ``source_before`` is the size of all sources before it.  Water-filling: over sources
    by cap/weight, the level that the sources from here on would share; the largest such
    level is the final one, and a source's target is its weight times the level or its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = running(totals, order, {"rank": F.lit(1).cast("long"), "upto": F.col("source_size")}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = (ranked.withColumn("weight", weight).withColumn("cap", F.lit(int(max_repeat)) * F.col("source_size"))
              .withColumn("edge", F.col("cap") / F.col("weight")))
    filled = materialize(running(capped, [F.col("edge"), F.col("rank")],
                                 {"caps": F.col("cap"), "weights": F.col("weight")}, "mix-levels"), "mix-filled")
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all")).alias("w")
    total, every = whole.select("total").scalar(), whole.select("all").scalar()
    level = filled.agg(F.max((total - F.col("caps") + F.col("cap"))
                             / (every - F.col("weights") + F.col("weight"))).alias("level")).scalar()
    return filled.select("source", "rank", "source_size", (F.col("upto") - F.col("source_size")).alias("source_before"),
                         F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def plan_mix(df: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 0, doc_id: str = "doc_id",
             text: str = "text", source: str = "source",
             carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, order) of the mix.

    ``documents``: one row per row of ``df`` with ``row`` (the struct of its columns, or of those in
    ``carry``), doc_id,
    size, source_size, target, ``copies`` (how often it is taken) and taken.  ``order``: the
    sorted copies with finish, rank, pos, size and the running total.
    """
    # sizes are counted once, before anything is sampled or sorted
    sized = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"),
                                  F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                  word_count(text).alias("size"), shuffle_key(doc_id, seed).alias("key")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, max_repeat), "mix-targets")
    ordered = running(sized, [F.col("source").asc_nulls_last(), F.col("key"), F.col("size")],
                      {"upto": F.col("size"), "pos": F.lit(1).cast("long")}, "mix-order")
    per_source = small(targets.withColumnRenamed("source", "__source"))
    placed = ordered.join(per_source, ordered["source"].eqNullSafe(F.col("__source"))).select(
        "row", "doc_id", "source_size", "target", "rank", "pos", "size",
        (F.col("upto") - F.col("size") - F.col("source_before")).alias("begins"))
    placed = materialize(placed, "mix-placed")
    copies = (placed.where((F.col("size") > 0) & (F.col("target") > 0))
              .select("rank", "pos", "size", "source_size", "target", "begins",
                      F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("copy"))
              .where(F.col("copy") * F.col("source_size") + F.col("begins") < F.col("target"))
              .select(_finish("copy").alias("finish"), "rank", "pos", "copy", "size"))
    budget = placed.agg(F.sum("size")).scalar()
    order = materialize(running(copies, [F.col("finish"), F.col("rank"), F.col("pos")],
                                {"total": F.col("size")}, "mix-finish"), "mix-sorted")
    last = (order.where(F.col("total") <= budget)
            .agg(F.max(F.struct("finish", "rank", "pos")).alias("last")).scalar())
    taken = F.lit(0)
    for k in range(max_repeat):
        due = k * F.col("source_size") + F.col("begins") < F.col("target")
        within = F.struct(_finish(F.lit(k)).alias("finish"), F.col("rank"), F.col("pos")) <= last
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & due & within, 1).otherwise(0)
    documents = placed.select("row", "doc_id", "size", "source_size", "target", "rank", "pos", "begins",
                              taken.cast("long").alias("copies"))
    return documents.withColumn("taken", F.col("size") * F.col("copies")), order


def _finish(copy) -> Column:
    copy = F.col(copy) if isinstance(copy, str) else copy
    return (copy * F.col("source_size") + F.col("begins") + F.col("size")) / F.col("target")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: the rows of ``df``, each as often as it is taken.

    Whole rows are written once under a number of their own and shuffled once, to meet the
    copies of that number; everything else of the plan is done on narrow rows.
    """
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                                 F.monotonically_increasing_id().alias("place")), "mix-rows")
    part = lambda c: F.col("row").getField(c)
    documents, _ = plan_mix(rows.select("place", part(doc_id).alias("doc_id"), part(text).alias("text"),
                                        part(source).alias("source")), carry=["place"], **options)
    taken = documents.where("copies > 0").select(F.col("row.place").alias("place"), "copies")
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return rows.join(taken.hint("merge"), "place").select("row", again).select("row.*")


def oracle_sql(weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 0) -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH docs AS (SELECT doc_id, source, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key,
              len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
            row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM docs GROUP BY source),
caps AS (SELECT *, {max_repeat} * source_size AS cap, CASE (rank - 1) % {len(weights)} {weight} END AS weight FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE
           / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS lvl FROM caps
           WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT source, rank, source_size, least(cap::DOUBLE, weight * (SELECT max(lvl) FROM levels)) AS target FROM levels),
placed AS (SELECT d.*, rank, source_size, target,
           row_number() OVER (ORDER BY d.source NULLS LAST, key, size) AS pos,
           sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS begins
           FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT pos, rank, copy, size, (copy * source_size + begins + size)::DOUBLE / target AS finish
           FROM placed, range({max_repeat}) r(copy)
           WHERE size > 0 AND target > 0 AND copy * source_size + begins < target),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pos ROWS UNBOUNDED PRECEDING) AS total FROM copies),
counted AS (SELECT pos, count(*) AS n FROM ordered WHERE total <= (SELECT sum(size) FROM docs) GROUP BY pos)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM placed LEFT JOIN counted USING (pos)"""
