"""Exact top-k inner products: block-at-a-time pruning with term maxima.

Vectors become whole numbers, floor(64 * x).  Candidates are ordered by (nearest
centre, vec_id) and cut into blocks of a document range; a block stores its vectors
(the forward index) and, per dimension, its largest and least value.  For a query, the
sum over dimensions of the larger of q * largest and q * least bounds every score of
the block.  Blocks are taken in falling order of that bound and scored whole, until
the next bound falls below the query's kth score.

Queries are a stated set (ids divisible by ``EVERY``).  Batches of queries meet groups of
blocks: each (batch, group) is one key, held by one task at a time, at most
``QUERY_BATCH`` queries and ``GROUP`` vectors.  The k best of every group are merged per
query.  Pruning only skips blocks that cannot reach the k best, so results are exact.

The centres only order the candidates (tight blocks); they are fitted on the
``SAMPLE`` vectors with the least id hashes, and every vector is indexed.

Defined results: rows with a null id, a null vector, or a null or non-finite component take
no part; shorter vectors count as padded with zeros; a query's own id is no candidate,
whatever rows carry it; of several rows with a query's id the least vector asks; equal scores
go to the smaller vec_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.frames import partitions
from codeloom.llm.near_dup import grouped
from codeloom.session import materialize

K = 20
EVERY = 20
SCALE = 64
BLOCK = 256
GROUP = 8192
QUERY_BATCH = 1024
SAMPLE = 2000
CENTRES = 64
INT_SAFE = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    sizes = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), flat.dtype)
    inside = np.arange(out.shape[1]) < sizes[:, None]
    out[inside] = flat
    return out


def centres_of(sample: np.ndarray) -> np.ndarray:
    """A few rounds of k-means from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, 0))
    c = sample[np.linspace(0, len(sample) - 1, min(CENTRES, len(sample))).astype(int)].astype(float)
    for _ in range(8):
        near = ((sample ** 2).sum(1)[:, None] - 2 * sample @ c.T + (c ** 2).sum(1)).argmin(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = sample[near == k].mean(axis=0)
    return c


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width), x.dtype)
    out[:, :min(width, x.shape[1])] = x[:, :width]
    return out


def _placer(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            x = _matrix(batch["vector"]).astype(np.float64)
            y = _fit(x, centres.shape[1])
            near = ((centres ** 2).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(near.astype(np.int32)), batch["vector"]],
                                             ["vec_id", "centre", "vector"])
    return run


def _blocker(size: int):
    """Blocks of consecutive rows: ids and vectors as 64-bit numbers."""
    def run(batches):
        task = None
        made, held, ids = 0, [], []

        def out():
            width = max(len(v) for v in held)
            m = np.zeros((len(held), width), np.int64)
            for i, v in enumerate(held):
                m[i, :len(v)] = v
            return pa.RecordBatch.from_arrays([
                pa.array([task + made], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([width], pa.int32()),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                ["block", "n", "width", "ids", "vectors"])
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["vector"], strict=True):
                ids.append(i)
                held.append(np.asarray(v.values))
                if len(held) == size:
                    yield out()
                    made, held, ids = made + 1, [], []
        if held:
            yield out()
    return run


def _load(row) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(row["ids"], np.int64),
            np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["width"]))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T (through floating point where that is exact)."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < INT_SAFE and a.shape[1] < 4096:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
    """(query row, vec_id, score) of each query's k best over ``blocks``, and how many blocks were scored."""
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    queries = _fit(queries, width)
    blocks = [(i, _fit(m, width)) for i, m in blocks]
    most = np.stack([m.max(axis=0) for _, m in blocks])
    least = np.stack([m.min(axis=0) for _, m in blocks])
    bound = _product(np.maximum(queries, 0), most) + _product(np.minimum(queries, 0), least)
    exact = max(np.abs(most).max(), np.abs(least).max(), np.abs(queries).max()) < INT_SAFE
    forward = [(i, m.astype(np.float64) if exact else m) for i, m in blocks]
    asked = queries.astype(np.float64) if exact else queries
    out, scored = [], 0
    for q in range(len(queries)):
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bound[q], kind="stable"):
            if len(best_s) == k and bound[q, b] < best_s[-1]:
                break
            scored += 1
            own, m = forward[b]
            s = (m @ asked[q]).astype(np.int64)
            fine = own != ids[q]
            if len(best_s) == k:
                fine &= s >= best_s[-1]
            if fine.any():
                s, i = np.concatenate((best_s, s[fine])), np.concatenate((best_i, own[fine]))
                top = np.lexsort((i, -s))[:k]
                best_s, best_i = s[top], i[top]
        out.append((np.full(len(best_s), ids[q]), best_i, best_s))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)), scored


def _searcher(k: int):
    def run(batches):
        for table in grouped(batches, "key"):
            rows = table.to_pylist()
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to]["key"] == rows[at]["key"]:
                    to += 1
                asked = [_load(r) for r in rows[at:to] if r["query"]]
                blocks = [_load(r) for r in rows[at:to] if not r["query"]]
                at = to
                if not asked or not blocks:
                    continue
                width = max(m.shape[1] for _, m in asked)
                (q, i, s), _ = search(np.concatenate([a for a, _ in asked]),
                                      np.concatenate([_fit(m, width) for _, m in asked]), blocks, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])
    return run


def top_k(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``every``."""
    x = F.col(vector)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    clean = F.col(vec_id).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.where(clean).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vector"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    width = max([len(r["vector"]) for r in sample], default=0)
    centres = centres_of(np.array([[*r["vector"], *[0] * (width - len(r["vector"]))] for r in sample], dtype=float).reshape(len(sample), width))
    placed = materialize(rows.mapInArrow(_placer(centres), "vec_id long, centre int, vector array<long>"), "topk-placed")
    schema = "block long, n int, width int, ids binary, vectors binary"
    n = partitions(df)

    def blocks(of: DataFrame, size: int, name: str) -> DataFrame:
        ranged = of.repartitionByRange(n, "centre", "vec_id").sortWithinPartitions("centre", "vec_id", "vector")
        return materialize(ranged.select("vec_id", "vector").mapInArrow(_blocker(size), schema), name)

    candidates = blocks(placed, BLOCK, "topk-blocks")
    least = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "centre")).alias("v"))
    queries = blocks(least.select("vec_id", "v.vector", "v.centre"), BLOCK, "topk-queries")
    groups = max(1, -(-candidates.count() * BLOCK // GROUP))
    asks = max(1, -(-queries.count() * BLOCK // QUERY_BATCH))
    # consecutive blocks are dealt round, so every group has near ones for every query
    group = F.pmod(F.xxhash64("block"), F.lit(groups))
    ask = F.pmod(F.xxhash64("block"), F.lit(asks))
    left = candidates.withColumn("group", group).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = queries.withColumn("ask", ask).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = (F.col("ask").cast("long") * groups + F.col("group")).alias("key")
    meet = left.select(key, F.lit(False).alias("query"), "n", "width", "ids", "vectors").union(
        right.select(key, F.lit(True).alias("query"), "n", "width", "ids", "vectors"))
    meet = meet.repartition(max(n, min(asks * groups, 100_000)), "key").sortWithinPartitions("key", "query")
    found = meet.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH clean AS (SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
     FROM clean q JOIN clean c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
