"""Near-duplicates: chosen-path set similarity join over word shingles, confirmed on full sets.

A document's set holds the hashes of its distinct ``shingle``-word shingles (ASCII
lower case).  Documents with the same set are one node from the start.

1. Every node gets ``TREES`` root tokens (minwise, 64 bits) and ``SKETCH`` one-byte
   minwise values.  In each of the independent trees, nodes are branched by their root
   token; a tree node with more than ``LEAF`` members is branched again by the sketch
   value chosen by its path, down to ``DEPTH``.
2. Members of a small tree node are compared exhaustively on their sketches with a
   wide margin (estimate at least ``LOOSE``); members of a node that does not split any
   more agree on all values of its path and are tied together.  The ties' components
   are candidate clusters.
3. Full sets meet within their cluster and every pair that may join two components is
   checked exactly (100 * intersection >= 80 * union).  Members of a cluster above one tile
   meet one pivot first; those linked to it are one component, so only pairs with an
   open member, in tiles of bounded size, are left.  Each tile returns a spanning forest of
   its links, and the links' components are the result.

Recall: a pair at the threshold shares a root token with probability 0.8 in each tree and keeps a
branching with the share of its sketch values that agree (0.8 in the mean).  ``TREES`` is the
fewest trees, in tens, that miss the pair with at most ``MISS`` at the deepest branching
(``missed``); at one branching the miss is below 1e-17.  Sketches below ``LOOSE`` at a similarity of
0.8 are rarer than 1e-6.  All checked pairs of a cluster count, so chains make up for
single misses.

Scale: nodes travel by number, as rows of 24 bytes a tree (and 150 for the few that
share a token).  Text is read again only for members of clusters, and shuffled only if those
are too many to broadcast.  Copies are never expanded into pairs, counts are map-side
combined, hot tree nodes are branched.  A cluster's work is its members times its open blocks.

Defined results: null or blank text has an empty set, links with nothing and is kept; with
fewer words than a shingle the whole sequence is the one shingle; a null doc_id counts as
larger than any and is kept if its component holds null ids only; rows with equal doc_id and
text share a component; extra columns are ignored; an empty table gives an empty result.  Texts
are met by id and digest, so null and repeated ids cost nothing extra.
With ``row`` (a number of each row's own) the rows of a component are told apart by it, and one of
them is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.frames import narrow, partitions, small
from codeloom.llm.substring_dedup import chunks
from codeloom.llm.wordscan import Words, mix, window_hash
from codeloom.session import materialize

SHINGLE = 5
THRESHOLD = 80  # percent
TREES = 40
SKETCH = 128
LEAF = 48
DEPTH = 6
MISS = 1e-4  # of a pair at the threshold, at the deepest branching
LOOSE = 0.6
TILE_NODES = 256
TILE_SHINGLES = 1 << 20
SALTS = 16
NULL_ID = (1 << 63) - 1


def missed(branchings: int, similarity: float = THRESHOLD / 100, trees: int = TREES) -> float:
    """Probability that no tree keeps a pair through ``branchings`` sketch values after the root."""
    out = 0.0
    for agree in range(SKETCH + 1):
        kept = (agree / SKETCH) ** branchings
        out += (math.comb(SKETCH, agree) * similarity ** agree * (1 - similarity) ** (SKETCH - agree)
                * (1 - similarity * kept) ** trees)
    return out


def multipliers() -> np.ndarray:
    """One odd multiplier per root token and sketch value."""
    return mix(np.arange(1, TREES + SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = Words(column, lower=True)
    h = words.hashes()
    whole = window_hash(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        elif n:
            out.append(mix(window_hash(h[a:b], n) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> bytes | None:
    """128-bit fingerprint of a set; None of the empty one."""
    if not len(s):
        return None
    lanes = np.array([mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)])
    return (mix(lanes) ^ np.uint64(len(s))).tobytes()


def minwise(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (s[None, at:at + 2048] * a[:, None]).min(axis=1), out=out)
    return mix(out)


def _signer(k: int):
    def run(batches):
        a = multipliers()
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part["text"], k)
                signs = [minwise(s, a) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], part["digest"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) for s in sets], pa.binary()),
                    pa.array([None if m is None else m[:TREES].view(np.int64) for m in signs], pa.list_(pa.int64())),
                    pa.array([None if m is None else m[TREES:].astype(np.uint8).tobytes() for m in signs], pa.binary()),
                ], ["doc_id", "digest", "n_shingles", "node", "roots", "sketch"])
    return run


def grouped(batches, key: str):
    """Whole groups of rows sorted by ``key``: several to a batch, none split."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        values = table[key].combine_chunks()
        last = values[len(values) - 1]
        ends = len(values) - 1
        while ends > 0 and values[ends - 1] == last:
            ends -= 1
        if ends:
            yield table.slice(0, ends).combine_chunks()
        rest = table.slice(ends)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, under links (a, b)."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    return root


def _runs(values) -> np.ndarray:
    """Number of the run of equal values that each row is in."""
    v = np.array(values.to_pylist(), dtype=object) if pa.types.is_binary(values.type) else values.to_numpy(zero_copy_only=False)
    change = np.ones(len(v), np.int64)
    change[1:] = v[1:] != v[:-1]
    return np.cumsum(change) - 1


def _compare_leaves(batches):
    need = int(np.ceil(LOOSE * SKETCH))
    for table in grouped(batches, "path"):
        run = _runs(table["path"].combine_chunks())
        nodes = table["node"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        left, right = [], []
        for step in range(1, LEAF):
            i = np.flatnonzero(run[step:] == run[:-step]) if step < len(run) else np.zeros(0, np.int64)
            if not len(i):
                break
            for part in np.array_split(i, len(i) // 65536 + 1):
                close = (sketch[part] == sketch[part + step]).sum(axis=1) >= need
                left.append(part[close])
                right.append(part[close] + step)
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        root = forest(len(nodes), a, b)
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["u", "v"])


def _sized(rows: DataFrame, count: int) -> DataFrame:
    """The ``count`` ``rows`` (path, ...) with ``n``, the size of their path; paths of one member are dropped."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(narrow(sizes, count), "near-sizes")
    return rows.join(small(sizes), "path")


def candidate_ties(nodes: DataFrame) -> DataFrame:
    """(u, v) ties of nodes (node, roots, sketch) whose components are the candidate clusters."""
    count = TREES * nodes.count()
    roots = nodes.select("node", F.posexplode("roots").alias("tree", "token"))
    paths = _sized(roots.select(F.xxhash64("tree", "token").alias("path"), "node"), count)
    rows = materialize(narrow(nodes.select("node", "sketch").join(paths, "node"), count), "near-paths")
    leaves = [rows.where(F.col("n") <= LEAF)]
    stuck = rows.where(F.col("n") > LEAF).select("path", "node", "sketch")
    for level in range(1, DEPTH):
        count = stuck.count()
        if not count:
            break
        at = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(SKETCH)).cast("int")
        branched = stuck.select(F.xxhash64("path", at, F.substring("sketch", at + 1, F.lit(1))).alias("path"), "node", "sketch")
        rows = materialize(narrow(_sized(branched, count), count), "near-paths")
        leaves.append(rows.where(F.col("n") <= LEAF))
        stuck = rows.where(F.col("n") > LEAF).select("path", "node", "sketch")
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    leaf = leaf.select("path", "node", "sketch").repartition(partitions(nodes), "path").sortWithinPartitions("path", "node")
    ties = leaf.mapInArrow(_compare_leaves, "u long, v long")
    centre = stuck.groupBy("path").agg(F.min("node").alias("v"))
    tied = stuck.join(small(materialize(centre, "near-centres")), "path").select(F.col("node").alias("u"), "v")
    return ties.union(tied.where("u <> v"))


def _setter(k: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["cluster"], part["tiles"],
                     pa.array([s.tobytes() for s in shingle_sets(part["text"], k)], pa.binary())],
                    ["node", "cluster", "tiles", "shingles"])
    return run


def _meets_pivot(percent: int):
    """Whether each set is linked to its cluster's pivot (both sorted)."""
    def run(batches):
        for batch in batches:
            out = []
            for own, pivot in zip(batch["shingles"], batch["pivot"], strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (own, pivot))
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                out.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["centre"], pa.array(out, pa.bool_())], ["node", "centre", "near"])
    return run


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, (at, at + 4096))
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[lo:hi], code[lo:hi] - at] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(100 * common >= percent * union, 1))


def _verifier(percent: int):
    def run(batches):
        for table in grouped(batches, "tile"):
            tile = _runs(table["tile"].combine_chunks())
            nodes, raw = table["node"].to_numpy(), table["shingles"].combine_chunks()
            edges = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            u, v = [], []
            for a, b in zip(edges, np.append(edges[1:], len(tile)), strict=True):
                _, first = np.unique(nodes[a:b], return_index=True)
                rows = a + first
                if len(rows) < 2:
                    continue
                x, y = linked([np.frombuffer(raw[int(i)].as_buffer(), dtype=np.uint64) for i in rows], percent)
                root = forest(len(rows), x, y)
                tied = np.flatnonzero(root != np.arange(len(rows)))
                u.append(nodes[rows[tied]])
                v.append(nodes[rows[root[tied]]])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or none)), pa.array(np.concatenate(v or none))], ["u", "v"])
    return run


def pivot_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, centre, near) for the members of clusters above one tile: whether each is linked to its centre.

    The centre is the least node.  Centres are copied to ``SALTS`` keys, so a cluster's
    members are spread.
    """
    centres = sets.groupBy("cluster").agg(F.min("node").alias("node"))
    centres = materialize(sets.join(small(materialize(centres, "near-centres")), ["cluster", "node"]).select(
        "cluster", F.col("node").alias("centre"), F.col("shingles").alias("pivot")), "near-pivots")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    met = salted.hint("merge").join(centres.select("*", salts), ["cluster", "salt"])
    return met.select("node", "shingles", "centre", "pivot").mapInArrow(_meets_pivot(percent), "node long, centre long, near boolean")


def confirmed_links(texts: DataFrame, nodes: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): spanning links of every cluster, checked on full sets."""
    count = clusters.count()
    members = nodes.select("node", "doc_id", "digest", "n_shingles").join(small(clusters), "node")
    members = materialize(narrow(members, count), "near-members")
    sizes = members.groupBy(F.col("root").alias("cluster")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_NODES), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("tiles"))
    sizes = small(materialize(narrow(sizes, count), "near-sizes"))
    wanted = members.withColumnRenamed("root", "cluster").join(sizes, "cluster").select("doc_id", "digest", "node", "cluster", "tiles")
    wanted = materialize(narrow(wanted, count), "near-wanted")
    # rows that repeat id and text are the node's text again
    once = texts.join(small(wanted), ["doc_id", "digest"]).groupBy("node").agg(*[F.first(c).alias(c) for c in ("cluster", "tiles", "text")])
    sets = materialize(once.select("node", "cluster", "tiles", "text").mapInArrow(
        _setter(k), "node long, cluster long, tiles int, shingles binary"), "near-sets")
    many = sets.where("tiles > 1")
    met = materialize(pivot_links(many, percent), "near-met")
    n = partitions(texts)
    # a cluster of one tile; the open members' blocks, each with every other block of its cluster
    tiles = sets.where("tiles = 1").select(F.xxhash64("cluster").alias("tile"), "node", "shingles")
    far = met.where("not near")
    blocks = many.join(far.select("node", "centre"), "node").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_NODES), F.ceil(F.sum(F.length("shingles") / 8) / TILE_SHINGLES)).cast("int").alias("blocks"))
    blocks = small(materialize(blocks, "near-blocks"))
    dealt = many.join(blocks, "cluster").join(met.select("node", "near"), "node")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("tiles")).otherwise(F.col("blocks"))).cast("int")
    dealt = dealt.withColumn("block", block)
    opens = lambda size: F.sequence(F.lit(0), F.col(size) - 1)
    pair = lambda o, kind, b: F.xxhash64("cluster", o, F.lit(kind), b)
    with_open = F.transform(opens("blocks"), lambda o: pair(F.least(o, F.col("block")), "open", F.greatest(o, F.col("block"))))
    with_near = F.transform(opens("tiles"), lambda b: pair(F.col("block"), "near", b))
    keys = F.when(F.col("near"), F.transform(opens("blocks"), lambda o: pair(o, "near", F.col("block")))).otherwise(
        F.concat(with_open, with_near))
    tiles = tiles.union(dealt.select(F.explode(keys).alias("tile"), "node", "shingles"))
    tiles = tiles.repartition(n, "tile").sortWithinPartitions("tile")
    checked = tiles.mapInArrow(_verifier(percent), "u long, v long")
    return checked.union(met.where("near and node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = THRESHOLD, row: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept, node (the set's fingerprint).

    ``row`` names a column of distinct numbers; it is added to the result, and only the component's
    first row by (doc_id, row) is kept.
    """
    own, kind = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "long"
    if row:
        own, kind = F.struct(own.alias("id"), F.col(row).cast("long").alias("row")), "struct<id:long,row:long>"
    texts = df.select(own.alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    signed = materialize(texts.mapInArrow(
        _signer(shingle), f"doc_id {kind}, digest long, n_shingles long, node binary, roots array<long>, sketch binary"), "near-signed")
    count = signed.count()
    nodes = signed.where("node is not null").groupBy(F.col("node").alias("mark")).agg(
        F.min(F.struct("doc_id", "digest")).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    nodes = materialize(narrow(nodes, count).select(
        F.monotonically_increasing_id().alias("node"), "mark", "first.*", "n_shingles", "roots", "sketch"), "near-nodes")
    clusters = materialize(components(candidate_ties(nodes)), "near-clusters")
    links = confirmed_links(texts, nodes, clusters, shingle, percent)
    roots = small(materialize(components(links), "near-roots"))
    found = nodes.select("node", "mark", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = materialize(narrow(found, count), "near-found")
    least = found.where("root <> node").select("root").distinct()
    # one row per component of several sets
    least = found.join(least, "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = materialize(narrow(least, count), "near-least")
    of_node = found.join(small(least), "root", "left").select(
        F.col("mark").alias("node"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    null = lambda c: F.when(c != NULL_ID, c)
    id_of = lambda c: null(c["id"] if row else c)
    number = [F.col("doc_id.row").alias(row)] if row else []
    return out.select(id_of(F.col("doc_id")).alias("doc_id"), "n_shingles", id_of(component).alias("component_id"),
                      (F.col("doc_id") == component).alias("kept"), "node", *number)


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each component, whatever the ids; of blank rows with one id, one stays.

    Rows are written once under a number of their own, and go by that number.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = materialize(near_duplicates(rows, doc_id, text, row="__row", **options)
                        .select("doc_id", "kept", "node", "__row"), "near-kept")
    blank = found.where("node is null and doc_id is not null")
    first = blank.groupBy("doc_id").agg(F.min("__row").alias("first"))
    again = blank.join(first, "doc_id").where("__row <> first").select("__row")
    # the removed rows are fewer than the others
    gone = small(materialize(found.where("not kept").select("__row").union(again), "near-gone"))
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
