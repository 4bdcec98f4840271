"""Embedding whitening by bit-sliced scatter: exact cross-products from AND-popcounts of packed bit planes.

A component c becomes the integer x = floor(1024 * c) + 100000.  Per dimension the least x is
subtracted, and the planes (bits) of what is left are packed across 64 rows into a word.  The
sum of y_i * y_j over rows is the sum over plane pairs (b, b') of 2^(b + b') times the popcount
of the ANDed words, so it is exact whatever the number of rows.  Centring is done on the integers
(n * C - S * S'), and only the centred matrix becomes double, for ``eigh``.

1. Per-task minima, maxima and counts of each dimension give the shifts and numbers of planes.
2. Every task adds up its plane pairs in 16-bit digits and sends one row per pair of dimensions;
   Spark adds these as 32-bit limbs.  One task centres the sums (as many as pairs of dimensions,
   whatever the rows) and fits the components.
3. The covariance of the whitened rows is measured in a pass of its own, and a last pass emits.

Scale: four scans of the vectors; the shuffle holds D * (D + 1) / 2 rows a task.  The driver gets
only tables bounded by the dimension: shifts, model and the 8 x 8 covariance.

Defined results: a null vector, or one with null or non-finite entries, is dropped.  Vectors of
another width than the commonest (the wider one of a tie) take no part.  Components beyond 2^62
in 1024ths are held there.  A null vec_id stays null; repeated rows are rows of their own.  A
component whose eigenvalue is 0 up to rounding (at most 1e-12 of the trace) has whitened null and
takes no part in identity_error.  ``deviation`` is null where it passes 64 bits, and
``deviation_digits`` has it then.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.labelled import packed, unpacked

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
BOUND = float(1 << 62)
#: rows whose planes are packed at once
BLOCK = 1 << 14
#: blocks whose digits add up within 63 bits
FLUSH = 256
LIMB = (1 << 32) - 1
NOTHING = 1e-12


def integers(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of floor(1024 * c) + 100000."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -BOUND, BOUND).astype(np.int64) + OFFSET


def _slices(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(part["vector"], width)


def _extremes(batches):
    seen: dict[int, list] = {}
    for batch in batches:
        widths = np.asarray(pc.list_value_length(batch["vector"]))
        for w in np.unique(widths).tolist():
            x = integers(batch.filter(pa.array(widths == w))["vector"], w) if w else np.zeros((int((widths == 0).sum()), 0), np.int64)
            n, low, high = seen.get(w, (0, x.min(axis=0), x.max(axis=0)))
            seen[w] = [n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.int32()), pa.array([s[0] for s in seen.values()], pa.int64()),
         pa.array([s[1] for s in seen.values()], pa.list_(pa.int64())),
         pa.array([s[2] for s in seen.values()], pa.list_(pa.int64()))], ["width", "n", "low", "high"])


class Planes:
    """Bit planes of a fixed number per dimension, and the digits of their weighted AND-popcounts."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.dim = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.arange(len(self.dim)) - np.repeat(np.cumsum(bits) - bits, bits)
        groups = -(-int(bits.max(initial=0)) // 16)
        self.digits = np.zeros((max(1, 2 * groups - 1), len(bits), len(bits)), np.int64)
        self.sums = np.zeros((max(1, groups), len(bits)), np.int64)
        self.blocks = 0
        self.scatter = np.zeros((len(bits), len(bits)), object)
        self.total = np.zeros(len(bits), object)

    def pack(self, y: np.ndarray) -> np.ndarray:
        """(planes, words): bit ``bit`` of dimension ``dim`` of 64 rows in each word."""
        rows = -(-len(y) // 64) * 64
        out = np.zeros((len(self.dim), rows // 8), np.uint8)
        for p, (d, b) in enumerate(zip(self.dim, self.bit, strict=True)):
            out[p, :-(-len(y) // 8)] = np.packbits((y[:, d] >> np.uint64(b)).astype(np.uint8) & 1)
        return out.view(np.uint64)

    def add(self, y: np.ndarray) -> None:
        """Adds a block of shifted rows (uint64)."""
        words = self.pack(y)
        weight = np.int64(1) << (self.bit % 16)
        group = self.bit // 16
        for p in range(len(words)):
            d, g = self.dim[p], group[p]
            first = int(np.searchsorted(self.dim, d))
            common = np.bitwise_count(words[first:] & words[p]).sum(axis=1, dtype=np.int64) * weight[first:]
            for h in np.unique(group[first:]):
                of = group[first:] == h
                row = np.bincount(self.dim[first:][of], common[of], len(self.bits)).astype(np.int64)
                self.digits[g + h, d] += row << np.int64(self.bit[p] % 16)
            self.sums[g, d] += int(np.bitwise_count(words[p]).sum(dtype=np.int64)) << int(self.bit[p] % 16)
        self.blocks += 1
        if self.blocks % FLUSH == 0:
            self.flush()

    def flush(self) -> None:
        for g, part in enumerate(self.digits):
            self.scatter += part.astype(object) * (1 << 16 * g)
        for g, part in enumerate(self.sums):
            self.total += part.astype(object) * (1 << 16 * g)
        self.digits[:], self.sums[:] = 0, 0


def _limbs(value: int) -> list[int]:
    out = []
    while value:
        out.append(value & LIMB)
        value >>= 32
    return out


def _scatterer(low: np.ndarray, bits: np.ndarray):
    def run(batches):
        planes = Planes(bits)
        for _, x in _slices(batches, len(low)):
            planes.add(x.view(np.uint64) - low.view(np.uint64))
        planes.flush()
        width = len(low)
        i, j = np.triu_indices(width)
        values = planes.scatter[i, j].tolist() + planes.total.tolist()
        for at in range(0, len(values), 1 << 16):
            to = slice(at, at + (1 << 16))
            # the sums of the dimensions are pairs with -1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, np.full(width, -1))[to], pa.int32()), pa.array(np.append(j, np.arange(width))[to], pa.int32()),
                 pa.array([_limbs(v) for v in values[to]], pa.list_(pa.int64()))], ["i", "j", "limbs"])
    return run


def fit(sums: list[int], scatter: list[list[int]], n: int, components: int = COMPONENTS) -> dict[str, np.ndarray]:
    """Components and eigenvalues of the covariance of rows with these sums and cross-products (upper triangle)."""
    width = len(sums)
    v = np.zeros((width, width))
    trace = 0
    for i in range(width):
        for j in range(i, width):
            centred = n * scatter[i][j] - sums[i] * sums[j]
            trace += centred if i == j else 0
            v[i, j] = v[j, i] = centred / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    whole = trace / (n * n)
    return {"values": values, "vectors": vectors * np.where(sign == 0, 1, sign), "trace": np.array(whole),
            "used": values > NOTHING * whole}


def _fitter(width: int, n: int, components: int):
    def run(batches):
        sums = [0] * width
        scatter = [[0] * width for _ in range(width)]
        for batch in batches:
            for i, j, limbs in zip(*(batch[c].to_pylist() for c in ("i", "j", "limbs")), strict=True):
                value = sum(d << 32 * k for k, d in enumerate(limbs))
                if i < 0:
                    sums[j] = value
                else:
                    scatter[i][j] = value
        yield pa.RecordBatch.from_arrays([pa.array([_model(sums, scatter, n, components)], pa.binary())], ["model"])
    return run


def _model(sums: list[int], scatter: list[list[int]], n: int, components: int) -> bytes:
    return packed(fit(sums, scatter, n, components) | {"sums": np.array([str(s) for s in sums])})


class Whitener:
    """Centred, projected and scaled rows of a fitted model, and their exact deviations."""

    def __init__(self, model: bytes, low: np.ndarray, span: int, n: int):
        m = unpacked(model)
        self.low, self.n, self.used = low, n, m["used"]
        self.sums = [int(s) for s in m["sums"]]
        with np.errstate(divide="ignore"):
            scale = np.where(self.used, 1 / np.sqrt(np.maximum(m["values"], 1e-300)), 0.0)
        self.axes = m["vectors"] * scale
        self.explained = m["values"] / m["trace"] if m["trace"] > 0 else np.zeros(len(m["values"]))
        # every centred entry n * y - sum(y) is within n * span
        self.reach = n * span
        self.exact = self.reach < 1 << 52

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: int64, or Python integers where they may not fit."""
        y = x.view(np.uint64) - self.low.view(np.uint64)
        if self.exact:
            return self.n * y.view(np.int64) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64) @ self.axes

    def deviations(self, d: np.ndarray) -> list[int]:
        if not self.exact:
            return (d * d).sum(axis=1).tolist()
        # halves of 26 bits: their products add up within 63 bits
        high, low = d >> 26, d & ((1 << 26) - 1)
        parts = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


def _covariance(whitener: Whitener):
    def run(batches):
        k = len(whitener.used)
        total = np.zeros((k, k))
        for _, x in _slices(batches, len(whitener.low)):
            z = whitener.whitened(whitener.centred(x))
            total += z.T @ z
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "part"])
    return run


def _emit(whitener: Whitener, error: float):
    def run(batches):
        k = len(whitener.used)
        for part, x in _slices(batches, len(whitener.low)):
            d = whitener.centred(x)
            z = whitener.whitened(d)
            deviations = whitener.deviations(d)
            wide = [v >> 63 for v in deviations] if whitener.reach ** 2 * x.shape[1] >> 63 else None
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part["vec_id"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows), whitener.n), pa.int64()),
                pa.array([v if not wide or not wide[i] else None for i, v in enumerate(deviations)], pa.int64()).take(pa.array(rows)),
                pa.array(z.ravel(), mask=np.tile(~whitener.used, len(x))),
                pa.array(np.tile(whitener.explained, len(x))), pa.array(np.full(len(rows), error)),
                pa.array([str(v) if wide and wide[i] else None for i, v in enumerate(deviations)], pa.string()).take(pa.array(rows)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])
    return run


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    x = F.col(vector).cast("array<double>")
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_digits string")
    clean = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(clean).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("vector"))
    # a row per task and width, then a row per dimension
    extremes = rows.select("vector").mapInArrow(_extremes, "width int, n long, low array<long>, high array<long>")
    at = F.posexplode_outer(F.arrays_zip("low", "high")).alias("j", "edge")
    limits = (extremes.select("width", "n", at).groupBy("width", "j")
              .agg(F.sum("n").alias("n"), F.min("edge.low").alias("low"), F.max("edge.high").alias("high")))
    widest = limits.groupBy("width").agg(F.max("n").alias("n")).agg(F.max(F.struct("n", "width")).alias("w"))
    edges = limits.join(F.broadcast(widest), F.col("w.width") == F.col("width")).select("width", "j", limits["n"], "low", "high")
    edges = sorted(r for r in edges.collect() if r["width"])  # one row per dimension
    if not edges:
        return df.sparkSession.createDataFrame([], schema)
    width, n = edges[0]["width"], edges[0]["n"]
    low = np.array([r["low"] for r in edges], np.int64)
    spans = [r["high"] - r["low"] for r in edges]
    rows = rows.where(F.size("vector") == width)
    sent = rows.select("vector").mapInArrow(_scatterer(low, np.array([s.bit_length() for s in spans])),
                                            "i int, j int, limbs array<long>")
    # sums of 0 have no limbs, and no row
    sums = sent.select("i", "j", F.posexplode("limbs").alias("k", "limb")).groupBy("i", "j", "k").agg(F.sum("limb").alias("limb"))
    limbs = (sums.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("k", "limb"))).alias("l"))
             .select("i", "j", F.transform("l", lambda s: s["limb"]).alias("limbs")))
    made = limbs.repartition(1).mapInArrow(_fitter(width, n, components), "model binary").first()
    # without limbs every vector is the same, and no task runs
    model = bytes(made["model"]) if made else _model([0] * width, [[0] * width for _ in range(width)], n, components)
    whitener = Whitener(model, low, max(spans), n)
    parts = rows.select("vector").mapInArrow(_covariance(whitener), "i int, j int, part double")
    error = 0.0
    for r in parts.groupBy("i", "j").agg(F.sum("part").alias("total")).collect():  # components squared
        if whitener.used[r["i"]] and whitener.used[r["j"]]:
            error = max(error, abs(r["total"] / n - (r["i"] == r["j"])))
    return rows.mapInArrow(_emit(whitener, error), schema)
