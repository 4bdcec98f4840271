"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded by means
of its words' properties and a hashed bag of words; gated attention (tanh times
sigmoid) weighs the encoded passages, and the weighted sum is scored.  Only document
labels are used: the passages' weights are learned.

Training: at most ``PER_CLASS`` labelled rows of each class, chosen by id hash from
the training folds, in one task.  Scoring: every passage of every text, one narrow
stage, no shuffle; the model is a few kilobytes.

Defined results: null or empty text is a bag of one empty passage and gets a score;
with labels of one class only (or none) every score is 0.5; repeated rows score
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.labelled import Adam, fit_in_task, fold, sigmoid, training_rows, unpacked
from codeloom.llm.substring_dedup import chunks
from codeloom.llm.wordscan import Words

PASSAGE = 100
BUCKETS = 64
HIDDEN, ATTENTION = 16, 8
PER_CLASS = 2000
STEPS, RATE, DECAY = 250, 0.02, 1e-4
FOLDS, HELD_OUT = 3, 1

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "symbol": b"#*$%&|<>@^_=+~{}[]\\", "stress": b"!?", "stop": b".,;:",
}


#: counts of all classes travel in one 64-bit number, LANE bits each
LANE = 9


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint64)
    for k, members in enumerate(_CLASSES.values()):
        table[list(members)] += np.uint64(1 << (LANE * k))
    return table


BYTE_CLASS = _classes()


def class_shares(words: Words) -> np.ndarray:
    """(word, class) share of the word's bytes."""
    length = words.end - words.start
    total = np.add.reduceat(BYTE_CLASS[words.raw], words.start)
    out = np.empty((len(length), len(_CLASSES)), np.float32)
    for k in range(len(_CLASSES)):
        out[:, k] = ((total >> np.uint64(LANE * k)) & np.uint64((1 << LANE) - 1)) / length
    for i in np.flatnonzero(length >= 1 << LANE):  # too long for the lanes
        own = np.bincount(words.raw[words.start[i]:words.end[i]], minlength=256)
        out[i] = [own[list(m)].sum() / length[i] for m in _CLASSES.values()]
    return out
FEATURES = 2 * len(_CLASSES) + 5 + BUCKETS


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, index of each text's first passage)."""
    words = Words(column)
    counts = words.counts
    n_pass = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_pass)))
    x = np.zeros((first[-1], FEATURES), np.float32)
    if len(words.start):
        place = np.arange(len(words.start)) - np.repeat(words.first[:-1], counts)
        owner = np.repeat(first[:-1], counts) + place // PASSAGE
        length = (words.end - words.start).astype(np.float32)
        size = np.bincount(owner, minlength=first[-1]).astype(np.float32)
        k = len(_CLASSES)
        columns = []
        shares = class_shares(words)
        for c in range(k):
            columns += [shares[:, c], (shares[:, c] > 0.5).astype(np.float32)]
        h = words.hashes()
        again = np.zeros(len(h), np.float32)
        again[1:] = (h[1:] == h[:-1]) & (place[1:] > 0)
        columns += [np.minimum(length, 30) / 10, (length <= 2).astype(np.float32), (length > 14).astype(np.float32), again]
        safe = np.maximum(size, 1)
        for c, v in enumerate(columns):
            x[:, c] = np.bincount(owner, weights=v, minlength=first[-1]) / safe
        x[:, len(columns)] = np.log1p(size) / 5
        hashed = np.bincount(owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=first[-1] * BUCKETS)
        x[:, -BUCKETS:] = hashed.reshape(-1, BUCKETS) / safe[:, None] * 8
    return x, first


def _forward(p, x, first):
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    top = np.maximum.reduceat(e, first[:-1])
    a = np.exp(e - np.repeat(top, np.diff(first)))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), np.diff(first))
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return h, t, g, a, z, z @ p["o"] + p["c"][0]


def fit(texts: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
    if not len(y) or y.min() == y.max():
        return {"none": np.zeros(1)}
    x, first = bags(pa.array(texts, pa.string()))
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / std
    rng = np.random.default_rng(7)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION),
         "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "o": init(HIDDEN), "c": np.zeros(1, np.float32)}
    adam, size = Adam(p, RATE), np.diff(first)
    for _ in range(STEPS):
        h, t, g, a, z, logit = _forward(p, x, first)
        d = (sigmoid(logit) - y) / len(y)
        dz = d[:, None] * p["o"]
        dzr = np.repeat(dz, size, axis=0)
        da = (dzr * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        adam.step({"o": z.T @ d, "c": np.array([d.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg,
                   "W": x.T @ dpre + DECAY * p["W"], "b": dpre.sum(axis=0)})
    return p | {"mean": mean, "std": std}


def scores(model: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    if "none" in model:
        return np.full(len(column), 0.5)
    x, first = bags(column)
    return sigmoid(_forward(model, (x - model["mean"]) / model["std"], first)[-1]).astype(np.float64)


def _scorer(data: bytes):
    def run(batches):
        model = unpacked(data)
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(scores(model, part["text"]))],
                                                 ["doc_id", "held_out", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = training_rows(texts, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, per_class)
    data = fit_in_task(rows, fit)
    held = texts.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
    out = held.mapInArrow(_scorer(data), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
