"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Tokens are runs of letters (ASCII letters, lower-cased, and all non-ASCII bytes).  A
token's input is a learned vector of the word (if it is in the training vocabulary)
and the mean of learned vectors of its byte trigrams.  Overlapping windows of
``WINDOW`` tokens run through a forward and a backward gated recurrent unit; attention
pools the states, and the pooled state gives the window's logit.  A text's score is
that of its highest window, and training sends the gradient through that window (in the first
``WARM`` epochs through the one with the most telling word).

Training: at most ``PER_CLASS`` labelled rows of each class, chosen by id hash from the
training folds, in one task.  A word vector's first entry starts at the word's log odds
in that sample.  Scoring: all windows of every whole text, one narrow stage, no shuffle;
input projections are computed once per distinct word of a batch.

Defined results: null text or one without letters is one empty window and gets a
score; with labels of one class only (or none) every score is 0.5; repeated rows score
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

WINDOW, STRIDE = 48, 36
WORD_DIM, CHAR_DIM, STATE, ATTENTION = 4, 4, 8, 8
TRIGRAMS = 4096
LEAST_DOCS = 12
PER_CLASS = 800
EPOCHS, BATCH, RATE = 5, 32, 0.01
WARM = 2
LEAST_STEPS = 250  # small samples are read more often
FOLDS, HELD_OUT = 5, 0
FIXED = ("vocabulary", "shift")
ROWS = 2048  # windows run at once

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


# --- inputs -------------------------------------------------------------------------------------

def tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(column, lower=True, separator=~LETTER)
    return words, words.hashes()


def trigrams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram codes of the chosen words, first code of each); words' ends count as byte 0."""
    start, length = words.start[chosen], words.end[chosen] - words.start[chosen]
    first = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(first - start, length)
    raw = words.raw.astype(np.uint32)
    here = raw[at]
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first] = 0
    after[first + length - 1] = 0
    return ((before * np.uint32(7919) + here * np.uint32(104729) + after * np.uint32(1299709)) % np.uint32(TRIGRAMS)).astype(np.int64), first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, text) of every window; a text without tokens has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return first[text] + k * STRIDE, np.minimum(n[text] - k * STRIDE, WINDOW), text


class Inputs:
    """Distinct words of a batch: their vocabulary index, trigrams and input vectors (last row: padding)."""

    def __init__(self, p, words: Words, hashes: np.ndarray):
        distinct, at, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(p["vocabulary"], distinct)
        inside = np.flatnonzero(place < len(p["vocabulary"]))
        held = inside[p["vocabulary"][place[inside]] == distinct[inside]]
        self.word = np.zeros(len(distinct), np.int64)
        self.word[held] = place[held] + 1
        self.pad = len(distinct)
        self.x = np.zeros((len(distinct) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(distinct):
            self.codes, self.first = trigrams(words, at)
            self.count = np.diff(np.append(self.first, len(self.codes)))
            self.x[:-1, :WORD_DIM] = p["E"][self.word]
            self.x[:-1, WORD_DIM:] = np.add.reduceat(p["C"][self.codes], self.first) / self.count[:, None]

    def index(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(window, step) -> distinct word."""
        at = begin[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < size[:, None]
        out = np.full(at.shape, self.pad)
        out[inside] = self.of[at[inside]]
        return out


# --- network ------------------------------------------------------------------------------------

def _fast_sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(p, side: str, g, index, mask, keep: bool):
    """States of one direction, (step, window, state); with ``keep``, what the gradient needs."""
    uzr, uc = p["Uzr" + side], p["Uc" + side]
    steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    h = np.zeros((len(index), STATE), np.float32)
    out = np.empty((WINDOW, len(index), STATE), np.float32)
    cache = {}
    for t in steps:
        gt = g[index[:, t]]
        zr = _fast_sigmoid(gt[:, :2 * STATE] + h @ uzr)
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(gt[:, 2 * STATE:] + (r * h) @ uc)
        if keep:
            cache[t] = (h, z, r, c)
        h = h + (z * mask[:, t, None]) * (c - h)
        out[t] = h
    return out, cache


def forward(p, inputs: Inputs, begin, size, keep: bool = False):
    index = inputs.index(begin, size)
    mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
    both, caches = [], {}
    for side in "fb":
        out, caches[side] = _run(p, side, inputs.x @ p["W" + side] + p["b" + side], index, mask, keep)
        both.append(out)
    s = np.concatenate(both, axis=2)
    q = np.tanh(s @ p["A"])
    e = (q @ p["a"]).T
    e = np.where(mask > 0, e, -1e9)
    e[size == 0] = 0
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,tbs->bs", a, s)
    logit = pooled @ p["o"] + p["c"][0]
    return (logit, (index, mask, caches, s, q, a, pooled)) if keep else logit


def backward(p, inputs: Inputs, cache, d):
    index, mask, caches, s, q, a, pooled = cache
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in FIXED}
    g["o"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dp = d[:, None] * p["o"]
    da = np.einsum("bs,tbs->bt", dp, s)
    de = (a * (da - (a * da).sum(axis=1, keepdims=True))).T * (mask.T > 0)
    ds = a.T[:, :, None] * dp[None]
    g["a"] = np.einsum("tb,tbk->k", de, q)
    dq = de[:, :, None] * p["a"] * (1 - q * q)
    g["A"] = np.einsum("tbs,tbk->sk", s, dq)
    ds = ds + dq @ p["A"].T
    dx = np.zeros_like(inputs.x)
    for side, lo in (("f", 0), ("b", STATE)):
        uzr, uc = p["Uzr" + side], p["Uc" + side]
        dh = np.zeros((len(index), STATE), np.float32)
        dg_all = np.zeros((len(inputs.x), 3 * STATE), np.float32)
        for t in range(WINDOW - 1, -1, -1) if side == "f" else range(WINDOW):
            h, z, r, c = caches[side][t]
            dh = dh + ds[t, :, lo:lo + STATE]
            m = mask[:, t, None]
            dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate((dz, dr), axis=1)
            g["Uzr" + side] += h.T @ dzr
            g["Uc" + side] += (r * h).T @ dc
            np.add.at(dg_all, index[:, t], np.concatenate((dzr, dc), axis=1))
            dh = dh * (1 - m * z) + drh * r + dzr @ uzr.T
        g["W" + side] = inputs.x.T @ dg_all
        g["b" + side] = dg_all.sum(axis=0)
        dx += dg_all @ p["W" + side].T
    if inputs.pad:
        np.add.at(g["E"], inputs.word, dx[:-1, :WORD_DIM])
        np.add.at(g["C"], inputs.codes, np.repeat(dx[:-1, WORD_DIM:] / inputs.count[:, None], inputs.count, axis=0))
    return g


def fit(texts: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
    if not len(y) or y.min() == y.max():
        return {"none": np.zeros(1)}
    words, hashes = tokens(pa.array(texts, pa.string()))
    text_of = np.repeat(np.arange(len(texts)), words.counts)
    pairs = np.unique(np.rec.fromarrays([hashes, text_of], names="h,t"))
    vocabulary, code, docs = np.unique(pairs["h"], return_inverse=True, return_counts=True)
    toxic = np.bincount(code, weights=y[pairs["t"]], minlength=len(vocabulary))
    known = docs >= LEAST_DOCS
    odds = np.log((toxic + 4) / (y.sum() + 8)) - np.log((docs - toxic + 4) / (len(y) - y.sum() + 8))
    rng = np.random.default_rng(11)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p: dict[str, np.ndarray] = {"vocabulary": vocabulary[known]}
    p["E"] = (0.1 * rng.standard_normal((known.sum() + 1, WORD_DIM))).astype(np.float32)
    p["E"][1:, 0] = np.clip(odds[known], -4, 4)
    p["C"] = (0.1 * rng.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32)
    for side in "fb":
        p["W" + side], p["b" + side] = init(WORD_DIM + CHAR_DIM, 3 * STATE), np.zeros(3 * STATE, np.float32)
        p["Uzr" + side], p["Uc" + side] = init(STATE, 2 * STATE), init(STATE, STATE)
    p |= {"A": init(2 * STATE, ATTENTION), "a": init(ATTENTION), "o": init(2 * STATE), "c": np.zeros(1, np.float32)}
    adam = Adam({k: v for k, v in p.items() if k not in FIXED}, RATE)
    start = p["E"][:, 0].copy()
    for epoch in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            some, h = tokens(pa.array([texts[i] for i in chosen], pa.string()))
            inputs = Inputs(p, some, h)
            begin, size, text = windows(some.first)
            if epoch < WARM:  # the network can't tell windows apart yet: go by their most telling word
                odds = np.append(start[inputs.word], -9)
                logit = np.concatenate([odds[inputs.index(begin[i:i + ROWS], size[i:i + ROWS])].max(axis=1)
                                        for i in range(0, len(begin), ROWS)])
            else:
                logit = np.concatenate([forward(p, inputs, begin[i:i + ROWS], size[i:i + ROWS])
                                        for i in range(0, len(begin), ROWS)])
            # the highest window of each text
            by = np.lexsort((-logit, text))
            top = by[np.searchsorted(text[by], np.arange(len(chosen)))]
            value, cache = forward(p, inputs, begin[top], size[top], keep=True)
            adam.step(backward(p, inputs, cache, ((sigmoid(value) - y[chosen]) / len(chosen)).astype(np.float32)))
    return p | {"shift": _shift(scores(p, pa.array(texts, pa.string())), y)}


def _shift(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Calibration: the logit that 0.5 belongs to, midway between the two classes' nearest hundredths."""
    logit = np.log(np.maximum(s, 1e-12)) - np.log(np.maximum(1 - s, 1e-12))
    return np.array([(np.quantile(logit[y == 0], 0.99) + np.quantile(logit[y == 1], 0.01)) / 2])


def scores(model: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    if "none" in model:
        return np.full(len(column), 0.5)
    if not len(column):
        return np.zeros(0)
    words, h = tokens(column)
    inputs = Inputs(model, words, h)
    begin, size, text = windows(words.first)
    logit = np.concatenate([forward(model, inputs, begin[i:i + ROWS], size[i:i + ROWS]) for i in range(0, len(begin), ROWS)])
    top = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(column)))).astype(np.float64)
    return sigmoid(top - model.get("shift", np.zeros(1))[0])


def _scorer(data: bytes):
    def run(batches):
        model = unpacked(data)
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(scores(model, part["text"]))],
                                                 ["doc_id", "held_out", "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = training_rows(texts, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, per_class)
    data = fit_in_task(rows, fit)
    held = texts.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
    out = held.mapInArrow(_scorer(data), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
