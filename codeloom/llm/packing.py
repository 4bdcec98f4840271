"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised whole (ids of the tokenizer, then one end id).  Documents
longer than a sequence are cut into full pieces; the first piece takes the
remainder.  Every task packs the pieces of its partition by bounded-space online
best fit: at most ``open_bins`` sequences are open, a bitset indexed by free space
finds the tightest one that takes the piece, and when a new one is needed the
fullest open one closes.  Pieces arrive in windows of ``WINDOW``, longest first.

Scale: one narrow stage over the input's partitions, no shuffle; a task holds
one batch of texts, one window of pieces and ``open_bins`` counters.  Output depends only on the rows of
the partition in order, so a retried task gives the same sequences.

Defined results: null or empty text is one piece, the end id; repeated rows are
separate documents; ids of ``doc_id`` may be null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
END_ID = 2
OPEN_BINS = 512
#: pieces that a task gathers and places longest first
WINDOW = 1024
SCHEMA = ("doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def read_ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def same_ids(tokenizer_path: str, ranks_path: str, pattern: str) -> bool:
    """Whether tiktoken over ``ranks_path`` gives the ids of ``tokenizer_path`` for every text without special tokens.

    Both split by ``pattern`` and merge the pair of least rank, but tiktoken merges any pair whose
    concatenation is in the vocabulary, the tokenizer only the listed one.  They agree if the vocabulary is
    the same, merges are listed in the order of their tokens' ids, and each merged token's bytes, merged as tiktoken does
    by lower ranks alone, end as its listed pair: by induction over ranks no other pair ever meets.  The split engines'
    character classes are compared on every code point that may hold a character.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex")
             and not split.get("add_prefix_space") and not any(model.get(k) for k in (
                 "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return False
    ranks, alphabet = read_ranks(ranks_path), byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    raw = lambda token: bytes(alphabet[c] for c in token)
    if {raw(t): i for t, i in model["vocab"].items() if t not in special} != ranks:
        return False
    last = -1
    for x, y in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        x, y = raw(x), raw(y)
        rank = ranks.get(x + y, -1)
        if rank <= last or merged(x + y, ranks, rank) != [x, y]:
            return False
        last = rank
    if len(ranks) != 256 + len(model["merges"]) or any(bytes([b]) not in ranks for b in range(256)):
        return False
    fast, slow = _tiktoken(ranks_path, pattern), _tokenizer(tokenizer_path)
    # planes 4 to 13 hold no characters in any version of Unicode, and 15 and 16 only private ones
    for begin in [*range(0, 0x40000, 1 << 13), 0xE0000]:
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(begin, begin + (1 << 13)) if not 0xD800 <= c < 0xE000)
        if fast.encode_ordinary(text) != slow.encode(text, add_special_tokens=False).ids:
            return False
    return True


def merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """``token`` merged from bytes by the pairs of rank less than ``below``, least first."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _tiktoken(ranks_path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(tokenizer_path, ranks_path, pattern)


class Encoder:
    """Ids of ``tokenizer_path`` (tokenizers); plain texts go through ``ranks_path`` (tiktoken, about six times as
    fast), which ``same_ids`` has proved equal.  Texts holding a special token, or that the fast path
    can't take, are encoded by the tokenizer itself, which is only then loaded."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        self.path = tokenizer_path
        self.tokenizer = None
        with open(tokenizer_path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = _tiktoken(ranks_path, pattern) if ranks_path else None

    @property
    def slow(self):
        if self.tokenizer is None:
            self.tokenizer = _tokenizer(self.path)
        return self.tokenizer

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.specials):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except (ValueError, RuntimeError, UnicodeError):
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


class BestFit:
    """Bounded-space online best fit over bins of ``size``."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[int]] = {}
        self.n_open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        if length == self.size:
            self.made += 1
            return self.made - 1, 0
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = self._take(room)
        else:
            if self.n_open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.n_open -= 1
            at, room = self.made, self.size
            self.made += 1
            self.n_open += 1
        if room > length:
            self.bins.setdefault(room - length, []).append(at)
            self.free |= 1 << (room - length)
        else:
            self.n_open -= 1
        return at, self.size - room

    def _take(self, room: int) -> int:
        stack = self.bins[room]
        at = stack.pop()
        if not stack:
            self.free &= ~(1 << room)
        return at


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= size:
        return [(0, n)]
    head = n % size
    out = [(0, head)] if head else []
    return out + [(s, size) for s in range(head, n, size)]


def _packer(tokenizer_path, ranks_path, pattern, size, end_id, open_bins):
    def run(batches):
        encode = encoder(tokenizer_path, ranks_path, pattern)
        fit = BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        waiting: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end))
                waiting += [(length, doc_id, k, start, ids[start:start + length].tobytes())
                            for k, (start, length) in enumerate(pieces(len(ids), size))]
                if len(waiting) >= WINDOW:
                    yield _placed(waiting, fit, base)
                    waiting = []
        if waiting:
            yield _placed(waiting, fit, base)
    return run


def _placed(waiting: list[tuple], fit: BestFit, base: int) -> pa.RecordBatch:
    rows = []
    for length, doc_id, k, start, ids in sorted(waiting, key=lambda w: -w[0]):
        at, offset = fit.place(length)
        rows.append((doc_id, k, start, length, ids, base + at, offset))
    return _batch(list(zip(*rows, strict=True)))


def _batch(cols) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None,
         ranks_path: str | None = None, pattern: str | None = None, size: int = MAX_TOKENS, end_id: int = END_ID,
         open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Without ``tokenizer_path``, the byte-level BPE of the installed public vocabularies is used.
    """
    if tokenizer_path is None:
        import public_tokenizers as P
        tokenizer_path, ranks_path = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
        pattern = P.PATTERN
    if ranks_path and not same_ids(str(tokenizer_path), str(ranks_path), pattern):
        ranks_path = None
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(_packer(str(tokenizer_path), ranks_path and str(ranks_path), pattern, size, end_id, open_bins),
                            SCHEMA)


def with_digest(packed: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
