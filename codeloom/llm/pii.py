"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.  The
field is trained on a small table of marked sentences and adds spans that the
patterns miss (numbers without a country code, spelled-out addresses).  A span that
it adds must not overlap a base span and must pass the kind's own check (digits,
checksum, parts at most 255).

The field sees shapes only: words without a digit, ``@``, ``+`` or a bracketed "at"
share one shape ("plain").  After training, the margin by which a plain word among
plain words prefers "outside" is compared with the most that transitions can give;
when it is larger, a line of plain words is outside in any best path, so only lines
with another word are decoded (Viterbi, numpy).  Otherwise all are.

Scale: one narrow stage, no shuffle; the model (a few hundred weights) travels
with the task.  Defined results: null text is empty; an empty text has no spans;
repeated rows are judged alike; extra columns are ignored; an empty table gives an
empty result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The marked sentences: [kind text] is a span.
TABLE = """
write to [email ann.lee@mail.example.org] about the plan
mail [email j.doe+news@example.com] or call
address [email bob_77@host-3.example.net]. thanks
contact [email kim(at)example.org] today
send it to [email max [at] example [dot] com] please
the man at the dot on that map said so
and of the on with a was in for that is by it
[email info@example.co.uk], [email sales@example.co.uk] and others
the symbol @ stands alone here
see the file a@b for this
call [phone +1 (365) 555-7869] now
ring [phone +49 30 1234567] at noon
phone [phone +44 20 7946 0958] or write
my number is [phone (365) 555-7869] in town
tel [phone 365-555-7869] tonight
fax [phone 030 1234567 89] and mail
text [phone 365.555.7869] later
the line [phone 555 123 4567] is open
host [ip 42.144.35.254] answered
from [ip 10.0.0.1] to [ip 192.168.1.77] at once
server [ip 8.8.8.8], then the next
card [card 4111111111111111] was used
pay with [card 4111 1111 1111 1111] here
visa [card 5500-0000-0000-0004] declined
number [card 378282246310005] on file
card [card 4111.1111.1111.1111] was read
in 2019 we sold 30 of 45 items
version 4.0 and 2.0. of the text
chapter 12, page 340 and note 7
the price was 1,250.00 or 12.50 each
it ran 3 times in 10.5 days
release 1.2.3 came after 1.2.2 last week
from 1990 to 2005 there were 14 wars
see section 3.1.4 of the book
room 101 is on floor 10
order 12345 shipped on 2020-05-14 at 10:30
under the licence CC BY-SA 4.0 and others
a score of 3-2 or 5 - 4
id 9f86d081884c7d659a2f and key A1B2C3
about 1000000 people and 250000 cars
add 1 + 2 to get 3
"""
LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
ADDRESS_WORDS = frozenset(("[at]", "[dot]", "(at)", "(dot)"))
TRIM_LEFT, TRIM_RIGHT = "\"'<[{", "\"'>]},;:!?."
EPOCHS, RATE, RIDGE = 120, 0.3, 1e-3


# --- shapes and features ------------------------------------------------------------------------

def shape(word: str) -> str:
    """Collapsed character classes with digit counts; words without digit, @ or + give '' (plain)."""
    if not any("0" <= c <= "9" or c in "@+" for c in word) and "(at)" not in word and "[at]" not in word:
        return "at" if word in ADDRESS_WORDS else ""
    out, last, run = [], "", 0
    for c in word + "\0":
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if kind == last:
            run += 1
            continue
        if last:
            out.append(f"9{min(run, 9)}" if last == "9" else last)
        last, run = kind, 1
    return "".join(out)


def features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w.strip(".,;:!?\"'")) or "plain" for w in words]
    digits = [min(sum("0" <= c <= "9" for c in w), 20) for w in words]
    out = []
    for i, s in enumerate(shapes):
        before, after = shapes[i - 1] if i else "start", shapes[i + 1] if i + 1 < len(words) else "end"
        f = [f"s={s}", f"p={before}|{s}", f"n={s}|{after}"]
        if s != "plain":
            f += [f"d={digits[i]}", f"a={'@' in words[i]}", f"u={'+' in words[i]}", f"dots={words[i].strip('.,').count('.')}"]
        out.append(f)
    return out


# --- the field ----------------------------------------------------------------------------------

class Field:
    def __init__(self, names: dict[str, int], unary: np.ndarray, trans: np.ndarray):
        self.names, self.unary, self.trans = names, unary, trans
        # A line of plain words has four kinds of features.  Turning a stretch of m words to "outside"
        # costs at most into + (m - 1) * within + out in transitions and gains m margins.
        stay, into = trans[0, 0], max(0.0, trans[0, 1:].max() - trans[0, 0])
        within, out = trans[1:, 1:].max() - stay, max(0.0, trans[1:, 0].max() - stay)
        e = self.emissions([["s=plain", f"p={p}|plain", f"n=plain|{n}"] for p in ("start", "plain") for n in ("plain", "end")])
        margin = float((e[:, 0] - e[:, 1:].max(axis=1)).min())
        self.margin, self.needed = margin, float(max(within, into + out))
        #: a line of plain words is outside in any best path
        self.plain_is_outside = margin > max(within, into + out)

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for i, f in enumerate(feats):
            for name in f:
                k = self.names.get(name)
                if k is not None:
                    out[i] += self.unary[k]
        return out

    def decode(self, words: list[str]) -> list[int]:
        """Viterbi."""
        e = self.emissions(features(words))
        best, back = e[0].copy(), []
        for row in e[1:]:
            step = best[:, None] + self.trans
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def parse(line: str) -> tuple[list[str], list[str]]:
    """Words and labels of a marked sentence."""
    words, labels = [], []
    for outside, kind, inside in re.findall(r"([^\[]+|\[(?![a-z]+ ))|\[(email|ip|card|phone) ((?:[^\[\]]|\[at\]|\[dot\])+)\]", line):
        if kind:
            part = inside.split()
            words += part
            labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(part) - 1)
        else:
            part = outside.split()
            if part and not outside[:1].isspace() and words:
                words[-1] += part.pop(0)  # punctuation after a span
            words += part
            labels += ["O"] * len(part)
    return words, labels


@lru_cache(maxsize=4)
def train(table: str = TABLE) -> Field:
    """Maximum likelihood with a ridge, by full-batch adaptive gradient steps."""
    rows = [parse(x) for x in table.strip().splitlines()]
    names: dict[str, int] = {}
    data = []
    for words, labels in rows:
        feats = features(words)
        for f in feats:
            for n in f:
                names.setdefault(n, len(names))
        data.append(([[names[n] for n in f] for f in feats], [LABELS.index(y) for y in labels]))
    k = len(LABELS)
    unary, trans = np.zeros((len(names), k)), np.zeros((k, k))
    seen_u, seen_t = np.full(unary.shape, 1e-8), np.full(trans.shape, 1e-8)
    for _ in range(EPOCHS):
        gu, gt = -RIDGE * unary, -RIDGE * trans
        for feats, ys in data:
            e = np.array([unary[f].sum(axis=0) for f in feats])
            n = len(ys)
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = e[0]
            for i in range(1, n):
                fwd[i] = e[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + trans, axis=0)
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(trans + (e[i + 1] + bwd[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(fwd[-1])
            node = np.exp(fwd + bwd - z)
            for i, (f, y) in enumerate(zip(feats, ys, strict=True)):
                delta = -node[i]
                delta[y] += 1
                gu[f] += delta
                if i:
                    gt -= np.exp(fwd[i - 1][:, None] + trans + (e[i] + bwd[i])[None, :] - z)
                    gt[ys[i - 1], y] += 1
        seen_u += gu * gu
        seen_t += gt * gt
        unary += RATE * gu / np.sqrt(seen_u)
        trans += RATE * gt / np.sqrt(seen_t)
    return Field(names, unary, trans)


# --- spans --------------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in s.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the base patterns: leftmost, non-overlapping per kind."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    for rank, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if valid(KINDS[rank], m.group())]
    return sorted(out)


LINE = re.compile(r"[^\n]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_PLAIN = re.compile(r"[0-9@+]|[(\[](?:at|dot)[)\]]")


def added_ok(kind: str, s: str) -> bool:
    """The checks on spans of the field; stricter than the patterns'."""
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+\s*(?:@|\(at\)|\[at\]|\sat\s)\s*[^\s@]+(?:\s*(?:\.|\(dot\)|\[dot\]|\sdot\s)\s*[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s)) and valid(kind, s)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ .\-]?[0-9])+", s)) and valid(kind, s)
    return bool(re.fullmatch(r"\+?[ ().0-9\-/]+", s)) and valid(kind, s)


def field_spans(text: str, field: Field, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) found by the field outside the base spans."""
    out = []
    for line in LINE.finditer(text):
        if field.plain_is_outside and not NOT_PLAIN.search(line.group()):
            continue
        cut = [(m.start(), m.end()) for m in WORD.finditer(text, line.start(), line.end())]
        if not cut:
            continue
        labels = field.decode([text[a:b] for a, b in cut])
        i = 0
        while i < len(cut):
            name = LABELS[labels[i]]
            j = i + 1
            if name != "O":
                kind = name[2:]
                while j < len(cut) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                a, b = cut[i][0], cut[j - 1][1]
                while a < b and text[a] in TRIM_LEFT:
                    a += 1
                while a < b and text[b - 1] in TRIM_RIGHT:
                    b -= 1
                if b > a and added_ok(kind, text[a:b]) and not any(s < b and a < e for s, _, e in base):
                    out.append((a, KINDS.index(kind), b))
            i = j
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def _finder(field: Field):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text.as_py() or ""
                found = base_spans(text) if NOT_PLAIN.search(text) else []
                more = field_spans(text, field, found)
                rows.append((*(sum(k == r for _, k, _ in found) for r in range(4)), joined(found), joined(found + more)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])
    return run


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text", table: str = TABLE) -> DataFrame:
    """One row per row of ``df``: doc_id, counts of base spans, base_spans and spans (kind:start:end, joined)."""
    field = train(table)
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(_finder(field), SCHEMA)


def _redacter(field: Field, column: str):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch[column]:
                text = text.as_py()
                if text:
                    found = base_spans(text) if NOT_PLAIN.search(text) else []
                    parts, at = [], 0
                    for a, k, b in sorted(found + field_spans(text, field, found)):
                        if b > at:
                            parts += [text[at:max(a, at)], f"[{KINDS[k].upper()}]" if a >= at else ""]
                            at = b
                    text = "".join(parts) + text[at:]
                out.append(text)
            k = batch.schema.get_field_index(column)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))
    return run


def redact(df: DataFrame, text: str = "text", table: str = TABLE) -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; other columns unchanged."""
    return df.mapInArrow(_redacter(train(table), text), df.schema)


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
