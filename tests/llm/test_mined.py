"""Whitening, phrase mining and decontamination against brute force, on awkward small tables."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from check_oracles import rows_of
from codeloom.llm import decontamination, phrases, queries, whitening
from tests.conftest import SF001
from tests.llm.helpers import AWKWARD, DOCS, LOWER

key = lambda r: tuple((x is None, str(x)) for x in r)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# --- op11

def brute_whitening(rows, k=8):
    """x, deviations and components by Python integers and plain covariance."""
    clean = [(i, [int(np.floor(np.float64(c) * 1024)) + 100000 for c in v]) for i, v in rows
             if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, width = len(clean), len(clean[0][1])
    total = [sum(x[d] for _, x in clean) for d in range(width)]
    centred = [(i, [n * x[d] - total[d] for d in range(width)]) for i, x in clean]
    cov = np.array([[sum(c[a] * c[b] for _, c in centred) / n ** 3 for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    z = np.array([c for _, c in centred], dtype=float) / n @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return [(i, sum(x * x for x in c)) for i, c in centred], z, values / np.trace(cov), n


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 12)) * np.linspace(0.1, 3, 12) + rng.standard_normal((200, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[7][1]), (900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12),
             (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, component int").repartition(5)
    got = whitening.whiten(df)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = got.collect()
    deviations, z, explained, n = brute_whitening([r for r in rows if r[0] not in (904, 905)])
    assert n == 202 and len(out) == 8 * n and {r["n"] for r in out} == {n}
    assert sorted(((r["vec_id"], r["deviation"]) for r in out if r["component"] == 1), key=key) == sorted(deviations, key=key)
    per = collections.defaultdict(dict)
    for r in out:
        per[r["vec_id"]][r["component"]] = r["whitened"]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    want = {i: row for (i, _), row in zip(deviations, z, strict=True)}
    for c in range(1, 9):
        sign = np.sign(per[0][c] * want[0][c - 1])
        assert all(abs(per[i][c] - sign * want[i][c - 1]) < 1e-7 for i in want)


def test_planes_hold_exact_products_of_wide_integers():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 1 << 63, (150, 4), dtype=np.uint64) >> np.array([0, 20, 47, 63], np.uint64)
    planes = whitening.Planes(np.array([63, 43, 16, 1]))
    planes.add(y[:100])
    planes.add(y[100:])
    planes.flush()
    for i in range(4):
        assert planes.total[i] == sum(int(v) for v in y[:, i])
        for j in range(i, 4):
            assert planes.scatter[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))


def test_whitening_of_huge_constant_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(3)], kind)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in same)
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    huge = [r for r in whitening.whiten(spark.createDataFrame(rows, kind)).collect() if r["component"] == 1]
    held = [[max(-(1 << 62), min(1 << 62, int(c * 1024))) + 100000 for c in v] for _, v in rows]
    for r in huge:
        exact = sum((3 * held[r["vec_id"] - 1][d] - sum(h[d] for h in held)) ** 2 for d in range(2))
        assert (r["deviation"], r["deviation_digits"]) == ((None, str(exact)) if exact >= 1 << 63 else (exact, None))


# --- op12

def brute_phrases(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if any(100 * b >= 50 * a for (other, q), b in cand.items()
               if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
            continue
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]


PHRASES = [("en", "New York is big. New  York\tis big, new york was. " * 3), ("en", "new york\nnew york is; it is"), (None, "a b c " * 4),
           ("und", "a b  c"), ("en", None), ("en", ""), ("fr", "É é! é É " * 3), ("en", "x"), ("fr", "\t \x0b.")]


@pytest.mark.parametrize("sample", [{"sample": 1, "sample_least": 1}, {"sample": 7, "sample_least": 3}, {"sample": 1, "sample_least": 100}])
def test_phrases_brute_force(spark, sample):
    """Whatever the sample proposes, failures of the border are counted in further passes."""
    df = spark.createDataFrame([(i, lang, t, "z") for i, (lang, t) in enumerate(PHRASES)], "doc_id long, lang string, text string, phrase string")
    for least in (2, 3):
        got = phrases.collocations(df.repartition(3), top=6, least=least, **sample)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert collect(got) == sorted(brute_phrases(PHRASES, least, 6), key=key)


def test_phrases_on_documents(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert collect(queries.QUERIES["op12_phrases"](spark, SF001)) == sorted(brute_phrases(rows, 10), key=key)


def test_phrases_are_sent_in_small_batches():
    """A task holds and sends at most about a million keys of phrases at once, whatever its input."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 8000))) for _ in range(90)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 30), pa.array(texts[i:i + 30])], ["lang", "text"]) for i in (0, 30, 60)]
    sent = list(phrases._key_counter((1, 2, 3))(iter(batches)))
    keys = [sum(len(x) // 4 for x in b["keys"].to_pylist()) for b in sent]
    assert sum(keys) > 2_000_000 and max(keys) <= 600_000


def test_phrases_of_long_texts_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 5000)
    rows = [("en", "the same three " * 20000), ("en", "a b, c d! e\nf g h. " * 3000 + "tail words"), ("fr", "x.y " * 4000)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert collect(got) == sorted(brute_phrases(rows, 10), key=key)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


class Shipped:
    def __init__(self, value):
        self.value = value


def test_rare_phrases_leave_no_task_as_text(monkeypatch):
    """Keys are counted in blocks that add up over tasks; only phrases that reach the bound are sent as text."""
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    monkeypatch.setattr(phrases, "HELD", 500)
    texts = [" ".join(f"r{i}x{j}" for j in range(100)) + ". often seen here" for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 400, "text": texts})
    blocks = [b for half in (batch[:150], batch[150:]) for b in phrases._key_counter((1, 2, 3))([half])]
    assert all(b.num_rows <= phrases.BUCKETS for b in blocks)
    table = pa.Table.from_batches(blocks)
    bitmap, reached = np.zeros(1 << 13, np.uint8), 0
    for k in (1, 2, 3):
        for bucket in set(table.filter(pc.field("k") == k)["bucket"].to_pylist()):
            got = phrases._reaching(300)(table.filter((pc.field("k") == k) & (pc.field("bucket") == bucket)))
            slots = np.frombuffer(got["keys"][0].as_py(), np.uint32).astype(np.int64) & (len(bitmap) * 8 - 1)
            bitmap[slots >> 3] |= (1 << (slots & 7)).astype(np.uint8)
            reached += got["n"][0].as_py()
    assert reached == 6
    f = collections.Counter()
    for sent in phrases._counter(Shipped(bitmap))([batch]):
        for r in sent.to_pylist():
            f[r["k"], r["phrase"]] += r["f"]
    # a few of 119,600 rare phrases share a bit
    assert sum(x == 1 for x in f.values()) < 40
    assert {p: x for p, x in f.items() if x > 1} == {(0, ""): 400 * 103, **{(k, p): 400 for k, p in
                 [(1, "often"), (1, "seen"), (1, "here"), (2, "often seen"), (2, "seen here"), (3, "often seen here")]}}


# --- op13

def brute_decontamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        size = min(10, len(w))
        for at in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[at:at + size])].add(i)
    out = []
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at:at + size]) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[tuple(w[at:at + size])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def _story(seed, n):
    rng = np.random.default_rng(seed)
    return [f"v{x}" for x in rng.integers(0, 400, n)]


def test_decontamination_brute_force(spark):
    a, b = _story(1, 60), _story(2, 14)
    items = [(1, " ".join(a)), (2, " ".join(b)), (10, " ".join(a[5:30]).upper()), (3, "lone"), (4, "two Words"), (5, "a b c d e f g"),
             (None, "no id here at all"), (6, None), (7, "  ,. "), (2, "again another text"), (8, "rep " * 12)]
    long = _story(3, 9000)
    long[2040:2054] = b  # across the end of a segment
    long[5000:5030] = a[10:40]
    docs = [(i, t) for i, t, *_ in AWKWARD] + [
        (20, " ".join(long)), (21, ", ".join(a[:10])), (22, " ".join(a[:9])), (23, " ".join(a[50:] + a)), (24, "x two, words lone é"),
        (25, "rep " * 5000), (26, "a b c d e f g h a b c d e f"), (27, "no id here at all lone"), (24, "x two, words lone é"), (28, "again another text")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, row int, item string").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    assert collect(decontamination.decontaminate(df, bench)) == sorted(brute_decontamination(docs, items), key=key)
    none = decontamination.decontaminate(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in none)
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0


def test_shared_spans_are_always_found(spark):
    """Every span of a window's length has a fingerprint of both sides, wherever it lies."""
    words = [f"w{i % 3}{i % 7}" for i in range(200)]
    items = [(i, " ".join(words[i:i + 10 + i % 5])) for i in range(0, 150, 7)]
    docs = [(i, " ".join(["pre"] * (i % 4) + words[i:i + 10] + ["post"])) for i in range(0, 180)]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    assert collect(got) == sorted(brute_decontamination(docs, items), key=key)


def test_sql_of_decontamination_on_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    bench = spark.createDataFrame([(1, AWKWARD[0][1][:200]), (2, "of of"), (None, "é ñ")], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    df = decontamination.decontaminate(docs, bench)
    res = con.execute(queries.ORACLES["op13_decontamination"])
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
