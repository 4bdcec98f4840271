"""The copy-on-write results store."""

import os

import pytest

from codeloom.operators.results_store import ResultsStore

SCHEMA = "path string, mode string, params string, mtime_ms bigint, text string"


def _rows(spark, items):
    return spark.createDataFrame([(p, "m", "{}", n, t) for p, n, t in items], SCHEMA)


def _content(df):
    return sorted((r["path"], r["mtime_ms"], r["text"]) for r in df.collect())


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    store = ResultsStore(spark, str(tmp_path / "s"), 8, SCHEMA)
    assert store.snapshot() == 0 and _content(store.read()) == []
    first = [(f"p{i}", 1, f"t{i}") for i in range(200)]
    assert store.upsert(_rows(spark, first)) == 1
    before = _files(tmp_path / "s" / "data")
    assert store.upsert(_rows(spark, [("p3", 2, "new"), ("p3", 3, "newer")])) == 2
    added = _files(tmp_path / "s" / "data") - before
    assert before <= _files(tmp_path / "s" / "data") and len({os.path.dirname(f) for f in added}) == 1
    assert sum(map(os.path.getsize, added)) < sum(map(os.path.getsize, before)) / 3
    want = sorted((p, 3, "newer") if p == "p3" else (p, n, t) for p, n, t in first)
    assert _content(store.read()) == want and _content(store.read(1)) == sorted(first)
    assert store.upsert(_rows(spark, [])) == 2


def test_a_dead_run_changes_nothing_and_its_rerun_is_the_same(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = ResultsStore(spark, path, 4, SCHEMA)
    store.upsert(_rows(spark, [("a", 1, "x"), ("b", 1, "y")]))
    real = spark.createDataFrame

    def dies(data, schema=None, **kw):
        if isinstance(schema, str) and schema.startswith("bucket int"):
            raise RuntimeError("lost before the manifest")
        return real(data, schema, **kw)
    change = _rows(spark, [("a", 2, "z"), ("c", 1, "w")])
    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        store.upsert(change)
    monkeypatch.undo()
    again = ResultsStore(spark, path, 99, SCHEMA)  # the number of buckets is the store's
    assert again.buckets == 4 and again.snapshot() == 1 and _content(again.read()) == [("a", 1, "x"), ("b", 1, "y")]
    assert again.upsert(change) == 2
    assert _content(again.read()) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
