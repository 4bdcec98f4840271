"""Rust prefix scan, chunk tables and the rows mended with them."""

import random

import pytest

from codeloom.functions import text as T
from codeloom.operators import changes, rust_scan
from codeloom.operators.rust import rust_items
from codeloom.sources import chunks as CH
from codeloom.sources import filetree
from tests.conftest import files_df

PIECES = ['"', "/", "*", "/*", "*/", "//", "\n", 'r#"', 'r"', '"#', "\\", '\\"', "'a'", "'", "#", "x ", "fn f() {\n", "}\n", ";\n",
          "///", 'b"', "[", "]", "#[", "impl X<[u8; [2]]> "]


def test_modes_compose_to_those_of_a_sequential_scan():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60)))
        lines = text.splitlines(keepends=True)
        mode, before = rust_scan.CODE, ""
        for line in lines:
            assert mode == rust_scan.end_mode(before, 0, rust_scan.CODE, {})
            mode = rust_scan.then(mode, rust_scan.mode_map(line))
            before += line
        if '"' not in rust_scan.clean(text) and "impl" not in text and "#[" not in text:
            assert rust_scan.clean(text).count("\n") == text.count("\n")


def test_clean_counts_any_depth():
    deep = "/* " * 1000 + '" fn no() {' + "*/" * 1000
    assert rust_scan.clean(deep + " fn yes() {}").split() == ["fn", "yes()", "{}"]
    assert rust_scan.clean("#[a" + "[" * 500 + "]" * 500 + "\n] struct S;") == "#[]\n struct S;"
    assert rust_scan.clean("impl<T: A<[u8; [1; 2]]>> Q for [T; 3] {") == "impl<T: A<(u8, (1, 2))>> Q for (T, 3) {"
    assert rust_scan.clean("/** d /* n */ */ /*** n */ /// o\n//// n\n//! i\n/**/ x") == "///     ///\n \n \n  x".replace("     ", "   ")


def _big_source(n):
    """Items whose neighbours lie in strings and comments across chunk edges."""
    out, names = [], []
    for i in range(n):
        out.append(f"/* c{i} /* nested\n fn hidden_{i}() {{\n */\n still {{ ; \n*/\nfn f_{i}() {{\n    let s = \"a\n;\n fn no() {{\n\";\n"
                   f"    let r = r##\"\n}}\n\"#;\n fn no2() {{\n\"##;\n}}\n")
        names.append(f"fn f_{i}")
    return "".join(out), names


def test_rust_items_of_many_chunks(spark, monkeypatch):
    text, names = _big_source(400)
    monkeypatch.setattr(rust_scan, "CUT", rust_scan.CUT.replace(str(rust_scan.CHUNK), "300"))
    monkeypatch.setattr(rust_scan, "CHUNK", 300)
    rows = [("a.rs", text, 1), ("b.rs", "fn one() {}\n", 2), ("c.rs", None, 3), ("d.rs", "", 4)]
    got = {r["path"]: r for r in rust_items(spark.createDataFrame(rows, "path string, content string, n int"), carry="n").collect()}
    assert {p: r["n"] for p, r in got.items()} == {"a.rs": 1, "b.rs": 2, "c.rs": 3, "d.rs": 4}
    assert got["a.rs"]["symbols"] == names and got["a.rs"]["parsed"]
    assert [f["lines"] for f in got["a.rs"]["functions"]] == [11] * 400
    assert got["b.rs"]["symbols"] == ["fn one"] and got["c.rs"]["symbols"] == [] and got["d.rs"]["symbols"] == []


BYTES = [b"", b"plain\nlines\n", "ünïcödé 😀 end".encode() * 9, b"ab\xc3", b"\xe2\x82", b"x\xf0\x9f\x98", b"\xff\xfe", b"a\x80b\xc0\xafc",
         b"\xed\xa0\x80 surrogate", b"\xf4\x90\x80\x80", b"z" * 40 + b"\x00", "😀".encode() * 7, b"\xe0\x80\xaf\n", b"no newline"]


@pytest.mark.parametrize("size", [4, 5, 7, 64])
def test_chunks_decode_like_whole_files(spark, size):
    files = spark.createDataFrame([(f"/r/{i}", f"{i}", bytearray(b)) for i, b in enumerate(BYTES)] + [("/r/x", "x", None)],
                                  "path string, relative string, content binary")
    table = CH.chunk_table(files, size)
    assert table.agg({"chunk": "max"}).first()[0] == max(len(b) - 1 for b in BYTES) // size
    lossy, strict = {}, {}
    for r in CH.read_lossy(table).orderBy("relative", "chunk").collect():
        lossy[r["relative"]] = lossy.get(r["relative"], "") + (r["text"] or "")
    for r in CH.read_strict(table).orderBy("relative", "chunk").collect():
        strict.setdefault(r["relative"], []).append(r["text"])
    facts = {r["relative"]: r for r in CH.file_facts(table, size=size).collect()}
    for i, b in enumerate(BYTES):
        key = str(i)
        assert lossy[key] == b.decode("utf-8", "replace"), b
        try:
            text = b.decode("utf-8")
            assert "".join(strict[key]) == text and facts[key]["valid"]
        except UnicodeDecodeError:
            assert None in strict[key] and not facts[key]["valid"]
        assert facts[key]["size"] == len(b) and facts[key]["is_binary"] == (b"\0" in b)
        assert facts[key]["total_lines"] == len(b.split(b"\n")) - (b == b"" or b.endswith(b"\n"))
    assert facts["x"]["error"] == "unreadable" and facts["x"]["size"] is None
    early = {r["relative"]: r["is_binary"] for r in CH.file_facts(table, prefix=40, size=size).collect()}
    assert early["10"] is False


def test_scan_chunks_reads_ranges(spark, tmp_path):
    for i, b in enumerate(BYTES):
        (tmp_path / f"f{i}").write_bytes(b)
    got = CH.scan_chunks(spark, tmp_path, size=6)
    rows = got.orderBy("relative", "chunk").collect()
    assert max(len(r["bytes"]) for r in rows) <= 6 and max(len(r["before"]) for r in rows) <= 3
    for i, b in enumerate(BYTES):
        assert b"".join(bytes(r["bytes"]) for r in rows if r["relative"] == f"f{i}") == b
    facts = {r["relative"]: r["valid"] for r in CH.file_facts(got, size=6).collect()}
    assert facts["f2"] and not facts["f3"]


def test_missing_newline_is_not_a_line(spark):
    old = files_df(spark, [("a", "x"), ("b", "x"), ("c", "x\n")])
    new = files_df(spark, [("a", "x\n\\ No newline at end of file\n"), ("b", "x\n"), ("c", "x")])
    got = sorted(tuple(r) for r in changes.line_changes(old, new).collect())
    note = changes.NO_FINAL_NEWLINE
    assert got == [("a", "+", note, False, 1), ("a", "-", note, True, 1), ("b", "-", note, True, 1), ("c", "+", note, True, 1)]


def test_path_patterns_keep_escaped_dollars(spark, tmp_path):
    for name in ("a$b.txt", "c.txt", "d.txt\n"):
        (tmp_path / name).write_text("x")
    names = lambda **kw: sorted(r["relative"] for r in filetree.scan(spark, str(tmp_path), **kw).collect())
    assert names(include=r"\$b") == ["a$b.txt"] and names(include=r"[$]") == ["a$b.txt"]
    assert names(include=r"\.txt$") == ["a$b.txt", "c.txt"]


def _wide_tree(root):
    for d in range(12):
        for e in range(3):
            (root / f"d{d}" / f"e{e}").mkdir(parents=True)
            for f in ("a.rs", "b.md", ".hidden"):
                (root / f"d{d}" / f"e{e}" / f).write_text("x" * (10 * d + e))
    (root / "top.rs").write_text("top")


def test_source_pushes_filters_into_the_listing(spark, tmp_path):
    _wide_tree(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = filetree.scan(spark, str(tmp_path), list_tasks=4)
    everything = {r["relative"]: r["size"] for r in df.collect()}
    assert len(everything) == 12 * 3 * 3 + 1
    wanted = df.where("relative like 'd1%' and relative like '%.rs' and size > 100 and content is not null")
    # what the source took is not filtered again
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter " in line]
    assert len(left) == 1 and "isnotnull(content" in left[0] and "size" not in left[0] and "relative" not in left[0].split("BatchScan")[0]
    got = sorted(r["relative"] for r in wanted.collect())
    assert got == sorted(r for r, n in everything.items() if r.startswith("d1") and r.endswith(".rs") and n > 100)
    missing = df.where("not (relative = 'top.rs') and size in (0, 3)")
    assert sorted(r["relative"] for r in missing.collect()) == [f"d0/e0/{f}" for f in (".hidden", "a.rs", "b.md")]


def test_source_opens_only_the_files_that_filters_keep(tmp_path, monkeypatch):
    import builtins
    import os
    from pyspark.sql.datasource import GreaterThan, StringEndsWith, StringStartsWith
    _wide_tree(tmp_path)
    opened, entered = [], []
    real_open, real_scan = builtins.open, os.scandir
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: (opened.append(str(p)), real_open(p, *a, **k))[1])
    monkeypatch.setattr(os, "scandir", lambda p: (entered.append(str(p)), real_scan(p))[1])
    reader = filetree.FileTreeReader({"root": str(tmp_path), "listTasks": "4"})
    other = GreaterThan(("mtime",), 0)
    assert list(reader.pushFilters([StringStartsWith(("relative",), "d3/"), StringEndsWith(("relative",), ".rs"), other])) == [other]
    parts = reader.partitions()
    assert not opened and len(entered) <= 4
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[1] for r in rows) == ["d3/e0/a.rs", "d3/e1/a.rs", "d3/e2/a.rs"] and len(opened) == 3
    assert all("/d3" in p or p == os.path.realpath(tmp_path) for p in entered)


def test_trees_at_file_uris(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.txt").write_text("x")
    uri = (tmp_path / "a b").as_uri()
    assert [r["relative"] for r in filetree.scan(spark, uri).collect()] == ["x.txt"]
    assert [r["relative"] for r in filetree.scan_tree(spark, uri).collect()] == ["x.txt"]
    with pytest.raises(ValueError):
        filetree.scan_tree(spark, "hdfs://host/x")


def test_upsert_of_tied_rows_takes_the_newest(spark):
    from codeloom.operators.state import cache_upsert
    schema = "path string, mode string, params string, mtime_ms bigint, text string"
    old = spark.createDataFrame([("p", "m", "{}", 9, "old")], schema)
    for order in (1, -1):
        new = spark.createDataFrame([("p", "m", "{}", 5, "a"), ("p", "m", "{}", 5, "b"), ("p", "m", "{}", 4, "c")][::order], schema)
        assert [tuple(r)[3:] for r in cache_upsert(old, new.repartition(3)).collect()] == [(5, "b")]


def test_limits_are_arguments(spark):
    long = "é" * 9000
    df = spark.createDataFrame([("a.md", long)], "relative string, content string")
    whole, cut = df.select(T.build_prompt("relative", "content", "en").alias("a"), T.build_prompt("relative", "content", "en", 8000).alias("b")).first()
    assert whole.endswith(long) and cut.endswith(T.TRUNCATED_FILE_MARK)
    assert df.select(T.is_binary(df["content"].cast("binary"))).first()[0] is False


def test_chunks_of_a_span_are_read_at_one_opening(tmp_path, monkeypatch):
    import builtins
    import pyarrow as pa
    data = bytes(range(256)) * 20
    (tmp_path / "a.bin").write_bytes(data)
    spans = pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/a.bin", f"{tmp_path}/none"], "relative": ["a.bin", "none"], "first": [3, 0],
                                        "until": [511, 1], "final": [511, 1], "error": pa.array([None, None], pa.string())})
    opened, real = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: opened.append(p) or real(p, *a, **k))
    out = list(CH._span_reader(10)([spans]))
    assert len(opened) == 2 and len(out) == 1
    rows = out[0].to_pylist()
    assert [(r["chunk"], r["before"], r["bytes"], r["last"], r["error"]) for r in rows if r["relative"] == "a.bin"] == [
        (i, data[10 * i - 3:10 * i], data[10 * i:10 * i + 10], i == 511, None) for i in range(3, 512)]
    assert [(r["chunk"], r["bytes"], r["last"], r["error"] is not None) for r in rows if r["relative"] == "none"] == [
        (0, b"", False, True), (1, b"", True, True)]
