"""Operators on literal file tables (the reference's unit cases, re-expressed as rows)."""

import json
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions.patterns import DEFAULT_REGISTRY
from codeloom.operators import changes as X
from codeloom.operators import describe as U
from codeloom.operators import dump as D
from codeloom.operators import filters as Fl
from codeloom.operators import gitignore as G
from codeloom.operators import long_report as R
from codeloom.operators import state as S
from codeloom.operators import summary as A
from codeloom.operators import tree as Tr
from codeloom.operators.rust import rust_items
from tests.conftest import files_df

RUST_NINE = """
            struct MyStruct;
            enum MyEnum { A, B }
            fn my_function() {}
            pub fn public_fn() {}
            async fn async_fn() {}
            impl MyStruct {}
            trait MyTrait {}
            type MyType = i32;
            const MY_CONST: i32 = 42;
        """


def summary(spark, rows, **cfg):
    return {r.relative: r for r in A.file_summary(files_df(spark, rows), A.PatternConfig(**cfg)).collect()}


def test_select_paths_include_exclude(spark):
    rows = [(p, "content\n") for p in ["src/main.rs", "src/lib.rs", "tests/test.rs", "target/debug/app",
                                       "README.md", ".git/config"]]
    kept = Fl.select_paths(files_df(spark, rows), r"\.(rs|md)$", r"target|\.git").orderBy("relative")
    assert [r.relative for r in kept.collect()] == ["README.md", "src/lib.rs", "src/main.rs", "tests/test.rs"]


def test_default_filter_quirks(spark):
    paths = ["src/environment.rs", "builder.py", "lib/distance.go", ".github/ci.yml", ".gitignore", "Makefile",
             "docs/README", "a/Dockerfile", "x.rs\n", "notes.txt", "img.png", "k.jsx"]
    kept = {r.relative for r in Fl.select_paths(files_df(spark, [(p, "") for p in paths])).collect()}
    assert kept == {"Makefile", "docs/README", "a/Dockerfile", "notes.txt"}


def test_size_guard(spark):
    out = summary(spark, [("large.rs", "a" * (2 * 1024 * 1024))], max_file_size=1024 * 1024)
    r = out["large.rs"]
    assert r.text == "[ERROR]" and "SKIPPED" in r.error and r.total_lines is None
    assert r.error == "[SKIPPED: file too large (2097152 > 1048576)]"


def test_rust_integration(spark):
    src = "\n            struct MyStruct;\n            fn func1() {}\n            fn func2() {\n" \
          "                // lines\n            }\n        "
    r = summary(spark, [("test.rs", src)], no_truncate=True)["test.rs"]
    assert {"struct MyStruct", "fn func1", "fn func2"} <= set(r.symbols)
    assert len(r.functions) == 2
    assert [(f.name, f.lines) for f in r.functions] == [("func1", 1), ("func2", 3)]


def test_rust_nine_items(spark):
    r = summary(spark, [("test.rs", RUST_NINE)])["test.rs"]
    assert r.symbols == ["struct MyStruct", "enum MyEnum", "fn my_function", "fn public_fn", "fn async_fn",
                         "impl MyStruct", "trait MyTrait", "type MyType", "const MY_CONST"]
    assert len(r.functions) == 3 and "…" not in r.text


def test_no_symbols_and_truncation(spark):
    many = "".join(f"fn func{i}() {{}}\n" for i in range(1, 20))
    out = summary(spark, [("t.txt", "just plain text without any symbols"), ("many.rs", many)])
    assert out["t.txt"].text == "no symbols" and out["t.txt"].symbols == []
    assert out["many.rs"].text.endswith(", …") and len(out["many.rs"].symbols) == 19
    full = summary(spark, [("many.rs", many)], no_truncate=True)["many.rs"].text
    assert "fn func1" in full and "fn func19" in full and "…" not in full


def test_regex_dialect(spark):
    rows = [("a.py", "class Größe:\n    pass\nx\rclass Hidden:\n"),
            ("b.md", "# Title\r\n## Sub\n"),
            ("c.cs", "public class A {\n  if (x) {\n  }\n}\n"),
            ("d.json", '{\n  "k": 1,\n  "m": {"n": 2}\n}\n'),
            ("e.toml", "[pkg]\nname = 1\n[[bin]]\n"),
            ("f.py", "X = 1\nY == 2\nAB_1 = 3\n")]
    out = summary(spark, rows)
    assert out["a.py"].symbols == ["class Größe"]           # Unicode \w; lone CR is not a line break
    assert out["b.md"].symbols == ["heading Title\r", "heading Sub"]
    assert out["c.cs"].symbols == ["class A", "method if"]   # keyword calls count as methods
    assert out["d.json"].symbols == ["key k", "key m"]
    assert out["e.toml"].symbols == ["table pkg", "key name"]
    assert out["f.py"].symbols == ["const AB_1"]             # single capitals are not constants


def test_long_word_run_does_not_overflow(spark):
    text = ("word " * 200_000) + "(x) {\n"
    r = summary(spark, [("big.cs", text), ("big.java", "public " + text)])
    assert r["big.cs"].symbols == ["method word"]
    assert r["big.java"].symbols == ["method word"]


def test_undecodable_is_an_error_row(spark):
    df = files_df(spark, [("bad.py", b"\xff\xfe\x00def"), ("ok.py", b"def f(x):\n")], binary=True)
    out = {r.relative: r for r in A.file_summary(df).collect()}
    assert out["bad.py"].error == "unreadable" and out["ok.py"].symbols == ["def f"]


def test_registered_language(spark):
    reg = DEFAULT_REGISTRY.register("sql", [("table", r"(?m)^\s*create\s+table\s+(\w+)")])
    out = summary(spark, [("s.sql", "create table users (\n);\ncreate table orders (\n);\n")], registry=reg)
    assert out["s.sql"].symbols == ["table users", "table orders"]


def test_writers_exact(spark):
    df = files_df(spark, [("path/to/file.txt", "line1\nline2"), ("path/file.rs", "fn main() {}"),
                          ("e.txt", "")])
    plain = {r.relative: r.entry + "\n" for r in D.dump_plain(df).collect()}
    assert plain["path/to/file.txt"] == "==== File: path/to/file.txt ====\nline1\nline2\n\n"
    assert plain["e.txt"] == "==== File: e.txt ====\n[EMPTY FILE]\n\n"
    md = {r.relative: r.entry + "\n" for r in D.dump_markdown(df).collect()}
    assert md["path/file.rs"] == "## `path/file.rs`\n\n```rust\nfn main() {}\n```\n\n"
    assert md["e.txt"] == "## `e.txt`\n\n```\n[EMPTY FILE]\n```\n\n"
    det = {r.relative: r.entry for r in D.dump_plain(df, D.DumpOptions(detailed=True)).collect()}
    assert det["path/file.rs"].startswith("==== File: path/file.rs (size: 12.0 B, modified: 2023-11-14T22:13:20Z) ====")
    xml = {r.section: r.entry for r in D.dump_xml(df, project_name="p&q", generated="T").collect()
           if r.section != 1}
    assert xml[0].endswith('<project name="p&amp;q" generated="T">\n  <files>')
    rows = {r.relative: r.entry for r in D.dump_xml(df).collect() if r.section == 1}
    assert rows["path/file.rs"] == ('    <file path="path/file.rs" size="12" mtime="1700000000">\n'
                                    '      <![CDATA[fn main() {}]]>\n    </file>')
    assert rows["e.txt"] == '    <file path="e.txt" size="0" mtime="1700000000" error="[EMPTY FILE]" />'


def test_dump_limits_and_binary(spark):
    df = files_df(spark, [("a.txt", "1\n2\n3\n4\n5"), ("big.txt", "x" * 2000)])
    st = {r.relative: r for r in D.dump_status(df, D.DumpOptions(max_size=1024, max_lines=3)).collect()}
    assert st["a.txt"].body == "1\n2\n3\n[...truncated...]"
    assert st["big.txt"].reason == "[SKIPPED: file size 2.0 KiB > limit 1.0 KiB]"
    b = files_df(spark, [("bin.dat", bytes([0, 1, 2, 3]))], binary=True)
    assert D.dump_status(b).first().reason == "[BINARY FILE SKIPPED]"
    lossy = D.dump_status(files_df(spark, [("u.txt", b"ok\xff")], binary=True), D.DumpOptions(include_binary=True))
    assert lossy.first().body == "ok\ufffd"


def _desc(spark, rel, total, fns):
    return spark.createDataFrame([(rel, total, [], fns, "t", None)],
                                 "relative string, total_lines bigint, symbols array<string>, "
                                 "functions array<struct<name:string,lines:bigint>>, text string, error string")


def test_long_report(spark):
    d = _desc(spark, "file.rs", 100, [("f1", 30), ("f2", 10)])
    rep = R.long_report(d, 20).collect()
    assert [(f.name, f.lines) for f in rep[0].long] == [("f1", 30)]
    text = R.long_text(d, 20).first().entry + "\n"
    assert text == "file.rs [100 lines]\n  └── f1: 30 lines\n\n"
    doc = "\n".join(r.entry for r in R.long_json(d, 20).orderBy("section", "relative").collect())
    parsed = json.loads(doc)
    assert parsed == [{"file": "file.rs", "long_functions": [{"lines": 30, "name": "f1"}], "total_lines": 100}]
    xml = "\n".join(r.entry for r in R.long_xml(d, 20).orderBy("section", "relative").collect())
    assert '<file path="file.rs" total_lines="100">' in xml and '<function name="f1" lines="30" />' in xml
    empty = [r.entry for r in R.long_json(d, 50).collect()]
    assert empty == ["[]"]


def test_cache_upsert_semantics(spark):
    schema = "path string, mode string, params string, mtime_ms bigint, text string, v bigint"
    rows = spark.createDataFrame([("f.rs", "mode", '{"p":1}', 1, "text1", 1),
                                  ("f.rs", "mode", '{"p":2}', 1, "text2", 2)], schema)
    empty = spark.createDataFrame([], "path string, mode string, params string, mtime_ms bigint, text string")
    two = S.cache_upsert(empty, rows, "v")
    assert two.count() == 2
    same = spark.createDataFrame([("f.rs", "mode", '{"p":1}', 1, "text1", 1),
                                  ("f.rs", "mode", '{"p":1}', 1, "text2", 2)], schema)
    one = S.cache_upsert(empty, same, "v").collect()
    assert len(one) == 1 and one[0].text == "text2"
    files = spark.createDataFrame([("f.rs", 1)], "path string, mtime_ms long")
    assert S.cache_hits(two, files, "mode", '{"p":1}').count() == 1
    stale = spark.createDataFrame([("f.rs", 2)], "path string, mtime_ms long")
    assert S.cache_hits(two, stale, "mode", '{"p":1}').count() == 0
    assert S.cache_misses(stale, two, "mode", '{"p":1}').count() == 1


def test_contents_move_once_beside_many_hits(spark, monkeypatch):
    """Beyond the broadcast bound contents are dealt by path once and not sorted; the rows are the same."""
    rows = [(f"/r/{n}", n, len(t), t, 1000 + i) for i, (n, t) in enumerate(
        [("a.py", "class A:\n"), ("b.rs", "fn f() {\n}\n"), ("c.py", "def g(x):\n"), ("d.rs", "struct S;\n"), ("a.py", "class B:\n")])]
    rows.append((None, "n.py", 3, "x=1", 5))
    df = spark.createDataFrame(rows, "path string, relative string, size bigint, content string, at bigint").withColumn(
        "mtime", F.timestamp_seconds("at")).drop("at")
    _, results = S.incremental_summary(df.where("relative in ('c.py', 'd.rs')"), S.empty_results(spark))
    stored = spark.read.parquet(S.write_results(results, spark, "many-hits"))
    few = sorted(map(str, S.incremental_summary(df, stored)[0].collect()))
    plans, write = {}, S.materialize

    def keep(table, name="table"):
        plans[name] = table._jdf.queryExecution().executedPlan().toString()
        return write(table, name)

    monkeypatch.setattr(S, "materialize", keep)
    monkeypatch.setattr(S, "BROADCAST_HITS", 0, raising=False)
    desc = S.incremental_summary(df, stored)[0]
    assert sorted(map(str, desc.collect())) == few and desc.where("from_cache").count() == 2
    plan = plans["fresh-descriptions"]
    joins = re.findall(r"(\w+) \[path#\d+\], \[path#\d+\], LeftAnti", plan)
    assert joins and set(joins) == {"ShuffledHashJoin"}
    assert "RoundRobinPartitioning" not in plan.split("LeftAnti")[0]  # above the join of the plain files


def test_incremental_summary_roundtrip(spark):
    df = files_df(spark, [("a.py", "def f(x):\n"), ("b.py", "class B:\n")])
    first, results = S.incremental_summary(df, S.empty_results(spark))
    assert {r.relative: r.from_cache for r in first.collect()} == {"a.py": False, "b.py": False}
    saved = spark.read.parquet(S.write_results(results, spark))
    second, _ = S.incremental_summary(df, saved)
    got = {r.relative: (r.from_cache, r.text) for r in second.collect()}
    assert got == {"a.py": (True, "def f"), "b.py": (True, "class B")}


def _ok(text):
    return lambda body: (200, json.dumps({"choices": [{"message": {"content": text}}]}))


def test_describe_llm_fallback(spark):
    df = files_df(spark, [("test.txt", "dummy content")])
    ok = U.describe_llm(df, [U.Backend("test", "m", _ok("This is a test file."))], "en").first()
    assert ok.text == "This is a test file." and ok.error is None
    fb = U.describe_llm(df, [U.Backend("fail", "a", lambda b: (500, "")),
                             U.Backend("success", "b", _ok("Fallback response"))], "en").first()
    assert fb.text == "Fallback response" and fb.backend == "success"
    bad = U.describe_llm(df, [U.Backend("fail", "a", lambda b: (500, ""))], "en").first()
    assert bad.text == "[ERROR]" and bad.error == "all backends failed"
    with pytest.raises(ValueError, match="No LLM backends configured"):
        U.describe_llm(df, [], "en")


def test_request_body(spark):
    body = spark.range(1).select(U.request_body(F.lit("hi"), "m", {"temperature": 0.2}).alias("b")).first().b
    assert json.loads(body) == {"max_tokens": 150, "messages": [{"content": "hi", "role": "user"}], "model": "m",
                                "options": {"temperature": 0.2}, "temperature": 0.2}
    assert body.index('"max_tokens"') < body.index('"messages"') < body.index('"model"') < body.index('"temperature"')


def test_line_changes(spark):
    old = spark.createDataFrame([("test.txt", "initial content\n"), ("gone.txt", "x")], "relative string, content string")
    new = spark.createDataFrame([("test.txt", "modified content\n"), ("new.txt", "y")], "relative string, content string")
    st = {r.relative: r.status for r in X.snapshot_diff(old, new).collect()}
    assert st == {"test.txt": "modified", "gone.txt": "removed", "new.txt": "added"}
    ch = {(r.change, r.line, r.n) for r in X.line_changes(old, new).collect()}
    assert ch == {("+", "modified content", 1), ("-", "initial content", 1)}


def test_tree(spark):
    d = spark.createDataFrame(
        [("a/b.rs", 3, ["fn b"], "fn b", None), ("a/c.rs", None, [], "[ERROR]", "x"), ("d.rs", 1, [], "no symbols", None)],
        "relative string, total_lines bigint, symbols array<string>, text string, error string") \
        .withColumn("functions", F.array().cast("array<struct<name:string,lines:bigint>>"))
    lines = [r.entry for r in Tr.tree_plain(d).orderBy(F.split("node", "/")).collect()]
    assert lines == ["├── a/", "│   ├── b.rs [3 lines] (fn b)", "│   └── c.rs ([ERROR])", "└── d.rs [1 lines]"]
    xml = Tr.tree_xml(d).select(Tr.sort_key(F.when(F.col("node") == "", F.array().cast("array<string>"))
                                            .otherwise(F.split("node", "/")), F.col("phase")).alias("k"), "entry")
    doc = [r.entry for r in xml.orderBy("k").collect()]
    assert doc[0] == '<directory name="">' and doc[-1] == "</directory>\n"
    assert '<file name="b.rs" description="fn b" long_functions="0" total_lines="3" />' in doc
    js = Tr.tree_json(d).select(Tr.sort_key(F.when(F.col("node") == "", F.array().cast("array<string>"))
                                            .otherwise(F.split("node", "/")), F.col("phase")).alias("k"), "entry")
    tree = json.loads("\n".join(r.entry for r in js.orderBy("k").collect()))
    assert tree["name"] == "" and [c["name"] for c in tree["children"]] == ["a", "d.rs"]
    assert tree["children"][0]["children"][1] == {"description": "no symbols", "error": "x", "name": "c.rs",
                                                  "symbols": []}
    stub = [r.entry for r in Tr.tree_json(d, max_depth=0).collect()]
    assert json.loads(stub[0]) == {"name": "", "truncated": True}
    empty = d.filter("false")
    assert [r.entry for r in Tr.tree_plain(empty).collect()] == ["No matching files found."]


def _ignored_by_plain_rules(paths, rules):
    """Every prefix against every rule above it; the last match decides."""
    out = set()
    for path in paths:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            verdict = False
            for j in range(k):
                for rule in rules.get("/".join(parts[:j]), []):
                    negated, dir_only, regex = G.glob_to_regex(rule)
                    if (k < len(parts) or not dir_only) and re.search(regex.replace(r"\z", r"\Z"), "/".join(parts[j:k])):
                        verdict = not negated
            if verdict:
                out.add(path)
    return out


def test_ignore_patterns_equal_rule_by_rule_matching(spark):
    import random
    rng = random.Random(3)
    names, globs = ["a", "b", "x.log", "y.txt", "q+.(1)"], ["a", "*.log", "b/", "/a", "a/b", "**/x.log", "a/**", "?.txt", "q+*", "[ab]"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(160)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    dirs = sorted({"/".join(p.split("/")[:k]) for p in paths for k in range(len(p.split("/")))})
    rules = {d: [rng.choice(["", "", "!"]) + rng.choice(globs) for _ in range(rng.randint(1, 5))] for d in rng.sample(dirs, len(dirs) // 2) + [""]}
    rows = [(p, "") for p in paths] + [((d + "/" if d else "") + ".gitignore", "\n".join(r)) for d, r in rules.items()]
    want = _ignored_by_plain_rules([p for p, _ in rows], rules)
    kept = {r.relative for r in G.gitignore_filter(files_df(spark, rows)).collect()}
    assert kept == {p for p, _ in rows} - want and want
    assert G.directory_verdicts(files_df(spark, rows), G.gitignore_rules(files_df(spark, rows))).count() == len(set(dirs) | {""})


def test_gitignore(spark):
    rows = [(".gitignore", "target/\n*.log\n!keep.log\n# c\nbuild/\n!build/x.rs\n"),
            ("src/a.rs", ""), ("src/b.log", ""), ("keep.log", ""), ("target/t.rs", ""),
            ("build/x.rs", ""), ("sub/.gitignore", "!*.log\n"), ("sub/c.log", ""), ("notdir/target", "")]
    kept = {r.relative for r in G.gitignore_filter(files_df(spark, rows)).collect()}
    assert kept == {".gitignore", "src/a.rs", "keep.log", "sub/.gitignore", "sub/c.log", "notdir/target"}


def test_scan_hidden_files(spark, tmp_path):
    from codeloom.sources import filetree as FT
    for rel, data in [("c.txt", b"c"), ("a/b.txt", b"b"), ("a.txt", b"a"), ("pkg/__init__.py", b"x"),
                      (".env", b"K=V"), ("big.bin", b"\x00" * 100)]:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "link.txt").symlink_to(tmp_path / "c.txt")
    df = FT.scan(spark, str(tmp_path), max_size=50)
    rows = df.orderBy("relative").collect()
    assert [r.relative for r in rows] == [".env", "a.txt", "a/b.txt", "big.bin", "c.txt", "pkg/__init__.py"]
    assert all(r.path.startswith("/") for r in rows)
    assert [r.content for r in rows if r.relative == "big.bin"] == [None]
    inc = FT.scan(spark, str(tmp_path), include=r"\.txt$", exclude="a/")
    assert sorted(r.relative for r in inc.collect()) == ["a.txt", "c.txt"]
    dist = FT.scan_tree(spark, str(tmp_path), max_size=50).orderBy("relative").collect()
    assert [(r.relative, r.size, r.content) for r in dist] == [(r.relative, r.size, r.content) for r in rows]
    inc2 = FT.scan_tree(spark, str(tmp_path), include=r"\.txt$", exclude="a/")
    assert sorted(r.relative for r in inc2.collect()) == ["a.txt", "c.txt"]


def test_plans_stay_in_the_jvm(spark):
    df = files_df(spark, [("a.rs", RUST_NINE), ("b.py", "def f():\n")])
    plan = A.file_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_invariant_under_repartition(spark):
    rows = [(f"m{i}.rs", RUST_NINE) for i in range(6)] + [(f"p{i}.py", "class A:\n def f(x):\n") for i in range(6)]
    a = sorted(map(tuple, A.summary_report(A.file_summary(files_df(spark, rows))).collect()))
    b = sorted(map(tuple, A.summary_report(A.file_summary(files_df(spark, rows).repartition(7),
                                                          A.PatternConfig(rust_partitions=3))).collect()))
    assert a == b


def test_absolute_paths_and_empty_trees(spark):
    df = files_df(spark, [("src/a.rs", "fn a() {}\n")])
    plain = D.dump_plain(df, D.DumpOptions(absolute_paths=True)).first().entry
    assert plain.startswith("==== File: /root/src/a.rs ====")
    empty = A.file_summary(df).filter("false")
    assert [r.entry for r in Tr.tree_json(empty).collect()] == ["[]"]
    assert [r.entry for r in Tr.tree_xml(empty).collect()] == ["<files />"]


def test_incremental_describe_cache_before_size_guard(spark):
    df = files_df(spark, [("a.txt", "x" * 50), ("b.txt", "y")])
    ok = [U.Backend("m", "model", _ok("described"))]
    first, results = S.incremental_describe(df, S.empty_results(spark), ok, "en", max_file_size=10)
    got = {r.relative: (r.text, r.from_cache) for r in first.collect()}
    assert got == {"a.txt": ("[ERROR]", False), "b.txt": ("described", False)}
    saved = spark.read.parquet(S.write_results(results, spark))
    assert saved.count() == 1  # errors are never stored
    again, _ = S.incremental_describe(df, saved, ok, "en", max_file_size=10)
    assert {r.relative: r.from_cache for r in again.collect()} == {"a.txt": False, "b.txt": True}


RUST_REAL = '''use std::collections::HashMap;

/// A point.
#[derive(Debug, Clone)]
pub struct Point<T: Copy> {
    x: T,
    y: T,
}

impl<T: Copy + Default> Default for Point<T> {
    fn default() -> Self {
        Point { x: T::default(), y: T::default() }
    }
}

unsafe impl<T: Copy> Send for Point<T> {}

pub(crate) async fn fetch(url: &str) -> Result<String, ()> {
    let s = "}";
    let c = '{';
    let f = |x: u8| { x + 1 };
    match url.len() {
        0 => Err(()),
        _ => Ok(s.to_string()),
    }
}

pub mod nested {
    pub enum Kind { A, B(u8), C { v: i32 } }
    pub const LIMIT: usize = 10;
    pub fn helper(v: [u8; 4]) -> usize {
        v.len()
    }
}

fn r#match() {}
'''


def test_rust_realistic_items(spark):
    r = summary(spark, [("lib.rs", RUST_REAL)], no_truncate=True)["lib.rs"]
    assert r.symbols == ["struct Point", "impl Default", "fn default", "impl Send", "fn fetch", "enum Kind",
                         "const LIMIT", "fn helper", "fn r#match"]
    assert [(f.name, f.lines) for f in r.functions] == [("default", 3), ("fetch", 9), ("helper", 3),
                                                        ("r#match", 1)]
    assert r.total_lines == 36


def test_color_tree(spark):
    d = spark.createDataFrame(
        [("a/b.rs", 3, ["fn b"], "fn b", None), ("a/c.rs", None, [], "[ERROR]", "x")],
        "relative string, total_lines bigint, symbols array<string>, text string, error string") \
        .withColumn("functions", F.array().cast("array<struct<name:string,lines:bigint>>"))
    lines = [r.entry for r in Tr.tree_plain(d, color=True).orderBy(F.split("node", "/")).collect()]
    assert lines[0] == "\x1b[90m\x1b[0m\x1b[90m└── \x1b[0m\x1b[1;36ma\x1b[0m/"
    assert lines[1] == "\x1b[90m    \x1b[0m\x1b[90m├── \x1b[0m\x1b[1;32mb.rs\x1b[0m [3 lines] (fn b)"
    assert lines[2].endswith("\x1b[1;31mc.rs\x1b[0m ([ERROR])")


def test_rust_long_token_free_gap(spark):
    big = "fn big() {\n    let v = [" + ", ".join(["12345"] * 300000) + "];\n}\nconst X: u8 = 1;\n"
    r = summary(spark, [("big.rs", big)])["big.rs"]
    assert r.symbols == ["fn big", "const X"] and [(f.name, f.lines) for f in r.functions] == [("big", 3)]


def test_rust_token_free_tail(spark):
    tail = "word " * 200_000
    rows = summary(spark, [("t.rs", "fn a() {\n}\n// end\n" + tail), ("free.rs", tail), ("empty.rs", "")])
    assert rows["t.rs"].symbols == ["fn a"] and [(f.name, f.lines) for f in rows["t.rs"].functions] == [("a", 2)]
    assert not rows["free.rs"].symbols and not rows["empty.rs"].symbols


def test_http_backend_failure_falls_back(spark):
    # port 9 (discard) is closed here: the client gets a connection error, never a server
    dead = U.http_backend("dead", "http://127.0.0.1:9/v1/chat/completions", "m", timeout_s=2)
    status, _ = dead.send('{"x": 1}')
    assert status == 0
    df = files_df(spark, [("t.txt", "content")])
    row = U.describe_llm(df, [dead, U.Backend("ok", "m2", _ok("fine"))], "en").first()
    assert row.text == "fine" and row.backend == "ok"


def test_rust_extern_blocks_hold_no_items(spark):
    src = 'extern "C" {\n    fn abs(x: i32) -> i32;\n    static ERRNO: i32;\n}\nextern "C" fn cb() {\n}\nextern crate core;\nfn after() {}\n'
    r = summary(spark, [("ffi.rs", src)])["ffi.rs"]
    assert r.symbols == ["fn cb", "fn after"]
    assert [(f.name, f.lines) for f in r.functions] == [("cb", 2), ("after", 1)]


def test_rust_nested_block_comments(spark):
    src = "/* outer /* inner { */ still comment } */\nfn real() {\n}\n/** doc /* nested */ */\nfn documented() {}\n"
    r = summary(spark, [("c.rs", src)])["c.rs"]
    assert r.symbols == ["fn real", "fn documented"]
    assert [(f.name, f.lines) for f in r.functions] == [("real", 2), ("documented", 2)]


def test_rust_attribute_strings_and_array_impls(spark):
    src = ('#[doc = "see [x] and ]"]\n#[cfg_attr(test, derive([Debug]))]\nfn a() {\n}\n'
           'impl Trait for [u8; 4] {\n    fn m(&self) {}\n}\n')
    r = summary(spark, [("x.rs", src)])["x.rs"]
    assert r.symbols == ["fn a", "impl Trait", "fn m"]
    assert [(f.name, f.lines) for f in r.functions] == [("a", 4), ("m", 1)]


def test_rust_deep_nesting(spark):
    comment = "/* " * 10 + "fn gone() {}" + " */" * 10
    deep = "A<" * 8 + "u8" + ">" * 8
    code = f"{comment}\n#[cfg(any(a[b[c]]))]\nfn here() {{\n}}\nimpl Show for {deep} {{\n}}\nimpl<T: {deep}> Z<T> {{\n}}\n"
    out = rust_items(spark.createDataFrame([("a.rs", code)], "path string, content string")).collect()[0]
    assert out["symbols"] == ["fn here", "impl Show", "impl Z"]


def test_sort_files_positions(spark):
    names = [f"d{i % 7}/f{i:03d}" for i in range(100)] + ["é", "Z", "a"]
    df = spark.createDataFrame([(n,) for n in names], "relative string").repartition(5)
    got = [tuple(r) for r in A.sort_files(df).orderBy("position").collect()]
    assert got == [(n, i + 1) for i, n in enumerate(sorted(names, key=str.encode))]
