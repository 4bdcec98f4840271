"""Scalar functions: literal cases of the reference's unit tests plus edge cases."""

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.state import llm_params, pattern_params


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("v")).collect()]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1536, 1048576, 1073741824, 1280, 1 << 50, (1 << 60) * 3]
    got = one(spark, T.human_size("n"), [(x,) for x in sizes], "n long")
    assert got == ["0 B", "1023.0 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "1.0 GiB", "1.2 KiB", "1.0 PiB", "3072.0 PiB"]


def test_head_lines(spark):
    s = "a\nb\nc\nd\ne"
    assert one(spark, T.head_lines("t", 3), [(s,)], "t string") == ["a\nb\nc\n[...truncated...]"]
    assert one(spark, T.head_lines("t", 5), [(s,)], "t string") == [s]
    assert one(spark, T.head_lines("t", 10), [(s,)], "t string") == [s]
    # CRLF line ends are dropped, final newline too, even when nothing is cut
    assert one(spark, T.head_lines("t", 5), [("x\r\ny\n",)], "t string") == ["x\ny"]


def test_line_count(spark):
    got = one(spark, T.line_count("t"), [("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",), ("a\r\nb\r\n",)], "t string")
    assert got == [0, 1, 1, 2, 2, 2]


def test_is_binary(spark):
    data = [(b"hello world",), (bytes([0, 1, 2, 3]),), (bytes([0x68, 0, 0x65, 0]),), (b"",),
            (b"a" * 1024 + b"\x00",)]
    assert one(spark, T.is_binary("b", 1024), data, "b binary") == [False, True, True, False, False]


def test_lang_tag_and_ext(spark):
    paths = ["main.rs", "script.py", "README.md", "unknown.xyz", "no_extension", ".env", "a.b/Makefile",
             "x/.gitignore", "cfg.json", "dir.v2/file"]
    tags = one(spark, T.lang_tag("p"), [(p,) for p in paths], "p string")
    assert tags == ["rust", "python", "markdown", "", "", "", "", "", "json", ""]
    exts = one(spark, T.file_ext("p"), [(p,) for p in paths], "p string")
    assert exts == ["rs", "py", "md", "xyz", "no_extension", "env", "b/Makefile", "gitignore", "json", "v2/file"]


def test_xml_escapes(spark):
    assert one(spark, T.xml_attr_escape("s"), [("a&b<c>d\"e'f",)], "s string") == ["a&amp;b&lt;c&gt;d&quot;e&apos;f"]
    body = one(spark, T.xml_body("s"), [("x ]]> y <&>",), ("fn main() {}",)], "s string")
    assert body == ["x ]]&gt; y &lt;&amp;&gt;", "<![CDATA[fn main() {}]]>"]


def test_iso_time(spark):
    got = spark.range(1).select(T.iso_time(F.timestamp_seconds(F.lit(1700000000))).alias("v")).first()[0]
    assert got == "2023-11-14T22:13:20Z"


def test_describe_text(spark):
    syms = [[f"fn f{i}" for i in range(12)], [], ["class A"]]
    got = one(spark, T.describe_text("s"), [(s,) for s in syms], "s array<string>")
    assert got[0] == ", ".join(f"fn f{i}" for i in range(10)) + ", …"
    assert got[1:] == ["no symbols", "class A"]
    full = one(spark, T.describe_text("s", no_truncate=True), [(syms[0],)], "s array<string>")
    assert "…" not in full[0] and "fn f11" in full[0]


def test_byte_truncate_on_char_boundary(spark):
    s = "a" * 7999 + "é" + "b" * 10          # 'é' occupies bytes 8000-8001
    got = one(spark, T.byte_truncate("t"), [(s,), ("short",)], "t string")
    assert got[0] == "a" * 7999 + "\n\n[...file truncated...]"
    assert got[1] == "short"
    exact = "x" * 8000
    assert one(spark, T.byte_truncate("t"), [(exact,)], "t string") == [exact]


def test_strict_and_lossy_decode(spark):
    data = [(b"ok \xc3\xa9",), (b"bad \xff\xfe",)]
    assert one(spark, T.as_text_strict("b"), data, "b binary") == ["ok é", None]
    assert one(spark, T.as_text_lossy("b"), data, "b binary") == ["ok é", "bad ��"]


def test_completion_parsing(spark):
    bodies = ['{"choices":[{"message":{"content":"  This is a test file.\\n"}}]}',
              '{"choices":[{"message":{"content":5}}]}', '{"choices":[]}', "not json",
              '{"choices":[{"message":{"content":null}}]}']
    texts = one(spark, T.completion_text("b"), [(b,) for b in bodies], "b string")
    assert texts == ["This is a test file.", None, None, None, None]
    errs = one(spark, T.completion_error("b"), [(b,) for b in bodies], "b string")
    assert errs == [None] + ["no content in response"] * 4


def test_prompt(spark):
    got = one(spark, T.build_prompt("r", "c", "english"), [("src/a.rs", "fn main() {}")], "r string, c string")
    assert got == ["Describe the purpose of this src/a.rs file in one line (max 20 words) in English:\n\nfn main() {}"]


def test_cache_params():
    assert pattern_params("a", "b") == '{"exclude":"b","include":"a","version":1}'
    assert llm_params("RU", [{"model": "m", "options": {"temperature": 0.2}}, {"model": "x"}]) == \
        '{"backend_params":{"model":"m","temperature":0.2},"language":"ru"}'
