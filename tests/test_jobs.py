"""End-to-end jobs over a small directory tree."""

import json
import os

from codeloom.operators.dump import DumpOptions
from codeloom.plans import jobs
from codeloom.session import scratch_path


def _tree(tmp_path):
    for rel, text in [("src/main.rs", "fn main() {\n" + "    // x\n" * 25 + "}\n"), ("src/lib.py", "class A:\n"),
                      ("README.md", "# Title\n"), ("target/debug/app.rs", "fn x() {}\n"), ("notes.bin", "x"),
                      (".gitignore", "*.log\n"), ("debug.log", "noise\n")]:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def _read_parts(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts)


def test_analyze_plain_json_and_long(spark, tmp_path):
    _tree(tmp_path)
    files = jobs.load(spark, str(tmp_path))
    entries, _ = jobs.analyze(files, jobs.AnalyzeOptions(format="plain"))
    out = scratch_path(spark, "job-plain")
    jobs.write_document(entries, out)
    text = _read_parts(out)
    # the unanchored default exclude also drops '.gitignore' itself (a reference quirk)
    assert text == ("├── README.md [1 lines] (heading Title)\n└── src/\n"
                    "    ├── lib.py [1 lines] (class A)\n    └── main.rs [27 lines] (fn main) (long: 1)\n")
    js, _ = jobs.analyze(files, jobs.AnalyzeOptions(format="json"))
    out = scratch_path(spark, "job-json")
    jobs.write_document(js, out)
    tree = json.loads(_read_parts(out))
    assert [c["name"] for c in tree["children"]] == ["README.md", "src"]
    lg, _ = jobs.analyze(files, jobs.AnalyzeOptions(long=20))
    out = scratch_path(spark, "job-long")
    jobs.write_document(lg, out)
    assert _read_parts(out) == "src/main.rs [27 lines]\n  └── main: 27 lines\n\n"


def test_export_markdown(spark, tmp_path):
    _tree(tmp_path)
    files = jobs.load(spark, str(tmp_path))
    out = scratch_path(spark, "job-md")
    jobs.write_document(jobs.export(files, "markdown", DumpOptions(max_lines=2), include=r"\.(md|py)$"), out)
    assert _read_parts(out) == ("## `README.md`\n\n```markdown\n# Title\n```\n\n"
                                "## `src/lib.py`\n\n```python\nclass A:\n```\n\n")


def test_analyze_llm_mode_with_cache(spark, tmp_path):
    from codeloom.operators import describe as U
    from codeloom.operators import state as S
    _tree(tmp_path)
    files = jobs.load(spark, str(tmp_path))
    answer = U.Backend("stub", "m", lambda body: (200, json.dumps({"choices": [{"message": {"content": " ok "}}]})))
    opts = jobs.AnalyzeOptions(mode="llm", format="plain", backends=[answer], results=S.empty_results(spark))
    entries, results = jobs.analyze(files, opts)
    lines = sorted(r.entry for r in entries.collect())
    assert lines == sorted(["├── README.md (ok)", "└── src/", "    ├── lib.py (ok)", "    └── main.rs (ok)"])
    saved = spark.read.parquet(S.write_results(results, spark))
    assert saved.filter("mode = 'llm'").count() == 3
    again, _ = jobs.analyze(files, jobs.AnalyzeOptions(mode="llm", format="plain", backends=[answer], results=saved))
    assert sorted(r.entry for r in again.collect()) == lines
    for fmt, have in (("json", '"description": "ok"'), ("xml", 'description="ok"')):  # the model's text, not 'no symbols'
        rows, _ = jobs.analyze(files, jobs.AnalyzeOptions(mode="llm", format=fmt, backends=[answer], results=saved))
        assert sum(have in r.entry for r in rows.collect()) == 3
    desc, _ = S.incremental_describe(files, saved, [answer])
    assert {r["from_cache"] for r in U.llm_descriptions(desc).collect()} == {False, True}  # '.gitignore' is not in the results
