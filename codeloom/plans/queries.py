"""Query definitions registered for the driver contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.patterns import LANGUAGE_PATTERNS
from codeloom.functions import text as T
from codeloom.operators import changes as X
from codeloom.operators import describe as U
from codeloom.operators import dump as D
from codeloom.operators import state as S
from codeloom.operators import filters as Fl
from codeloom.operators import gitignore as G
from codeloom.operators import long_report as R
from codeloom.operators import summary as A
from codeloom.operators import tree as Tr
from codeloom.plans import oracle as O
from codeloom.plans.registry import query
from codeloom.session import materialize
from codeloom.sources import chunks as CH
from codeloom.sources import corpora as C
from codeloom.sources import filetree as FT
from codeloom.streaming import arrivals as ST

# ---------------------------------------------------------------- A2 / E / N


@query("file_summary", O.file_summary_sql(O.code_files_cte(), "code_files", with_rust=True))
def file_summary(spark, sf_dir):
    """Flagship: one description row per rendered source file (all languages)."""
    return A.summary_report(A.file_summary(C.code_files(spark, sf_dir)))


for _exts, _pats in LANGUAGE_PATTERNS:
    _langs = [e for e in _exts if e in C.CODE_LANGUAGES]
    if not _langs:
        continue

    def _make(langs):
        def fn(spark, sf_dir):
            return A.symbol_rows(A.file_summary(C.code_files(spark, sf_dir, langs)))
        return fn
    query("sym_" + _langs[0], O.symbol_rows_sql(O.code_files_cte(_langs), "code_files"))(_make(_langs))


@query("sym_markup", O.symbol_rows_sql("," .join([O.config_files_cte(), O.chat_files_cte().lstrip()]),
                                       "(SELECT relative, content FROM config_files UNION ALL"
                                       " SELECT relative, content FROM chat_files)"))
def sym_markup(spark, sf_dir):
    """Toml / yaml / json keys and markdown headings."""
    files = C.config_files(spark, sf_dir).unionByName(C.chat_files(spark, sf_dir))
    return A.symbol_rows(A.file_summary(files))


@query("sym_rust", O.rust_symbol_rows_sql())
def sym_rust(spark, sf_dir):
    """Rust items in source order."""
    return A.symbol_rows(A.file_summary(C.code_files(spark, sf_dir, ["rs"])))


@query("symbols_all", O.symbols_all_sql())
def symbols_all(spark, sf_dir):
    """Dispatch over every language of the mixed corpus, exploded."""
    files = C.code_files(spark, sf_dir).unionByName(C.config_files(spark, sf_dir)) \
        .unionByName(C.chat_files(spark, sf_dir))
    return A.symbol_rows(A.file_summary(files))


@query("symbol_distinct", O.symbol_distinct_sql())
def symbol_distinct(spark, sf_dir):
    """A1: distinct symbols per file and kind (first-seen dedupe, counted)."""
    files = C.code_files(spark, sf_dir).unionByName(C.config_files(spark, sf_dir)) \
        .unionByName(C.chat_files(spark, sf_dir))
    rows = A.symbol_rows(A.file_summary(files))
    return rows.groupBy("relative", "kind").agg(F.count("*").cast("bigint").alias("n_symbols"),
                                                F.min("pos").cast("bigint").alias("first_pos"))


@query("function_spans", O.function_spans_sql())
def function_spans(spark, sf_dir):
    """(relative, pos, name, lines) for every Rust function with a body."""
    return A.function_rows(A.file_summary(C.code_files(spark, sf_dir)))


@query("long_functions", O.function_spans_sql(min_lines=20))
def long_functions_q(spark, sf_dir):
    """Functions of at least 20 lines."""
    return A.function_rows(A.file_summary(C.code_files(spark, sf_dir))).filter(F.col("lines") >= 20)


@query("long_count_per_file", O.long_count_sql(20))
def long_count_per_file(spark, sf_dir):
    """A4: '(long: N)' per file."""
    return A.long_count_per_file(A.file_summary(C.code_files(spark, sf_dir)), 20)


@query("long_files", O.long_files_sql(35))
def long_files(spark, sf_dir):
    """Files keeping at least one function >= threshold (35), with their long list."""
    rep = R.long_report(A.file_summary(C.code_files(spark, sf_dir)), 35)
    return rep.select("relative", "total_lines", F.size("long").cast("bigint").alias("n_long"),
                      F.array_join(F.transform("long", lambda f: f["name"]), ",").alias("names"))


@query("long_text", O.long_text_sql(20))
def long_text(spark, sf_dir):
    """D8."""
    return R.long_text(A.file_summary(C.code_files(spark, sf_dir)), 20)


@query("long_json", O.long_json_sql(30))
def long_json(spark, sf_dir):
    """D9."""
    return R.long_json(A.file_summary(C.code_files(spark, sf_dir)), 30)


@query("long_xml", O.long_xml_sql(40))
def long_xml(spark, sf_dir):
    """D10."""
    return R.long_xml(A.file_summary(C.code_files(spark, sf_dir)), 40)


# ---------------------------------------------------------------- P (scalars over documents)

def _docs(spark, sf_dir):
    return C.doc_files(spark, sf_dir)


@query("file_ext", O.doc_scalar_sql("regexp_extract(relative, '[^.]*$', 0)", "ext"))
def file_ext(spark, sf_dir):
    return _docs(spark, sf_dir).select("relative", T.file_ext("relative").alias("ext"))


@query("lang_tag", O.lang_tag_sql())
def lang_tag(spark, sf_dir):
    """P2 over every corpus path."""
    files = C.all_files(spark, sf_dir)
    return files.select("relative", T.lang_tag("relative").alias("lang"))


@query("line_count", O.doc_scalar_sql(O.LINE_COUNT_SPLIT_SQL, "total_lines"))
def line_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("relative", T.line_count("content").alias("total_lines"))


@query("head_lines", O.doc_scalar_sql(O.head_lines_sql(3), "head"))
def head_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("relative", T.head_lines("content", 3).alias("head"))


@query("human_size", O.human_size_sql())
def human_size(spark, sf_dir):
    """P5 over document sizes scaled by 1024^(doc_id % 5) to reach every unit."""
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    b = (F.octet_length("text").cast("bigint") * F.pow(F.lit(1024), F.col("doc_id") % 5).cast("bigint"))
    return docs.select("doc_id", b.alias("bytes"), T.human_size(b).alias("human"))


@query("iso_time", O.doc_scalar_sql(O.iso_time_sql("kmax"), "modified"))
def iso_time(spark, sf_dir):
    return _docs(spark, sf_dir).select("relative", T.iso_time("mtime").alias("modified"))


@query("xml_attr_escape", O.page_scalar_sql(O.xml_attr_sql("url"), "attr"))
def xml_attr_escape(spark, sf_dir):
    pages = C.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.xml_attr_escape("url").alias("attr"))


@query("xml_body", O.page_scalar_sql(O.xml_body_sql("html"), "body"))
def xml_body(spark, sf_dir):
    pages = C.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.xml_body("html").alias("body"))


@query("describe_text", O.describe_text_query_sql())
def describe_text(spark, sf_dir):
    """First ten symbols plus an ellipsis, and the untruncated variant."""
    desc = A.file_summary(C.code_files(spark, sf_dir))
    return desc.select("relative", "text", T.describe_text("symbols", no_truncate=True).alias("full_text"))


@query("byte_truncate", O.doc_scalar_sql(O.byte_truncate_sql("content"), "truncated"))
def byte_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("relative", T.byte_truncate("content").alias("truncated"))


@query("build_prompt", O.doc_scalar_sql(O.prompt_sql("en"), "prompt_md5"))
def build_prompt(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "relative", F.md5(T.build_prompt("relative", "content", "en")).alias("prompt_md5"))


@query("parse_completion", O.parse_completion_sql())
def parse_completion(spark, sf_dir):
    """P13 over completion bodies rendered from events (string, object or null content)."""
    ev = C.read_table(spark, sf_dir, "events")
    body = F.expr(O.COMPLETION_BODY_SQL)
    return ev.select("event_id", body.alias("body")).select(
        "event_id", T.completion_text("body").alias("text"), T.completion_error("body").alias("error"))


# ---------------------------------------------------------------- F (filters)

@query("include_filter", O.path_filter_sql(r"\.(rs|md)$", ""))
def include_filter(spark, sf_dir):
    return Fl.select_paths(C.all_files(spark, sf_dir), r"\.(rs|md)$", "").select("relative")


@query("exclude_filter", O.path_filter_sql(r".", r"chunk1|src1/|\.json$"))
def exclude_filter(spark, sf_dir):
    return Fl.select_paths(C.all_files(spark, sf_dir), r".", r"chunk1|src1/|\.json$").select("relative")


@query("default_filter", O.path_filter_sql(Fl.DEFAULT_INCLUDE_PATTERN, Fl.DEFAULT_EXCLUDE_PATTERN))
def default_filter(spark, sf_dir):
    return Fl.select_paths(C.all_files(spark, sf_dir)).select("relative")


@query("size_guard", O.size_guard_sql(8000))
def size_guard(spark, sf_dir):
    """descriptions of documents with a size cap of 8000 bytes."""
    return A.summary_report(A.file_summary(_docs(spark, sf_dir), A.PatternConfig(max_file_size=8000)))


# ---------------------------------------------------------------- D1-D3, F6 (export)

XML_PROJECT, XML_GENERATED = "corpus", "2024-01-01T00:00:00Z"


@query("dump_status", O.dump_status_sql(8000))
def dump_status(spark, sf_dir):
    """first-match status per document with an 8000-byte limit."""
    s = D.dump_status(_docs(spark, sf_dir), D.DumpOptions(max_size=8000))
    return s.select("relative", "status", F.when(F.col("status") != "content", F.col("reason")).alias("reason"))


@query("dump_plain", O.dump_plain_sql(None, True))
def dump_plain(spark, sf_dir):
    """Plain export with size/mtime headers, whole texts."""
    return D.dump_plain(_docs(spark, sf_dir), D.DumpOptions(detailed=True))


@query("dump_markdown", O.dump_markdown_sql(None, None, True))
def dump_markdown(spark, sf_dir):
    """Markdown export, whole texts, detailed."""
    return D.dump_markdown(_docs(spark, sf_dir), D.DumpOptions(detailed=True))


@query("dump_xml", O.dump_xml_sql(None, XML_PROJECT, XML_GENERATED))
def dump_xml(spark, sf_dir):
    """D3: xml export of the web pages, whole texts."""
    return D.dump_xml(C.page_files(spark, sf_dir), D.DumpOptions(),
                      project_name=XML_PROJECT, generated=XML_GENERATED)


# ---------------------------------------------------------------- A3, W2, W4, D4-D7 (tree)

def _mixed_desc(spark, sf_dir):
    files = C.code_files(spark, sf_dir).unionByName(C.config_files(spark, sf_dir)) \
        .unionByName(C.chat_files(spark, sf_dir))
    return A.file_summary(files)


@query("tree_nodes", O.tree_nodes_sql())
def tree_nodes(spark, sf_dir):
    """A3: distinct directory and file nodes; file nodes carry their description."""
    n = Tr.tree_nodes(_mixed_desc(spark, sf_dir))
    return n.select("node", "parent", "name", "depth", "has_children",
                    F.col("d.total_lines").alias("total_lines"), F.col("d.text").alias("text"))


@query("sibling_order", O.sibling_order_sql())
def sibling_order(spark, sf_dir):
    """Last child of each directory by byte order."""
    return Tr.sibling_order(Tr.materialized_nodes(_mixed_desc(spark, sf_dir))).select("node", "parent", "is_last")


@query("tree_plain", O.tree_plain_sql(None))
def tree_plain(spark, sf_dir):
    """Connectors, ancestor bars, [N lines], (text), (long: N)."""
    return Tr.tree_plain(_mixed_desc(spark, sf_dir))


@query("depth_limit", O.tree_plain_sql(1))
def depth_limit(spark, sf_dir):
    """W4 (plain rule): levels up to max_depth + 1 with max_depth = 1."""
    return Tr.tree_plain(_mixed_desc(spark, sf_dir), max_depth=1)


@query("tree_xml", O.tree_xml_sql(None))
def tree_xml(spark, sf_dir):
    """D6."""
    return Tr.tree_xml(_mixed_desc(spark, sf_dir))


@query("tree_xml_depth", O.tree_xml_sql(2))
def tree_xml_depth(spark, sf_dir):
    """D6 + W4 (xml rule): truncated stubs at level max_depth + 1 = 3."""
    return Tr.tree_xml(_mixed_desc(spark, sf_dir), max_depth=2)


@query("tree_json", O.tree_json_sql(None))
def tree_json(spark, sf_dir):
    """D5."""
    return Tr.tree_json(_mixed_desc(spark, sf_dir))


@query("tree_json_depth", O.tree_json_sql(3))
def tree_json_depth(spark, sf_dir):
    """D5 + W4 (json rule): stubs at JSON depth max_depth + 1."""
    return Tr.tree_json(_mixed_desc(spark, sf_dir), max_depth=3)


# ---------------------------------------------------------------- C1-C5 (incremental state)

V6_COLUMNS = ["path", "mode", "params", "mtime_ms", "text"]


V6_SCHEMA = "path string, mode string, params string, mtime_ms bigint, text string"


def _v6(spark, sf_dir):
    """(results stored while every third version went by unanalysed, the current mtimes over all versions)."""
    ev = C.event_versions(spark, sf_dir)
    stored = S.cache_upsert(spark.createDataFrame([], V6_SCHEMA), ev.filter(F.col("event_id") % 3 != 0), "event_id")
    return stored, ev.groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"))


@query("cache_hits", O.cache_hits_sql())
def cache_hits(spark, sf_dir):
    """Stored 'click' results that are still valid for the current file version."""
    stored, now = _v6(spark, sf_dir)
    return S.cache_hits(stored, now, "click", C.PATTERN_PARAMS).select("path", "mode", "mtime_ms", "text")


@query("cache_misses", O.cache_misses_sql())
def cache_misses(spark, sf_dir):
    """Files that need work for mode 'click' (absent or stale)."""
    stored, now = _v6(spark, sf_dir)
    return S.cache_misses(now, stored, "click", C.PATTERN_PARAMS).select("path", "mtime_ms")


@query("cache_upsert", O.cache_upsert_sql())
def cache_upsert(spark, sf_dir):
    """Results of the first half of the versions, upserted with the second half."""
    ev = C.event_versions(spark, sf_dir)
    half = ev.select((F.count("*") / 2).alias("h")).scalar()
    stored = S.cache_upsert(spark.createDataFrame([], V6_SCHEMA), ev.filter(F.col("event_id") < half), "event_id")
    return S.cache_upsert(stored, ev.filter(F.col("event_id") >= half), "event_id").select(*V6_COLUMNS)


@query("results_store", O.cache_upsert_sql())
def results_store(spark, sf_dir):
    """C3 on buckets: the versions arrive in two upserts of a copy-on-write store; its newest snapshot."""
    from codeloom.operators.results_store import ResultsStore
    from codeloom.session import scratch_path
    ev = C.event_versions(spark, sf_dir)
    half = ev.select((F.count("*") / 2).alias("h")).scalar()
    store = ResultsStore(spark, scratch_path(spark, "results-store"), 16, V6_SCHEMA)
    store.upsert(ev.filter(F.col("event_id") < half), "event_id")
    store.upsert(ev.filter(F.col("event_id") >= half), "event_id")
    return store.read().select(*V6_COLUMNS)


INCR_LANGS = C.CODE_LANGUAGES


@query("incremental_summary", O.incremental_sql(INCR_LANGS, cached=True))
def incremental_summary(spark, sf_dir):
    """C4: a prior run stored results for 2/3 of the files, half of them now stale."""
    files = C.code_files(spark, sf_dir, INCR_LANGS)
    prior_desc = A.file_summary(files.filter(F.length("relative") % 3 != 0))
    cur = S.with_mtime_ms(files).select("path", "mtime_ms", "relative")
    prior = prior_desc.join(cur, ["path", "relative"]).select(
        "path", F.lit("pattern").alias("mode"), F.lit(S.pattern_params("", "")).alias("params"),
        F.when(F.length("relative") % 3 == 1, F.col("mtime_ms")).otherwise(F.col("mtime_ms") - 1000).alias("mtime_ms"),
        "text", "total_lines", "symbols", "functions")
    stored = spark.read.parquet(S.write_results(prior, spark, "prior-results"))
    desc, _ = S.incremental_summary(files, stored)
    return A.summary_report(desc, with_cache_flag=True)


@query("cache_refresh", O.incremental_sql(INCR_LANGS, cached=False))
def cache_refresh(spark, sf_dir):
    """refresh = start from an empty results table (every file recomputed)."""
    desc, _ = S.incremental_summary(C.code_files(spark, sf_dir, INCR_LANGS), S.empty_results(spark))
    return A.summary_report(desc, with_cache_flag=True)


# ---------------------------------------------------------------- X1, X2 (changes)

@query("snapshot_diff", O.snapshot_diff_sql())
def snapshot_diff(spark, sf_dir):
    old, new = C.snapshots(spark, sf_dir)
    return X.snapshot_diff(old, new)


@query("line_changes", O.line_changes_sql())
def line_changes(spark, sf_dir):
    old, new = C.snapshots(spark, sf_dir)
    return X.line_changes(old, new)


# ---------------------------------------------------------------- T1, T2 (streaming)

@query("stream_summary", O.file_summary_sql(O.code_files_cte(), "code_files", with_rust=True))
def stream_summary(spark, sf_dir):
    """The source corpus arrives as one drop per language; descriptions per micro-batch."""
    files = C.code_files(spark, sf_dir).withColumn("drop", T.file_ext("relative"))
    drops = ST.stage_drops(files, "drop", "code-drops")
    schema = spark.read.parquet(drops).schema
    out = ST.stream_summary(spark, drops, schema, files_per_trigger=3)
    return A.summary_report(spark.read.parquet(out).drop("batch_id"))


@query("stream_latest", O.cache_upsert_sql())
def stream_latest(spark, sf_dir):
    """Versions arrive in four drops; the newest version per key survives."""
    ev = C.event_versions(spark, sf_dir).withColumn("drop", (F.col("event_id") % 4).cast("int"))
    drops = ST.stage_drops(ev, "drop", "version-drops")
    schema = spark.read.parquet(drops).schema
    base = ST.stream_latest(spark, drops, schema, ["path", "mode", "params"], "event_id")
    return ST.read_latest(spark, base, ["path", "mode", "params"], "event_id").select(*V6_COLUMNS)


# ---------------------------------------------------------------- U1-U3 (describers, languages)

def _stub_primary(body: str) -> tuple[int, str]:
    """Deterministic stand-in for a model endpoint: fails for half of the prompts."""
    import hashlib
    import json
    prompt = json.loads(body)["messages"][0]["content"]
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if h[0] in "01234567":
        return 500, ""
    return 200, json.dumps({"choices": [{"message": {"content": f"  primary {h[:8]}  "}}]})


def _stub_fallback(body: str) -> tuple[int, str]:
    """Second stand-in: fails or answers with a non-string content for some prompts."""
    import hashlib
    import json
    prompt = json.loads(body)["messages"][0]["content"]
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if h[0] == "0":
        return 503, ""
    if h[1] == "f":
        return 200, json.dumps({"choices": [{"message": {"content": 42}}]})
    return 200, json.dumps({"choices": [{"message": {"content": f"fallback {len(prompt.encode('utf-8'))}"}}]})


@query("describe_llm", O.describe_llm_sql(None))
def describe_llm(spark, sf_dir):
    """Two backends tried in order on every document; first usable answer wins."""
    backends = [U.Backend("primary", "model-a", _stub_primary), U.Backend("fallback", "model-b", _stub_fallback)]
    out = U.describe_llm(_docs(spark, sf_dir), backends, language="en", max_file_size=None)
    return out.select("relative", "text", "error", "backend")


@query("request_body", O.request_body_sql("model-a"))
def request_body(spark, sf_dir):
    """JSON request body per document (md5 of the exact bytes)."""
    prompt = T.build_prompt("relative", "content", "en")
    return _docs(spark, sf_dir).select("relative", F.md5(U.request_body(prompt, "model-a")).alias("body_md5"))


REGISTERED = ("log", "lead", r"(?m)^([A-Za-z]+)")


@query("register_language", O.register_language_sql(*REGISTERED))
def register_language(spark, sf_dir):
    """A language added at run time ('.log' files: the leading word of each line), over all documents."""
    from codeloom.functions.patterns import DEFAULT_REGISTRY
    reg = DEFAULT_REGISTRY.register(REGISTERED[0], [(REGISTERED[1], REGISTERED[2])])
    return A.symbol_rows(A.file_summary(_docs(spark, sf_dir), A.PatternConfig(registry=reg)))


# ---------------------------------------------------------------- S1-S6 (directory source), F4

@query("corpus_scan", O.corpus_scan_sql())
def corpus_scan(spark, sf_dir):
    """The document corpus written out as a directory tree, scanned back."""
    from codeloom.session import scratch_path
    root = scratch_path(spark, "doc-tree")
    FT.export_tree(_docs(spark, sf_dir), root)
    scanned = FT.scan_tree(spark, root)
    return scanned.select("relative", "size", F.md5("content").alias("content_md5"),
                          T.is_binary("content").alias("is_binary"),
                          T.line_count(T.as_text_strict("content")).alias("total_lines"))


ROOT_IGNORE = "src1/\n/src2/en/*.txt\n# comment\n!src1/keep.md\n"


@query("gitignore_filter", O.gitignore_sql())
def gitignore_filter(spark, sf_dir):
    """per-source '.gitignore' files (ignore logs, re-include doc_1*.log where the
    source number is divisible by 3) under a root file ignoring src1/ and /src2/en/*.txt."""
    docs = _docs(spark, sf_dir).select("relative", "content")
    src = docs.select(F.split("relative", "/")[0].alias("src")).distinct()
    per_src = src.select(
        F.concat("src", F.lit("/.gitignore")).alias("relative"),
        F.concat(F.lit("*.log\n"), F.when(F.substring("src", 4, 9).cast("int") % 3 == 0,
                                          F.lit("!doc_1*.log\n")).otherwise(F.lit(""))).alias("content"))
    root = spark.createDataFrame([(".gitignore", ROOT_IGNORE)], "relative string, content string")
    files = docs.unionByName(per_src).unionByName(root)
    return G.gitignore_filter(files).select("relative")


# ---------------------------------------------------------------- W1, E15, N3 (names of the inventory)

@query("sort_files", O.sort_files_sql())
def sort_files(spark, sf_dir):
    """Global byte order of every corpus path, as positions."""
    return A.sort_files(C.all_files(spark, sf_dir))


@query("sym_none", O.sym_none_sql())
def sym_none(spark, sf_dir):
    """Of all documents, extensions without patterns describe as 'no symbols'."""
    return A.summary_report(A.file_summary(_docs(spark, sf_dir))).select("relative", "text", "n_symbols")


@query("long_report", O.long_files_sql(20))
def long_report(spark, sf_dir):
    """Per file with a function of at least 20 lines: total lines and the long list."""
    rep = R.long_report(A.file_summary(C.code_files(spark, sf_dir)), 20)
    return rep.select("relative", "total_lines", F.size("long").cast("bigint").alias("n_long"),
                      F.array_join(F.transform("long", lambda f: f["name"]), ",").alias("names"))


@query("incremental_describe", O.incremental_describe_sql(None))
def incremental_describe(spark, sf_dir):
    """C4 in llm mode: a prior run described the documents with an even path length;
    half of those are still current, the other half stale."""
    backends = [U.Backend("primary", "model-a", _stub_primary), U.Backend("fallback", "model-b", _stub_fallback)]
    docs = _docs(spark, sf_dir)
    _, prior = S.incremental_describe(docs.filter(F.length("relative") % 2 == 0), S.empty_results(spark),
                                      backends, "en", None)
    cur = S.with_mtime_ms(docs).select("path", "relative")
    prior = prior.join(cur, "path").select(
        "path", "mode", "params",
        F.when(F.length("relative") % 4 == 0, F.col("mtime_ms")).otherwise(F.col("mtime_ms") - 1000).alias("mtime_ms"),
        "text", "total_lines", "symbols", "functions")
    stored = spark.read.parquet(S.write_results(prior, spark, "prior-llm-results"))
    desc, _ = S.incremental_describe(docs, stored, backends, "en", None)
    return desc.select("relative", "text", "error", "backend", "from_cache")


# ---------------------------------------------------------------- S3-S5, P3 (chunked files), P9, P14, D7

CHUNK = 997  # odd and small: characters and spliced bytes lie across many chunk edges


def _chunks(spark, sf_dir):
    return CH.chunk_table(C.spliced_files(spark, sf_dir), CHUNK)


def _whole(chunks):
    """Texts of small files put together again, null if any chunk is."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    return chunks.groupBy("relative").agg(F.when(F.bool_and(F.col("text").isNotNull()), text).alias("text"), F.max("error").alias("error"))


@query("read_strict", O.read_strict_sql())
def read_strict(spark, sf_dir):
    """S3: every spliced document decoded strictly, chunk by chunk."""
    return _whole(CH.read_strict(_chunks(spark, sf_dir))).select("relative", F.md5("text").alias("text_md5"), "error")


@query("read_lossy", O.read_lossy_sql())
def read_lossy(spark, sf_dir):
    """Every spliced document decoded with replacement characters, chunk by chunk."""
    return _whole(CH.read_lossy(_chunks(spark, sf_dir))).select(
        "relative", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("is_binary", O.is_binary_sql(T.BINARY_PREFIX))
def is_binary(spark, sf_dir):
    """NULs in the first 1024 bytes and anywhere, validity and lines of spliced documents, from chunk facts."""
    chunks = _chunks(spark, sf_dir)
    early = CH.file_facts(chunks, T.BINARY_PREFIX, CHUNK).select("relative", F.col("is_binary").alias("early_nul"))
    return CH.file_facts(chunks, size=CHUNK).join(early, "relative").select("relative", "size", "is_binary", "early_nul", "valid", "total_lines")


@query("chunk_scan", O.is_binary_sql(T.BINARY_PREFIX))
def chunk_scan(spark, sf_dir):
    """S1 by ranges: the spliced documents written as a tree, scanned as chunks."""
    from codeloom.session import scratch_path
    root = scratch_path(spark, "spliced-tree")
    FT.export_tree(C.spliced_files(spark, sf_dir), root)
    chunks = materialize(CH.scan_chunks(spark, root, size=CHUNK), "spliced-chunks")
    early = CH.file_facts(chunks, T.BINARY_PREFIX, CHUNK).select("relative", F.col("is_binary").alias("early_nul"))
    return CH.file_facts(chunks, size=CHUNK).join(early, "relative").select("relative", "size", "is_binary", "early_nul", "valid", "total_lines")


@query("display_path", O.display_path_sql())
def display_path(spark, sf_dir):
    """The path shown in exports, relative or absolute."""
    files = _docs(spark, sf_dir)
    absolute = D.dump_status(files, D.DumpOptions(absolute_paths=True)).select("relative", F.col("display").alias("absolute_display"))
    return D.dump_status(files).select("relative", "display").join(absolute, "relative")


@query("cache_key", O.cache_key_sql())
def cache_key(spark, sf_dir):
    """Canonical parameters of an analysis of each source and language."""
    docs = C.read_table(spark, sf_dir, "documents").select("source", "lang").distinct()
    include = F.concat("source", F.lit('/.*"\\.(md|txt)$'))
    return docs.select("source", "lang", S.pattern_params_of(include, F.concat(F.lit("tmp|"), "lang")).alias("params"))


@query("empty_tree", O.empty_tree_sql())
def empty_tree(spark, sf_dir):
    """What the tree views print when no file matches, and that they print it only then."""
    files = Fl.select_paths(_docs(spark, sf_dir), r"\.nothing$", "")
    desc = materialize(A.file_summary(files), "no-files")
    views = [("plain", Tr.tree_plain(desc)), ("json", Tr.tree_json(desc)), ("xml", Tr.tree_xml(desc))]
    out = [v.select(F.lit(name).alias("view"), "node", "entry") for name, v in views]
    return out[0].unionByName(out[1]).unionByName(out[2])
