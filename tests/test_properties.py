"""Property tests: Spark expressions against small Python models of the reference's semantics."""

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions import text as T

UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def py_human(b: int) -> str:
    # division by a power of two is exact; Python's '.1f' rounds the exact binary value, ties to even
    if b == 0:
        return "0 B"
    i = min((b.bit_length() - 1) // 10, 5)
    return f"{b / 1024 ** i:.1f} {UNITS[i]}"


def py_lines(s: str) -> list[str]:
    # line ends are '\n' or '\r\n'; a final line end is optional; a lone '\r' does not split
    if s == "":
        return []
    parts = s.split("\n")
    if s.endswith("\n"):
        parts = parts[:-1]
    return [p[:-1] if p.endswith("\r") and (i < len(parts) - 1 or s.endswith("\n")) else p
            for i, p in enumerate(parts)]


def py_head(s: str, n: int) -> str:
    lines = py_lines(s)
    out = "\n".join(lines[:n])
    return out + "\n[...truncated...]" if len(lines) > n else out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1 << 53), st.sampled_from([1023, 1024, 1280, 1331, 1587, 10485759])),
                min_size=50, max_size=200))
def test_human_size_matches_model(spark, sizes):
    df = spark.createDataFrame([(x,) for x in sizes], "n long")
    got = [r.v for r in df.select(T.human_size("n").alias("v")).collect()]
    assert got == [py_human(x) for x in sizes]


texts = st.text(alphabet=st.sampled_from(["a", "é", " ", "\n", "\r", "x"]), max_size=30)


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=20, max_size=60), st.integers(0, 4))
def test_lines_match_model(spark, samples, n):
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select(T.line_count("t").alias("c"), T.head_lines("t", n).alias("h")).collect()
    assert [r.c for r in rows] == [len(py_lines(s)) for s in samples]
    assert [r.h for r in rows] == [py_head(s, n) for s in samples]
