"""Registered queries against their DuckDB oracles at sf0.001 (a subset; check_oracles.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracles import rows_of
from codeloom.sources.tables import TABLES
from tests.conftest import SF001

SUBSET = ["file_summary", "sym_cs", "function_spans", "human_size", "dump_markdown", "tree_json",
          "cache_upsert", "line_changes", "gitignore_filter", "describe_llm"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)
