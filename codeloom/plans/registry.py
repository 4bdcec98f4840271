"""Named queries over the test tables and their DuckDB oracles.

Each query is ``(spark, sf_dir) -> DataFrame`` with scalar columns only; the
oracle with the same key returns the same columns from DuckDB.  Queries run
over whole tables: nothing is sampled, capped or filtered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from codeloom.plans import queries  # noqa: F401
