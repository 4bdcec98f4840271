"""Plan assertions on registered queries (sf0.001): JVM-only hot paths, no
nested-loop or cartesian joins, one content shuffle for the flagship."""

import pytest

import __spark_entry__ as E
from codeloom.plans.inspect import plan_facts
from tests.conftest import SF001

JVM_ONLY = ["dump_xml", "tree_plain", "line_changes", "cache_upsert", "gitignore_filter", "long_json"]
# Python cleans the text of Rust files, and nothing else
RUST = ["file_summary", "symbols_all", "function_spans"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_query_plans(spark, name):
    facts = plan_facts(E.queries()[name](spark, SF001))
    assert not facts["python"], name
    assert not facts["nested_loop"], name


@pytest.mark.parametrize("name", RUST)
def test_python_only_cleans_rust_text(spark, name):
    df = E.queries()[name](spark, SF001)
    facts = plan_facts(df)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    passes = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert passes and all(any(f in line for f in ("_cleaner", "_maps", "_compose")) for line in passes)
    assert not any(k in plan for k in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython"))
    assert not facts["nested_loop"], name


def test_flagship_reads_only_its_columns(spark):
    facts = plan_facts(E.queries()["file_summary"](spark, SF001))
    # column pruning: the unused part columns are never read
    assert facts["scans"] and all("p_retailprice" not in sc and "p_type" not in sc for sc in facts["scans"])


def test_building_a_query_runs_nothing(spark):
    """But for tables that are written once on purpose, building starts only the one-task jobs that read a parquet footer."""
    tracker = spark.sparkContext.statusTracker()
    for name in ("file_summary", "symbols_all", "function_spans", "dump_xml", "line_count", "sym_py", "long_text"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        E.queries()[name](spark, SF001)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"build-{name}")]
        assert all(len(j.stageIds) == 1 and tracker.getStageInfo(j.stageIds[0]).numTasks == 1 for j in jobs), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
