"""Every registered query against its independent DuckDB SQL at sf0.01."""

import pytest

import __spark_entry__ as E
from revlens.plans.catalog import QUERIES
from tests.compare import compare_one
from tests.conftest import SF001

NAMES = sorted(QUERIES)  # the subpackage llm tests its own queries


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    r = compare_one(spark, duck, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert r["cols"], r["detail"]
    assert r["rows"], (r["n_spark"], r["n_duck"])
    assert r["values"], r["detail"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:3] == ["store", "total", "avg_rating"]


SCALE_SAMPLE = ["store_comparison", "rating_distribution", "category_metrics", "top_words", "new_reviews",
                "snapshot_new", "weekly_by_store", "flagged_reviews", "triage_list", "capture_rate",
                "snapshot_trends", "cumulative_rating", "dedup_reviews", "notable_critical_by_store"]


@pytest.mark.parametrize("name", SCALE_SAMPLE)
def test_same_results_with_the_plan_used_at_scale(spark, duck, name):
    """No automatic broadcast (every data join becomes a sort-merge join, as at 100 TB)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        r = compare_one(spark, duck, name, lambda s, d: df, E.oracle_sql()[name], SF001)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert r["values"], r["detail"]
    if name in {"store_comparison", "rating_distribution", "new_reviews", "snapshot_new", "capture_rate"}:
        # the data joins (label lookup, anti join) are shuffle joins here
        assert "SortMergeJoin" in plan, plan
