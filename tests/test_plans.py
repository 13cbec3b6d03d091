"""The physical plans: what is pushed down, how joins and limits run."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from orefield.operators import governance, volume
from orefield.operators.latest import first_per_key
from orefield.plans import transactions
from orefield.sources import tables
from orefield.workload import all_entries
from orefield.workload.tables import EVENTS_NOW

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bronze(spark, lake):
    from orefield.session import new_workspace

    path = new_workspace(spark, "bronze")
    lake.raw_transactions.write.parquet(path)
    return spark.read.parquet(path)


def test_staging_filters_and_columns_reach_the_scan(bronze):
    staged = transactions.stage_transactions(bronze, EVENTS_NOW)
    plan = plan_of(transactions.product_analytics(transactions.enrich_transactions(staged)))
    assert "IsNotNull(transaction_id)" in plan
    assert "GreaterThan(amount,0.0)" in plan and "GreaterThan(quantity,0)" in plan
    assert "currency" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_high_water_mark_is_pushed_without_casting_the_column(bronze):
    plan = plan_of(tables.incremental_rows(bronze, "timestamp", "2024-01-20 00:00:00"))
    assert "GreaterThan(timestamp,2024-01-20T00:00)" in plan


def test_first_per_key_limits_before_the_shuffle(lake):
    plan = plan_of(first_per_key(lake.lineitem, ["l_orderkey"], [F.asc("l_linenumber")]))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_either_end_match_is_an_equi_join(lake):
    df = governance.active_ownership(lake.owners, lake.access_requests, lake.edges)
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_daily_folders_are_pruned(spark, lake, folder):
    tables.write_daily_partitions(lake.stg, "transaction_timestamp", folder)
    df = spark.read.parquet(folder).where("year = 2024 AND month = 1 AND day = 5")
    assert "PartitionFilters: [isnotnull(year" in plan_of(df)
    read = {r[0].rsplit("/", 2)[1] for r in df.select(F.input_file_name()).distinct().collect()}
    assert read == {"day=5"}
    assert df.select("day").distinct().count() == 1


@pytest.fixture(scope="module")
def plans(spark):
    keys = sorted(all_entries())  # those that write, too: the plan of what they read back
    with ThreadPoolExecutor(4) as pool:
        found = pool.map(lambda k: plan_of(all_entries()[k](spark, SMALL)), keys)
        return dict(zip(keys, found, strict=True))


@pytest.mark.parametrize(
    "word", ["EvalPython", "PythonUDF", "CartesianProduct", "NestedLoopJoin", "MapInPandas"]
)
def test_no_python_rows_and_no_cross_joins(plans, word):
    assert [k for k, plan in plans.items() if word in plan] == []


def unpartitioned(plan):
    """Window lines read: Window [functions], [partition keys], [order], the keys being optional."""
    lines = [x for x in plan.split("\n") if re.search(r"\bWindow \[", x)]
    tails = [re.search(r"\](, \[[^\[\]]*\])+$", x) for x in lines]
    # A window without any key ends after its functions.
    return any(t is None or t[0].count(", [") < 2 for t in tails)


DAILY = {"running_total", "yoy_lag", "bi_health_score_delta"}


def scans(plan):
    return len(re.findall(r"FileScan parquet", plan))


def test_models_are_built_once(plans):
    for key in ("bi_category_share", "bi_lifetime_hist", "dq_suite_mart_daily", "sla_check", "stream_daily_revenue"):
        assert scans(plans[key]) <= 2, key
    assert scans(plans["bi_lifetime_hist"]) == 1


def test_volume_bounds_reach_the_scan(spark, lake, folder):
    lake.ingestion.write.parquet(folder)
    plan = plan_of(volume.volume_sweep(spark.read.parquet(folder), "2001-08-02 00:00:00"))
    assert "GreaterThanOrEqual(execution_date,2001-07-26)" in plan


def test_unpartitioned_windows_see_daily_rows_only(plans):
    """The only queries whose window has no partition key: over one row per day, category or lifetime."""
    alone = {k for k, p in plans.items() if unpartitioned(p)}
    assert alone == DAILY | {"bi_category_share", "bi_lifetime_hist"}


def test_regional_join_does_not_broadcast_growing_tables(spark):
    plan = plan_of(all_entries()["mart_regional_sales"](spark, SMALL))
    assert "SortMergeJoin" in plan
