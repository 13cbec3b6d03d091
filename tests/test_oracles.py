"""Every registered query against its SQL, on the smallest data; and the driver contract."""

import importlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from check_oracles import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
from orefield.streaming import jobs
from orefield.workload import all_entries

SMALL = "/root/testdata/sf0.001"
# Queries whose result is not a function of the tables alone, or not expressible in SQL.
ROWS_ONLY: set[str] = set()


def check(spark, duck, entry):
    df = entry(spark, SMALL)
    if entry.sql is None:
        return [] if df.count() else ["no rows"]
    return compare(df, duck.cursor(), entry.sql)


@pytest.fixture(scope="module")
def problems(spark):
    """All queries run side by side; Spark shares its threads among their jobs."""
    duck = connect(SMALL)

    def run(entry):
        try:
            return check(spark, duck, entry)
        except Exception as e:  # noqa: BLE001
            return [f"{type(e).__name__}: {str(e)[:500]}"]

    entries = all_entries()
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(entries, pool.map(run, entries.values()), strict=True))


@pytest.mark.parametrize("key", sorted(all_entries()))
def test_query(problems, key):
    assert problems[key] == []


def test_contract(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(all_entries()) - set(sql) == ROWS_ONLY and set(all_entries()) <= set(queries)
    assert contract.entry(spark).count() > 0


BROKEN = {
    "lineage_edges_upsert": ("orefield.operators.lineage", "upsert_edges", lambda old, new: new),
    "sla_tracking": ("orefield.operators.runs", "track_sla", lambda old, new: new),
    "stream_alert_dedup": ("orefield.operators.alerts", "merged_bursts", lambda parts, keys, minutes: parts.select(*keys, "first", "last")),
    "stream_daily_revenue": ("orefield.streaming.jobs", "daily_revenue", lambda parts: REVENUE(parts.where("bucket = 0 AND dayofmonth(day) <> 5"))),
    "daily_summary_late_merge": ("orefield.plans.mergeable", "merged_days", lambda parts: parts),
    "alert_metadata_map": ("orefield.operators.alerts", "shown_subject", lambda: F.col("subject").alias("subject_shown")),
    "dq_singular_tests": ("orefield.workload.quality", "convert_timestamp", lambda df, column: F.col("timestamp")),
    "retention_removed": ("orefield.operators.governance", "drop_expired", lambda *a: 0),
    "scd2_apply": ("orefield.workload.ingest", "apply_snapshot", lambda current, *a: current),
    "incremental_extract_rerun": ("orefield.sources.tables", "incremental_rows", lambda df, *a: df),
    "bi_order_trend": ("orefield.operators.bi", "newest", lambda df, column: df.orderBy(column).limit(30)),
}
REVENUE = jobs.daily_revenue


@pytest.mark.parametrize("key", sorted(BROKEN))
def test_the_sql_finds_a_broken_operator(spark, monkeypatch, key):
    module, name, broken = BROKEN[key]
    monkeypatch.setattr(importlib.import_module(module), name, broken)
    assert check(spark, connect(SMALL), all_entries()[key]) != []
