"""Queries: the incremental shapes run as streams over the given events.

Each starts with fresh checkpoint and output folders below the shared directory, runs until the
input is used up and returns what was written.
"""

from pyspark.sql import functions as F

from orefield.functions.labels import alert_type_of_title
from orefield.operators import alerts
from orefield.operators.quality import suites
from orefield.operators.quality.rules import rule
from orefield.plans import transactions
from orefield.session import new_workspace
from orefield.streaming import jobs
from orefield.workload.alerts import WINDOW_SQL
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW


FILES, FILES_PER_BATCH = 20, 10


def _landed(lake, root):
    """The events dealt by a hash over many files, so that every batch holds all days in no order."""
    lake.table("events").repartition(FILES, "event_id").write.parquet(f"{root}/in")
    return f"{root}/in"


def _events(lake, root):
    """The events as a stream of several batches, with the adapters' k column."""
    schema = lake.table("events").schema
    stream = jobs.file_stream(lake.spark, _landed(lake, root), schema, files_per_trigger=FILES_PER_BATCH)
    return stream.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _staged(lake, root):
    return transactions.stage_transactions(lake.transactions_of(_events(lake, root)), EVENTS_NOW)


def _alerts(lake, root):
    """Alerts of the stream under the batch's column names."""
    found = lake.alerts_of(_events(lake, root))
    return found.withColumns({"alert_type": alert_type_of_title(F.col("title")), "severity": F.lower("severity")})


@query(
    "stream_file_ingest",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def _(lake):
    root = new_workspace(lake.spark, "stream-ingest")
    stream = _events(lake, root).drop("k")
    for _ in range(2):  # the second run finds nothing new
        jobs.run_to_parquet(stream, f"{root}/out", f"{root}/checkpoint")
    return lake.spark.read.parquet(f"{root}/out")


@query("stream_daily_revenue", "SELECT transaction_date, total_transactions, total_amount, unique_customers FROM x_daily")
def _(lake):
    """Open days by batches; days behind the watermark are closed, and late rows correct them."""
    root, spark = new_workspace(lake.spark, "stream-revenue"), lake.spark
    write = jobs.keep_in(lambda s: jobs.revenue_store(s, f"{root}/runs"), jobs.revenue_parts)
    jobs.run_batches(_staged(lake, root), write, f"{root}/checkpoint")
    return jobs.daily_revenue(jobs.revenue_store(spark, f"{root}/runs").read())


@query(
    "stream_alert_dedup",
    """SELECT dag_id, alert_type, id, created_at FROM (SELECT *, lag(created_at) OVER
            (PARTITION BY dag_id, alert_type ORDER BY created_at, id) AS before FROM x_al
            WHERE dag_id NOT IN ('example_hello_world', 'example_monitoring') AND NOT is_retry)
        WHERE before IS NULL OR created_at - before > INTERVAL 15 MINUTE""",
)
def _(lake):
    """The 15-minute rule over all batches: the same alerts go out as from one batch of everything."""
    root, keys = new_workspace(lake.spark, "stream-dedup"), ["dag_id", "alert_type"]
    write = jobs.keep_in(lambda s: jobs.burst_store(s, f"{root}/runs", keys), jobs.dedup_parts(keys))
    jobs.run_batches(_alerts(lake, root), write, f"{root}/checkpoint")
    return jobs.deduplicated_alerts(jobs.burst_store(lake.spark, f"{root}/runs", keys).read(), keys)


@query("stream_alert_summary", WINDOW_SQL)
def _(lake):
    root = new_workspace(lake.spark, "stream-windows")
    write = jobs.keep_in(lambda s: jobs.window_store(s, f"{root}/runs"), alerts.window_counts)
    jobs.run_batches(_alerts(lake, root), write, f"{root}/checkpoint")
    return alerts.summed_windows(jobs.window_store(lake.spark, f"{root}/runs").read(), limit=2)


@query("stream_mart_upsert", "SELECT * FROM x_summary")
def _(lake):
    root = new_workspace(lake.spark, "stream-mart")
    write = jobs.upsert_daily_mart(f"{root}/staged", f"{root}/mart")
    jobs.run_batches(_staged(lake, root), write, f"{root}/checkpoint")
    return lake.spark.read.parquet(f"{root}/mart").select(*lake.daily_summary.columns)


@query(
    "stream_quality_gate",
    """WITH r AS (SELECT *, concat_ws(',', CASE WHEN transaction_id IS NULL THEN 'not_null:transaction_id' END,
            CASE WHEN amount < 0.01 THEN 'between:amount' END,
            CASE WHEN quantity < 1 THEN 'between:quantity' END,
            CASE WHEN currency NOT IN ('USD','EUR','GBP','usd','eur','gbp') THEN 'in_set:currency' END)
            AS broken_rules FROM x_raw)
        SELECT transaction_id, customer_id, amount, quantity, currency, broken_rules = '' AS passed, broken_rules
        FROM r""",
)
def _(lake):
    root = new_workspace(lake.spark, "stream-gate")
    rules = [
        rule("not_null", "transaction_id"),
        rule("between", "amount", min=0.01),
        rule("between", "quantity", min=1),
        rule("in_set", "currency", values=suites.RAW_CURRENCIES),
    ]
    raw = lake.transactions_of(_events(lake, root))
    jobs.run_batches(raw, jobs.quality_gate(rules, f"{root}/out"), f"{root}/checkpoint")
    out = lake.spark.read.parquet(f"{root}/out")
    return out.select(
        "transaction_id", "customer_id", "amount", "quantity", "currency",
        F.col("passed").cast("boolean").alias("passed"),
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )
