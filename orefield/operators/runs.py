"""Task and run statistics: failures, SLA, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import percent, seconds_between
from orefield.operators.latest import first_per_key

# Fixed values
FAILURE_RATE_LIMIT = 10
QUEUE_LIMIT = 100
SLA_TARGET = 95
WHOLE_DAG = "__dag__"
HEARTBEAT_LIMIT_SECONDS = 300


def since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))


def started_within(tasks: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return tasks.where(F.col("start_date") >= since(as_of, hours))


def _in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def state_counts(tasks: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return started_within(tasks, as_of, hours).agg(
        _in_state("failed").alias("failed"),
        _in_state("success").alias("success"),
        _in_state("running").alias("running"),
        _in_state("queued").alias("queued"),
        F.count("*").alias("total"),
    )


def failures_by_dag(tasks: DataFrame, as_of: str, hours: int = 24, n: int = 10) -> DataFrame:
    """Failure count and rate per dag from one grouped pass, worst first."""
    return (
        started_within(tasks, as_of, hours)
        .groupBy("dag_id")
        .agg(
            _in_state("failed").alias("failure_count"),
            percent(_in_state("failed"), F.count("*")).alias("failure_rate"),
        )
        .where(F.col("failure_count") > 0)
        .orderBy(F.desc("failure_count"), "dag_id")
        .limit(n)
    )


def failure_rate(tasks: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    counts = state_counts(tasks, as_of, hours)
    rate = percent(F.col("failed"), F.col("total"), digits=None, empty=0)
    return counts.select(
        F.col("failed").alias("failed_tasks_24h"),
        F.col("success").alias("successful_tasks_24h"),
        F.col("running").alias("running_tasks"),
        F.col("queued").alias("queued_tasks"),
        F.col("total").alias("total_tasks_24h"),
        F.round(rate, 2).alias("failure_rate_percent"),
        (rate > FAILURE_RATE_LIMIT).alias("failure_issue"),
        (F.col("queued") > QUEUE_LIMIT).alias("queue_issue"),
    )


def task_snapshot(tasks: DataFrame, misses: DataFrame, as_of: str) -> DataFrame:
    """failure_rate, sla_platform, queue_snapshot and heartbeat for one moment, in a single scan."""
    now = F.lit(as_of).cast("timestamp_ntz")
    state, start = F.col("state"), F.col("start_date")
    day, hour = start >= since(as_of, 24), start >= since(as_of, 1)
    queued_or_running = state.isin("queued", "running", "scheduled")

    def count(condition, name):
        return F.count_if(condition).alias(name)

    age = F.timestamp_diff("SECOND", F.max(F.when(start <= now, start)), now)
    counted = tasks.agg(
        count(day, "total_tasks_24h"),
        count(day & (state == "failed"), "failed_tasks_24h"),
        count(day & (state == "success"), "successful_tasks_24h"),
        count(day & (state == "queued"), "queued_24h"),
        count((hour | queued_or_running) & (state == "queued"), "queued_tasks"),
        count((hour | queued_or_running) & (state == "running"), "running_tasks"),
        age.alias("heartbeat_age_seconds"),
    )
    recent = misses.where(F.col("timestamp") >= since(as_of, 24))
    total = F.col("total_tasks_24h")
    return counted.withColumns(
        {
            "scheduler_healthy": F.col("heartbeat_age_seconds") <= HEARTBEAT_LIMIT_SECONDS,
            "failure_rate": percent(F.col("failed_tasks_24h"), total, digits=None, empty=0),
            "sla_compliance": percent(F.col("successful_tasks_24h"), total, digits=None, empty=100),
            "sla_misses_24h": recent.agg(F.count("*")).scalar(),
        }
    )


def recent_failures(tasks: DataFrame, n: int = 10) -> DataFrame:
    return (
        tasks.where(F.col("state") == "failed")
        .select("run_id", "dag_id", "task_id", "execution_date", "end_date")
        .orderBy(F.desc("end_date"), F.desc("run_id"))
        .limit(n)
    )


def queue_snapshot(tasks: DataFrame, as_of: str) -> DataFrame:
    """Started in the last hour, or in an active state whenever started."""
    active = F.col("state").isin("queued", "running", "scheduled")
    return tasks.where((F.col("start_date") >= since(as_of, 1)) | active).agg(
        _in_state("queued").alias("queued"),
        _in_state("running").alias("running"),
        _in_state("scheduled").alias("scheduled"),
    )


def dag_counts(dags: DataFrame) -> DataFrame:
    return dags.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_active") & ~F.col("is_paused")).alias("active"),
        F.count_if("is_paused").alias("paused"),
    )


def dag_runs_as_tasks(dag_runs: DataFrame) -> DataFrame:
    """Runs of whole DAGs in the shape of task runs, under the key that stands for the whole DAG."""
    return dag_runs.withColumn("task_id", F.lit(WHOLE_DAG))


def checked_runs(
    tasks: DataFrame, as_of: str, expected_minutes: float = 60, hours: int = 24, last_runs: int | None = None
) -> DataFrame:
    """The finished runs of each (dag, task) in the window with their SLA outcome.

    All of them count; ``last_runs`` is for a view of the newest few.
    """
    rows = started_within(tasks, as_of, hours).where(F.col("state").isin("success", "failed"))
    if last_runs is not None:
        rows = first_per_key(rows, ["dag_id", "task_id"], [F.desc("execution_date"), F.desc("run_id")], last_runs)
    seconds = seconds_between("end_date", "start_date")
    expected = F.lit(float(expected_minutes))
    met = F.col("duration_minutes") <= expected
    return (
        rows.withColumn("duration_minutes", seconds / F.lit(60.0))
        .where(F.col("duration_minutes").isNotNull())
        .withColumn("sla_met", met)
        .withColumn(
            "delay_seconds",
            F.when(met, 0).otherwise(((F.col("duration_minutes") - expected) * 60).cast("int")),
        )
    )


def sla_check(
    tasks: DataFrame, as_of: str, expected_minutes: float = 60, hours: int = 24, last_runs: int | None = None
) -> DataFrame:
    met, total = F.count_if("sla_met"), F.count("*")
    return (
        checked_runs(tasks, as_of, expected_minutes, hours, last_runs)
        .groupBy("dag_id", "task_id")
        .agg(
            total.alias("runs_checked"),
            met.alias("sla_met"),
            (total - met).alias("sla_missed"),
            percent(met, total, empty=100).alias("compliance_percent"),
        )
    )


def sla_rows(tasks: DataFrame, as_of: str, expected_minutes: float = 60, hours: int = 24) -> DataFrame:
    """Rows for the tracking table, one per (dag, task, execution day): the last run of the day, of all runs."""
    expected = F.make_dt_interval(mins=F.lit(int(expected_minutes)))
    rows = checked_runs(tasks, as_of, expected_minutes, hours).select(
        "dag_id",
        "task_id",
        F.to_date("execution_date").alias("execution_date"),
        (F.col("start_date") + expected).alias("expected_completion"),
        F.col("end_date").alias("actual_completion"),
        "sla_met",
        "delay_seconds",
        "run_id",
    )
    order = [F.desc("actual_completion"), F.desc("run_id")]
    return first_per_key(rows, ["dag_id", "task_id", "execution_date"], order).drop("run_id")


TRACKING_KEYS = ["dag_id", "task_id", "execution_date"]


def track_sla(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The tracking table after ``changes``: a known key takes the new outcome and keeps its expected completion."""
    kept = current.select(*TRACKING_KEYS, F.col("expected_completion").alias("_expected"))
    new = changes.join(kept, TRACKING_KEYS, "left").withColumn("expected_completion", F.coalesce("_expected", "expected_completion"))
    rest = current.join(changes.select(*TRACKING_KEYS), TRACKING_KEYS, "left_anti")
    return rest.unionByName(new.select(current.columns))


def sla_time_used(tasks: DataFrame, as_of: str, expected_minutes: float) -> DataFrame:
    """(dag, task, percent of the SLA that has passed) of the running tasks."""
    age = seconds_between(F.lit(as_of).cast("timestamp_ntz"), "start_date") / F.lit(60.0)
    return tasks.where(F.col("state") == "running").select(
        "run_id", "dag_id", "task_id", percent(age, F.lit(float(expected_minutes))).alias("percent_used")
    )


def sla_platform(tasks: DataFrame, misses: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Share of completed tasks as a compliance estimate, and the number of recent misses."""
    done = percent(_in_state("success"), F.count("*"), digits=None, empty=100)
    shown = misses.where(F.col("timestamp") >= since(as_of, hours)).agg(F.count("*"))
    return (
        started_within(tasks, as_of, hours)
        .agg(done.alias("exact"))
        .select(
            F.round("exact", 2).alias("sla_compliance_percent"),
            (F.col("exact") < SLA_TARGET).alias("compliance_issue"),
        )
        .withColumn("sla_misses_24h", shown.scalar())
    )
