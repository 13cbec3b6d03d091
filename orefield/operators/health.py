"""Platform health: snapshot, latest state, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import health_color, health_score, health_status
from orefield.operators.runs import FAILURE_RATE_LIMIT, QUEUE_LIMIT, SLA_TARGET

# Fixed values
ALERT_BELOW = 70
CRITICAL_BELOW = 50
DEFAULT_SCORE = 100


def one_row(df: DataFrame):
    """A one-row frame as a struct-valued scalar subquery, so several can be put side by side."""
    return df.select(F.struct("*")).scalar()


def health_report(
    as_of: str, tasks: DataFrame, freshness: DataFrame, volumes: DataFrame, dags: DataFrame
) -> DataFrame:
    """Combine the checks (one row each) into a scored snapshot with its issues.

    ``tasks``: runs.task_snapshot(); ``freshness``: stale_sources, avg_staleness_hours;
    ``volumes``: anomalies; ``dags``: runs.dag_counts().
    """
    parts = {"tsk": tasks, "fre": freshness, "vol": volumes, "dag": dags}
    base = tasks.sparkSession.range(1)
    side_by_side = base.select(*[one_row(df).alias(name) for name, df in parts.items()])
    issues = F.array_compact(
        F.array(
            F.when(~F.col("tsk.scheduler_healthy"), F.lit("Scheduler unhealthy")),
            F.when(F.col("tsk.failure_rate") > FAILURE_RATE_LIMIT, F.lit("High failure rate")),
            F.when(F.col("tsk.queued_24h") > QUEUE_LIMIT, F.lit("Task queue buildup")),
            F.when(F.col("fre.stale_sources") > 0, F.lit("Stale sources")),
            F.when(F.col("tsk.sla_misses_24h") > 0, F.lit("SLA misses")),
            F.when(F.col("tsk.sla_compliance") < SLA_TARGET, F.lit("SLA compliance below threshold")),
            F.when(F.col("vol.anomalies") > 0, F.lit("Volume anomalies")),
            F.when(F.col("tsk.queued_tasks") > QUEUE_LIMIT, F.lit("High queue depth")),
        )
    )
    compliance = F.round("tsk.sla_compliance", 2)
    score = health_score(
        F.coalesce("tsk.scheduler_healthy", F.lit(True)),
        F.col("tsk.failed_tasks_24h"),
        compliance,
        F.col("fre.stale_sources"),
        F.col("tsk.queued_tasks"),
    )
    moment = F.lit(as_of).cast("timestamp_ntz")
    alert = (F.col("health_score") < ALERT_BELOW) | (F.size("issue_list") > 0)
    severity = F.when(F.col("health_score") < CRITICAL_BELOW, "CRITICAL").otherwise("HIGH")
    return (
        side_by_side.select(
            F.to_date(moment).alias("metric_date"),
            moment.alias("metric_time"),
            "tsk.scheduler_healthy",
            "tsk.heartbeat_age_seconds",
            F.col("dag.total").alias("total_dags"),
            F.col("dag.active").alias("active_dags"),
            F.col("dag.paused").alias("paused_dags"),
            "tsk.failed_tasks_24h",
            "tsk.successful_tasks_24h",
            "tsk.running_tasks",
            "tsk.queued_tasks",
            compliance.alias("sla_compliance_percent"),
            "tsk.sla_misses_24h",
            F.col("fre.avg_staleness_hours").alias("avg_data_freshness_hours"),
            F.col("fre.stale_sources").alias("stale_sources_count"),
            score.alias("health_score"),
            issues.alias("issue_list"),
        )
        .withColumn("issues", F.array_join("issue_list", "; "))
        .withColumn("alert", alert)
        .withColumn("alert_severity", F.when(F.col("alert"), severity))
        .drop("issue_list")
    )


def newest(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("metric_time")).limit(1)


def health_summary(metrics: DataFrame) -> DataFrame:
    score = F.col("health_score")
    return newest(metrics).select(
        "metric_date", "metric_time", "scheduler_healthy", "total_dags", "active_dags",
        "failed_tasks_24h", "running_tasks", "queued_tasks", "sla_compliance_percent",
        "avg_data_freshness_hours", "health_score", "issues",
        health_status(score).alias("health_status"), health_color(score).alias("health_color"),
    )


def latest_score(metrics: DataFrame) -> DataFrame:
    """The newest row as a record; a score of 100 stands in while no row exists."""
    last = newest(metrics).agg(
        F.max("metric_time").alias("metric_time"),
        F.max("health_score").alias("health_score"),
        F.max("failed_tasks_24h").alias("failed_tasks_24h"),
        F.max("sla_compliance_percent").alias("sla_compliance_percent"),
        F.max("stale_sources_count").alias("stale_sources_count"),
    )
    return last.withColumn("health_score", F.coalesce("health_score", F.lit(DEFAULT_SCORE)))


def _mean(column):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)


def daily_trends(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_date").agg(
        _mean("health_score").alias("avg_health_score"),
        F.min("health_score").alias("min_health_score"),
        F.max("health_score").alias("max_health_score"),
        F.sum("failed_tasks_24h").alias("total_failed_tasks"),
        _mean("sla_compliance_percent").alias("avg_sla_compliance"),
        _mean("avg_data_freshness_hours").alias("avg_data_freshness"),
        F.count("*").alias("check_count"),
    )


def append_metrics(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a check appended to their history; returned as stored by this call's time stamp."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
