"""Run ledger and schema history: append-only tables and the queries over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefield.operators.latest import first_per_key

# A run's states in the order they may follow each other.
RUN_STATES = ["running", "success", "failed"]
#: Characters of an error that a display shows; the ledger keeps the whole text.
ERROR_SHOWN = 500


def run_started(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", "source_name", F.lit("running").alias("status"), _null("bigint", "row_count"),
        _null("string", "error_message"), F.col("started_at").alias("updated_at"),
    )


def run_finished(runs: DataFrame, ok, row_count, error, at) -> DataFrame:
    return runs.select(
        "run_id", "source_name", F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(ok, row_count).cast("bigint").alias("row_count"),
        F.when(~ok, error).alias("error_message"), at.alias("updated_at"),
    )


def append_state(
    spark: SparkSession, path: str, run_id, source: str, status: str, row_count=None, error=None
) -> None:
    """One event of a run, stamped with the current time, appended to the ledger."""
    row = spark.createDataFrame(
        [(str(run_id), source, status, row_count, error)],
        "run_id string, source_name string, status string, row_count bigint, error_message string",
    )
    now = F.current_timestamp().cast("timestamp_ntz")
    row.withColumn("updated_at", now).write.mode("append").parquet(path)


def logged(spark: SparkSession, path: str, run_id, source: str, action: Callable):
    """Run ``action`` between its 'running' and 'success' or 'failed' events.

    The result's row_count (attribute or key) goes into the ledger; a failure is noted and raised.
    """
    append_state(spark, path, run_id, source, "running")
    try:
        result = action()
    except Exception as e:
        append_state(spark, path, run_id, source, "failed", error=str(e))
        raise
    rows = result["row_count"] if isinstance(result, dict) else getattr(result, "row_count", None)
    append_state(spark, path, run_id, source, "success", rows)
    return result


def shown_error(length: int = ERROR_SHOWN):
    return F.substring("error_message", 1, length).alias("error_message")


def _null(dtype, name):
    return F.lit(None).cast(dtype).alias(name)


def current_runs(events: DataFrame) -> DataFrame:
    """State of each run: its newest event, where a final state beats 'running' at equal times."""
    final = F.col("status") != "running"
    return first_per_key(events, ["run_id"], [F.desc("updated_at"), final.desc(), F.desc("status")])


def last_successful_runs(ledger: DataFrame) -> DataFrame:
    """Newest successful run of every source in one pass."""
    newest = F.max_by(
        F.struct("id", "execution_date", "row_count", "created_at"), F.struct("created_at", "id")
    )
    return (
        ledger.where(F.col("status") == "success")
        .groupBy("source_name")
        .agg(newest.alias("run"))
        .select("source_name", "run.*")
    )


def stage_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        F.col("id").alias("ingestion_id"), "source_name", "source_type", "execution_date",
        "row_count", "file_size_bytes", "checksum", "status", "error_message", "created_at",
        "updated_at",
    )


def recent_successes(ledger: DataFrame, n: int = 20) -> DataFrame:
    return (
        ledger.where(F.col("status") == "success")
        .select("id", "source_name", "execution_date", "row_count", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(n)
    )


def failed_runs(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(F.col("status") == "failed")
        .select("id", "source_name", "execution_date", "error_message", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def daily_ingestion(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("execution_date").agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("row_count").alias("total_rows"),
    )


def recent_runs(ledger: DataFrame, n: int = 20) -> DataFrame:
    return (
        ledger.select("id", "source_name", "status", "execution_date", "updated_at")
        .orderBy(F.desc("updated_at"), F.desc("id"))
        .limit(n)
    )


def column_counts(history: DataFrame) -> DataFrame:
    columns = F.json_array_length(F.get_json_object("schema_metadata", "$.columns"))
    return history.withColumn("column_count", columns)


def schema_drift(history: DataFrame) -> DataFrame:
    """Column count per source and execution date, and whether it moved since the date before.

    Detections of one day are folded to the newest first, so the window holds at most one row per
    source and calendar day.
    """
    newest = F.max_by("column_count", F.struct("created_at", "id"))
    daily = (
        column_counts(history)
        .groupBy("source_name", "execution_date")
        .agg(newest.alias("column_count"), F.count("*").alias("detections"))
    )
    before = F.lag("column_count").over(Window.partitionBy("source_name").orderBy("execution_date"))
    return daily.withColumn("previous_count", before).withColumn(
        "drifted", F.coalesce(F.col("column_count") != F.col("previous_count"), F.lit(False))
    )


def schema_history_of(history: DataFrame, source: str) -> DataFrame:
    return (
        history.where(F.col("source_name") == source)
        .select("id", "source_name", "schema_metadata", "execution_date", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )
