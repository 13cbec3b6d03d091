"""Row-volume anomalies."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import percent, rounded_average


def _successes_since(ledger: DataFrame, as_of: str, days: int) -> DataFrame:
    """ISO dates sort as text, so the bound is a text literal that the scan can use; the cast comes after."""
    first = (date.fromisoformat(as_of[:10]) - timedelta(days=days)).isoformat()
    rows = ledger.where((F.col("status") == "success") & (F.col("execution_date") >= F.lit(first)))
    return rows.where(F.col("execution_date").try_cast("date").isNotNull())


def _mean(column):
    return F.sum(column).cast("double") / F.count(column)


def volume_sweep(ledger: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Volumes per source; a zero, or a low below half the mean, is an anomaly."""
    low, mean = F.col("min_rows"), F.col("avg_rows")
    return (
        _successes_since(ledger, as_of, days)
        .groupBy("source_name")
        .agg(
            F.sum("row_count").alias("total_rows_7d"),
            rounded_average("row_count", decimals=0).alias("avg_rows"),
            F.max("row_count").alias("max_rows"),
            F.min("row_count").alias("min_rows"),
            F.count("*").alias("ingestion_count"),
        )
        .withColumn("is_anomaly", (low == 0) | ((mean > 0) & (low < mean * 0.5)))
    )


def volume_anomaly(
    current: DataFrame, ledger: DataFrame, as_of: str, limit_percent: float = 50, days: int = 7
) -> DataFrame:
    """Current row count per source against its recent mean; no history is not an anomaly."""
    history = (
        _successes_since(ledger, as_of, days)
        .groupBy("source_name")
        .agg(
            _mean("row_count").alias("mean"),
            rounded_average("row_count", decimals=0).alias("historical_avg"),
            F.round(F.stddev("row_count"), 2).alias("historical_stddev"),
            F.min("row_count").alias("historical_min"),
            F.max("row_count").alias("historical_max"),
            F.count("*").alias("sample_count"),
        )
    )
    deviation = F.when(
        F.col("mean") > 0,
        percent(F.abs(F.col("current_count") - F.col("mean")), F.col("mean"), digits=None),
    )
    vanished = (F.col("current_count") == 0) & (F.col("mean") > 0)
    return current.join(history, "source_name", "left").select(
        "source_name",
        "current_count",
        "historical_avg",
        "historical_stddev",
        "historical_min",
        "historical_max",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.round(deviation, 2).alias("deviation_percent"),
        F.coalesce((deviation > limit_percent) | vanished, F.lit(False)).alias("is_anomaly"),
    )
