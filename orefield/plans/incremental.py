"""Incremental refresh of a date-partitioned mart (delete + insert by date)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.sources.layers import path_exists


def high_water_date(spark: SparkSession, path: str, key: str = "date") -> date | None:
    """Largest date of the target, or None where it is missing or empty.

    ``key`` is the partition column, so the scan reads no data columns.
    """
    if not path_exists(spark, path):
        return None
    row = spark.read.parquet(path).agg(F.max(key).alias("d")).first()
    return row["d"] if row else None


def refresh_by_date(
    spark: SparkSession,
    path: str,
    build: Callable[[date | None], DataFrame],
    key: str = "date",
    lookback_days: int = 0,
    full_refresh: bool = False,
) -> date | None:
    """Rewrite whole ``key`` partitions from the target's last date onwards.

    ``build(since)`` must return every row of each date >= since; it gets the literal date so
    that it can push the bound into its own scan. None means a full load. Running it twice
    leaves the same table: partitions are replaced, never appended to.

    Rows that arrive late for a date before the bound stay out until a full refresh;
    ``lookback_days`` widens the bound.
    """
    since = None if full_refresh else high_water_date(spark, path, key)
    if since is not None and lookback_days:
        since = since - timedelta(days=lookback_days)
    rows = build(since)
    if since is not None:
        rows = rows.where(F.col(key) >= F.lit(since))
    write_date_partitions(rows, path, key, replace_all=full_refresh)
    return since


def write_date_partitions(
    rows: DataFrame, path: str, key: str = "date", replace_all: bool = False
) -> None:
    mode = "static" if replace_all else "dynamic"
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(key)
        .parquet(path)
    )
