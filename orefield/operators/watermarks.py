"""High-water marks per (source, column) on an append-only ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators.latest import first_per_key, upsert

KEYS = ["source_name", "watermark_column"]
SCHEMA = (
    "source_name string, watermark_column string, watermark_value string, "
    "watermark_type string, updated_at timestamp_ntz"
)
COLUMNS = ["source_name", "watermark_column", "watermark_value", "watermark_type", "updated_at"]


def current_watermarks(ledger: DataFrame) -> DataFrame:
    """Newest mark per key; a mark whose newest value is null was reset and is left out."""
    newest = first_per_key(ledger, KEYS, [F.desc("updated_at"), F.desc("watermark_value")])
    return newest.where(F.col("watermark_value").isNotNull())


def lookup(ledger: DataFrame, source: str, column: str) -> str | None:
    row = (
        current_watermarks(
            ledger.where((F.col("source_name") == source) & (F.col("watermark_column") == column))
        )
        .select("watermark_value")
        .first()
    )
    return row["watermark_value"] if row else None


def upsert_watermarks(current: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(current.select(*COLUMNS), changes.select(*COLUMNS), KEYS, ["updated_at"])


def watermark_row(spark: SparkSession, source, column, value, kind, at) -> DataFrame:
    return spark.createDataFrame([(source, column, value, kind, at)], SCHEMA)


def reset_row(spark: SparkSession, source, column, at, to: str | None = None, kind="timestamp") -> DataFrame:
    """Appended to the ledger it moves the mark back to ``to``, or deletes it (None)."""
    return watermark_row(spark, source, column, to, kind, at)


def stage_watermarks(marks: DataFrame) -> DataFrame:
    return marks.select(*COLUMNS)


def newest_watermarks(marks: DataFrame) -> DataFrame:
    return marks.select(*COLUMNS).orderBy(F.desc("updated_at"), "source_name", "watermark_column")
