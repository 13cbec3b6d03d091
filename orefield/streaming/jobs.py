"""Streaming jobs. Each runs with ``availableNow`` and ends once its input is used up; on a
cluster the same functions take a processing-time trigger.

Checkpoints and outputs go to paths the caller chooses, so that a restarted job continues where
the last one stopped.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orefield.operators import alerts
from orefield.operators.alerts import DEDUP_MINUTES, WINDOW_MINUTES
from orefield.operators.quality.rules import Rule
from orefield.operators.quality.validation import mark_rows
from orefield.plans import mergeable
from orefield.plans.incremental import write_date_partitions
from orefield.streaming.runs import Closing, RunStore

FILES_PER_TRIGGER = 1000


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
    kind: str = "parquet", files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """New files of a folder, each exactly once; the schema is fixed, never inferred."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(kind)
        .load(folder)
    )


def run_to_parquet(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
        .awaitTermination()
    )


def run_batches(stream: DataFrame, each, checkpoint: str, mode: str = "append") -> None:
    (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def revenue_parts(batch: DataFrame) -> DataFrame:
    """Per day: count, sum and customers of some rows, and the time of the latest."""
    sums = {"n": F.count("*"), "amount": F.sum("amount").cast("decimal(28,2)")}
    return mergeable.day_parts(batch, F.to_date("transaction_timestamp"), sums, ["customer_id"])


def revenue_closing(delay: timedelta) -> Closing:
    """A day is final once the watermark has left it. The latest event of a row is taken as its day's begin."""
    day_end = F.date_add("day", 1).cast("timestamp_ntz")
    return Closing(F.col("day").cast("timestamp_ntz"), delay, lambda mark: day_end <= mark, lambda mark: day_end <= mark)


def revenue_store(spark: SparkSession, root: str, delay: timedelta = timedelta(days=2), **how) -> RunStore:
    return RunStore(spark, root, mergeable.merged_days, closing=revenue_closing(delay), **how)


def daily_revenue(parts: DataFrame) -> DataFrame:
    """Revenue per day from ``revenue_parts`` of any batches; without a day there is no watermark to wait for."""
    return mergeable.merged_days(parts).groupBy(F.col("day").alias("transaction_date")).agg(
        F.sum("n").alias("total_transactions"),
        F.sum("amount").cast("decimal(28,2)").alias("total_amount"),
        mergeable.distinct_of("customer_id").alias("unique_customers"),
    )


def keep_in(store_of, reduce):
    """Batch writer that keeps ``reduce(batch)`` in the run store that ``store_of(spark)`` opens."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = store_of(batch.sparkSession)
        store.add(batch_id, reduce(batch))
        store.expire()

    return write


def dedup_parts(keys: list[str], minutes: int = DEDUP_MINUTES):
    """Reducer to what the ``minutes`` rule needs: the bursts within each slice, as (keys, first, last)."""
    return lambda batch: alerts.alert_slices(alerts.may_go_out(batch), keys, minutes).drop("slice")


def burst_closing(minutes: int = DEDUP_MINUTES, delay: timedelta = timedelta(hours=1)) -> Closing:
    """A burst is final once no timely alert can be near enough to lengthen it: state is what is active."""
    gap = F.make_dt_interval(mins=F.lit(minutes))
    return Closing(F.col("last"), delay, lambda mark: F.col("first.created_at") < mark, lambda mark: F.col("last") + gap < mark)


def burst_store(spark: SparkSession, root: str, keys: list[str], minutes: int = DEDUP_MINUTES, delay: timedelta = timedelta(hours=1), **how) -> RunStore:
    merge = lambda parts: alerts.merged_bursts(parts, keys, minutes)
    return RunStore(spark, root, merge, closing=burst_closing(minutes, delay), **how)


def deduplicated_alerts(bursts: DataFrame, keys: list[str]) -> DataFrame:
    """The alerts that go out by the batch rule: the first of each merged burst."""
    return bursts.select(*keys, F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"))


def window_store(spark: SparkSession, root: str, minutes: int = WINDOW_MINUTES, delay: timedelta = timedelta(hours=1), **how) -> RunStore:
    """Alert counts per window; a window is final once the watermark has passed its end."""
    start = F.col("window_start").cast("timestamp_ntz")
    passed = lambda mark: start + F.make_dt_interval(mins=F.lit(minutes)) <= mark
    merge = lambda parts: parts.groupBy("window_start", "severity", "alert_type").agg(F.sum("n").alias("n"))
    return RunStore(spark, root, merge, closing=Closing(start, delay, passed, passed), **how)


def mart_store(spark: SparkSession, root: str, **how) -> RunStore:
    return RunStore(spark, root, mergeable.merged_days, **how)


def upsert_daily_mart(root: str, target: str, **how):
    """Batch writer that keeps each batch's partial rows and rewrites the mart's touched days.

    A day is rebuilt from merged partial rows (sums and bitmaps), never from its transactions: distinct
    counts stay exact, a batch meets a bounded number of earlier runs, a replayed batch leaves the same mart.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = mart_store(batch.sparkSession, root, **how)
        parts = mergeable.summary_parts(batch)
        manifest = store.add(batch_id, parts)
        # Days of the batch are found among its few partial rows.
        own = store.own(batch_id)
        touched = (parts if own is None else own).select("day").distinct()
        write_date_partitions(mergeable.daily_summary(store.read(manifest=manifest).join(touched, "day", "left_semi")), target)
        store.expire()

    return write


def quality_gate(rules: list[Rule], target: str):
    """Batch writer that parts passing rows (passed=true) from quarantined ones in one write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = mark_rows(batch, rules).withColumns(
            {
                "passed": F.size("broken_rules") == 0,
                "batch_id": F.lit(batch_id).cast("bigint"),
            }
        )
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "passed", "batch_id"
        ).parquet(target)

    return write
