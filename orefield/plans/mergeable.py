"""Daily marts from partial rows that merge: sums, and bitmaps for the distinct counts.

A day is one row of sums and, for each counted column, one row for each bucket of 32,768 ids. New rows
of a day, however late, are reduced to the same shape and merged; nothing that was read before is read
again, and the counts stay exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import bitmaps
from orefield.functions.numeric import ratio

SUMS = "sums"


def day_parts(rows: DataFrame, day: Column, sums: dict[str, Column], distinct: list[str]) -> DataFrame:
    """(day, what, bucket, bits, sums): the partial rows of some rows of any days.

    Sums and each set are aggregations of their own with map-side combination: a busy day is a few rows
    from each task, whatever the number of its transactions.
    """
    rows = rows.withColumn("_day", day)
    totals = rows.groupBy(F.col("_day").alias("day")).agg(*[v.alias(k) for k, v in sums.items()])
    totals = totals.select("day", F.lit(SUMS).alias("what"), F.lit(0).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), *sums)
    none = [F.lit(None).cast(totals.schema[k].dataType).alias(k) for k in sums]
    sets = [
        rows.where(F.col(c).isNotNull()).groupBy(F.col("_day").alias("day"), F.lit(c).alias("what"), bitmaps.bucket(F.col(c)).alias("bucket"))
        .agg(bitmaps.constructed(F.col(c)).alias("bits")).select("day", "what", "bucket", "bits", *none)
        for c in distinct
    ]
    return reduce(DataFrame.unionByName, sets, totals)


def merged_days(parts: DataFrame) -> DataFrame:
    """Partial rows of the same day, column and bucket put together."""
    names = [c for c in parts.columns if c not in ("day", "what", "bucket", "bits")]
    bits = F.when(F.col("what") != SUMS, bitmaps.merged(F.col("bits"))).alias("bits")
    # Sums keep the type they had, so that merged rows may be merged again.
    added = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in names]
    return parts.groupBy("day", "what", "bucket").agg(bits, *added).select(*parts.columns)


def distinct_of(column: str) -> Column:
    """Aggregate over a day's partial rows: how many values of ``column`` it has."""
    size = F.when(F.col("what") == column, bitmaps.count(F.coalesce("bits", F.lit(b""))))
    return F.coalesce(F.sum(size), F.lit(0)).cast("bigint")


def summary_parts(rows: DataFrame) -> DataFrame:
    """Partial rows of staged transactions for ``daily_summary``."""
    revenue = (F.col("amount") * F.col("quantity")).cast("decimal(18,2)")
    sums = {
        "n": F.count("*"), "priced": F.count("amount"),
        "amount": F.sum("amount").cast("decimal(28,2)"), "revenue": F.sum(revenue).cast("decimal(28,2)"),
    }
    return day_parts(rows, F.to_date("transaction_timestamp"), sums, ["customer_id", "product_id"])


def daily_summary(parts: DataFrame) -> DataFrame:
    """The daily summary from merged or unmerged partial rows."""
    merged = merged_days(parts)
    return merged.groupBy(F.col("day").alias("date")).agg(
        F.sum("n").alias("total_transactions"),
        F.sum("revenue").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("amount").cast("decimal(28,2)").alias("total_amount"),
        ratio(F.sum("amount"), F.sum("priced")).alias("avg_transaction_value"),
        distinct_of("customer_id").alias("unique_customers"),
        distinct_of("product_id").alias("unique_products"),
    )
