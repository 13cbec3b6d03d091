"""Bronze transactions -> staging -> enriched / daily -> marts.

The models are lazy, so a mart's plan reaches back to the bronze scan: only the columns it
needs are read and the staging filters are pushed into the file scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import average, convert_timestamp, to_integer

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"
HIGH_VALUE_ABOVE = 100


def stage_transactions(raw: DataFrame, loaded_at: str) -> DataFrame:
    # The filters name the raw columns, so that they reach the scan.
    kept = raw.where(F.col("transaction_id").isNotNull() & (F.col("amount") > 0) & (F.col("quantity") > 0))
    return kept.select(
        "transaction_id",
        "customer_id",
        "product_id",
        F.col("amount").cast(MONEY).alias("amount"),
        F.upper(F.trim("currency")).alias("currency"),
        to_integer(kept, "quantity").alias("quantity"),
        convert_timestamp(kept, "timestamp").alias("transaction_timestamp"),
        F.lit(loaded_at).cast("timestamp_ntz").alias("_loaded_at"),
    )


def _line_value() -> Column:
    return (F.col("amount") * F.col("quantity")).cast(MONEY)


def enrich_transactions(staged: DataFrame) -> DataFrame:
    hour = F.hour("transaction_timestamp")
    return staged.select(
        "transaction_id",
        "customer_id",
        "product_id",
        "amount",
        "currency",
        "quantity",
        "transaction_timestamp",
        _line_value().alias("total_value"),
        hour.alias("transaction_hour"),
        (F.dayofweek("transaction_timestamp") - 1).alias("transaction_day_of_week"),
        F.coalesce(F.col("amount") > HIGH_VALUE_ABOVE, F.lit(False)).alias("is_high_value"),
        F.when(hour.between(9, 17), "business_hours").otherwise("off_hours").alias("time_category"),
        "_loaded_at",
    )


def daily_transactions(staged: DataFrame) -> DataFrame:
    return staged.groupBy(F.to_date("transaction_timestamp").alias("transaction_date")).agg(
        F.count("*").alias("total_transactions"),
        F.sum("amount").cast(MONEY_SUM).alias("total_amount"),
        average("amount").alias("avg_amount"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("product_id").alias("unique_products"),
        F.sum(_line_value()).cast(MONEY_SUM).alias("total_revenue"),
    )


def customer_analytics(enriched: DataFrame) -> DataFrame:
    first, last = F.min("transaction_timestamp"), F.max("transaction_timestamp")
    return enriched.groupBy("customer_id").agg(
        F.count("*").alias("total_transactions"),
        F.sum("total_value").cast(MONEY_SUM).alias("total_spent"),
        average("amount").alias("avg_transaction_value"),
        first.alias("first_transaction_date"),
        last.alias("last_transaction_date"),
        F.extract(F.lit("DAY"), last - first).cast("int").alias("customer_lifetime_days"),
        F.countDistinct("product_id").alias("unique_products_purchased"),
        F.count_if("is_high_value").alias("high_value_transaction_count"),
        F.sum("quantity").alias("total_units_purchased"),
    )


def product_analytics(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("product_id").agg(
        F.count("*").alias("total_transactions"),
        F.sum("quantity").alias("total_units_sold"),
        F.sum("total_value").cast(MONEY_SUM).alias("total_revenue"),
        F.countDistinct("customer_id").alias("unique_customers"),
        average("amount").alias("avg_price_per_unit"),
        F.min("transaction_timestamp").alias("first_sale_date"),
        F.max("transaction_timestamp").alias("last_sale_date"),
        F.count_if("is_high_value").alias("high_value_transaction_count"),
    )


def daily_summary(daily: DataFrame) -> DataFrame:
    return daily.select(
        F.col("transaction_date").alias("date"),
        "total_transactions",
        "total_revenue",
        "total_amount",
        F.col("avg_amount").alias("avg_transaction_value"),
        "unique_customers",
        "unique_products",
    )
