"""Sales and order models: staging, daily and regional marts, calendar snippets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import average, ratio

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"


def light_clean_sales(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.trim("transaction_id").alias("transaction_id"),
        "customer_id",
        "product_name",
        "quantity",
        "unit_price",
        F.to_date("sale_date").alias("sale_date"),
        "region",
        (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("total_amount"),
    )


def stage_sales(raw: DataFrame, loaded_at: str) -> DataFrame:
    return raw.where(
        F.col("transaction_id").isNotNull() & (F.col("quantity") > 0) & (F.col("unit_price") > 0)
    ).select(
        "transaction_id",
        "customer_id",
        F.trim("product_name").alias("product_name"),
        "quantity",
        "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("total_amount"),
        F.to_date("sale_date").alias("sale_date"),
        F.upper(F.trim("region")).alias("region"),
        F.lit(loaded_at).cast("timestamp_ntz").alias("_loaded_at"),
    )


def regional_daily(sales: DataFrame) -> DataFrame:
    return sales.groupBy("region", "sale_date").agg(
        F.count("*").alias("transaction_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum("total_amount").cast(MONEY_SUM).alias("revenue"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def regional_sales(sales: DataFrame) -> DataFrame:
    """The window runs over the daily rollup: a region holds one row per calendar day."""
    days = Window.partitionBy("region").orderBy("sale_date")
    return regional_daily(sales).select(
        "region",
        "sale_date",
        "transaction_count",
        "units_sold",
        "revenue",
        "unique_customers",
        ratio(F.col("revenue"), F.col("transaction_count")).alias("avg_transaction_value"),
        F.sum("revenue").over(days).cast(MONEY_SUM).alias("cumulative_revenue"),
        (F.col("revenue") - F.lag("revenue").over(days)).cast(MONEY_SUM).alias("revenue_change"),
    )


def stage_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        F.to_date("order_date").alias("order_date"),
        F.col("total_amount").cast(MONEY).alias("total_amount"),
        F.lower(F.trim("status")).alias("status"),
    )


def daily_sales(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("status") == "completed")
        .groupBy(F.col("order_date").alias("order_day"))
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            F.sum("total_amount").cast(MONEY_SUM).alias("revenue"),
            average("total_amount").alias("avg_order_value"),
        )
    )


def daily_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_amount").cast(MONEY_SUM).alias("total_amount"),
    )


def orders_per_day(orders: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("order_date").cast("timestamp_ntz"))
    return (
        orders.groupBy(day.cast("timestamp_ntz").alias("day"))
        .agg(F.count("*").alias("orders"))
        .orderBy("day")
    )


def top_revenue_days(orders: DataFrame, n: int = 10) -> DataFrame:
    return (
        orders.groupBy(F.col("order_date").alias("day"))
        .agg(
            F.count("*").alias("orders"), F.sum("total_amount").cast(MONEY_SUM).alias("revenue")
        )
        .orderBy(F.desc("revenue"), "day")
        .limit(n)
    )


def running_total(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Running sum over a daily mart.

    The unpartitioned window is one task by nature; its input is one row per calendar day
    whatever the volume of the fact table.
    """
    return daily.select(
        day,
        value,
        F.sum(value).over(Window.orderBy(day)).cast(MONEY_SUM).alias("running_total"),
    )


def row_offset_comparison(daily: DataFrame, day: str, value: str, rows: int = 365) -> DataFrame:
    """Value ``rows`` rows earlier in the daily mart (not the calendar: gaps shift it)."""
    return daily.select(
        day, value, F.lag(value, rows).over(Window.orderBy(day)).alias("revenue_last_year")
    )


def calendar_year_comparison(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Same date one year earlier. 29 February has no such date and stays null."""
    earlier = daily.select(F.col(day).alias("earlier"), F.col(value).alias("revenue_last_year"))
    year_before = F.add_months(F.col(day), -12)
    same_day = F.dayofmonth(year_before) == F.dayofmonth(day)
    return (
        daily.select(day, value, F.when(same_day, year_before).alias("earlier"))
        .join(earlier, "earlier", "left")
        .drop("earlier")
    )


def calendar_parts(daily: DataFrame, day: str, days_back: int = 30) -> DataFrame:
    return daily.select(
        day,
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        F.date_sub(day, days_back).alias("days_before"),
    )
