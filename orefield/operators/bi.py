"""Dashboard queries: metrics by group, with time grain, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import ratio

GRAINS = {"P1D": "day", "PT1H": "hour", "P1W": "week", "P1M": "month"}


def mean(column: str, decimals: int = 2) -> Column:
    """Mean over an exact sum (see functions.numeric.average)."""
    return F.sum(F.col(column).cast(f"decimal(28,{decimals})")).cast("double") / F.count(column)




def metric_sets() -> dict[str, dict[str, Column]]:
    """Built on demand, since Column objects need a running session."""
    money = "decimal(38,2)"
    return {
        "customer": {
            "total_customers": F.count_distinct("customer_id"),
            "sum_total_spend": F.sum("total_spent").cast(money),
            "avg_customer_spend": mean("total_spent"),
            "avg_order_value": F.round(F.avg("avg_transaction_value"), 6),
        },
        "product": {
            "total_products": F.count_distinct("product_id"),
            "sum_revenue": F.sum("total_revenue").cast(money),
            "sum_units_sold": F.sum("total_units_sold"),
            "avg_revenue_per_product": mean("total_revenue"),
        },
        "daily": {
            "sum_daily_revenue": F.sum("total_revenue").cast(money),
            "sum_transactions": F.sum("total_transactions"),
            "avg_daily_revenue": mean("total_revenue"),
            "avg_daily_transactions": mean("total_transactions", 0),
        },
    }


def bi_query(
    df: DataFrame,
    metrics: dict[str, Column],
    groupby: list[str] = (),
    time_col: str | None = None,
    grain: str | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Aggregate ``metrics`` by the group columns and the time bucket.

    With order and limit Spark plans TakeOrderedAndProject: each task keeps ``limit`` rows.
    """
    groups = [F.col(c) for c in groupby]
    if time_col:
        bucket = F.date_trunc(GRAINS[grain], F.col(time_col)) if grain else F.col(time_col)
        if grain == "P1D":
            bucket = F.to_date(time_col)
        groups.append(bucket.alias(time_col))
    out = df.groupBy(*groups).agg(*[v.alias(k) for k, v in metrics.items()])
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def top(df: DataFrame, columns: list[str], by: str, tiebreak: str, n: int) -> DataFrame:
    return df.select(*columns).orderBy(F.desc(by), tiebreak).limit(n)


def newest(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The last ``n`` time buckets of a trend, in order of time."""
    return df.orderBy(F.desc(column)).limit(n).orderBy(column)


def share_of_total(df: DataFrame, group: str, value: str, out: str = "share") -> DataFrame:
    """Sum per group and its share of the total, which a window takes over the one row of each group."""
    sums = df.groupBy(group).agg(F.sum(value).cast("decimal(38,2)").alias(value))
    total = F.sum(value).over(Window.partitionBy()).cast("decimal(38,2)")
    return sums.withColumn(out, ratio(F.col(value), total))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts per equal-width bin between the minimum and maximum; the maximum is in the last bin.

    Rows are counted per value first (days, amounts of a list: few), so one pass gives bounds and bins.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    every, x = Window.partitionBy(), F.col(column).cast("double")
    values = values.withColumns({"low": F.min(x).over(every), "high": F.max(x).over(every)})
    width = F.col("high") - F.col("low")
    position = F.floor((x - F.col("low")) * bins / F.nullif(width, F.lit(0.0)))
    number = F.when(width > 0, F.least(position, F.lit(bins - 1))).otherwise(0).cast("int")
    return values.groupBy(number.alias("bin")).agg(F.sum("n").alias("customers"))


def with_previous(daily: DataFrame, day: str, value: str, rows: int = 1) -> DataFrame:
    """A daily KPI with the value ``rows`` days of data before; one row per calendar day."""
    before = F.lag(value, rows).over(Window.orderBy(day))
    return daily.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


def last_month(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """The dashboards' default range, half open; the bounds are literals and reach the scan."""
    end = F.to_date(F.lit(as_of))
    return df.where((F.col(column) >= F.add_months(end, -1)) & (F.col(column) < end))


def last_days(df: DataFrame, column: str, as_of: str, days: int = 30) -> DataFrame:
    return df.where(F.col(column) >= F.date_sub(F.to_date(F.lit(as_of)), days))
