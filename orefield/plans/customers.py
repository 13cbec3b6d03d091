"""Customer models: cleaning, order join, dimension with tier."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import band, surrogate_key, title_case

MONEY_SUM = "decimal(28,2)"
# Fixed values
TRUE_WORDS = ["yes", "true", "1"]
TIERS = [(1000, "Gold"), (500, "Silver")]
LOWEST_TIER = "Bronze"


def stage_customers(raw: DataFrame, loaded_at: str) -> DataFrame:
    return raw.where(F.col("customer_id").isNotNull()).select(
        F.trim("customer_id").alias("customer_id"),
        title_case(F.trim("full_name")).alias("full_name"),
        F.lower(F.trim("email")).alias("email"),
        F.to_date("created_date").alias("created_date"),
        F.coalesce(F.lower("is_active").isin(TRUE_WORDS), F.lit(False)).alias("is_active"),
        F.lit(loaded_at).cast("timestamp_ntz").alias("_loaded_at"),
    )


def stage_customers_with_email(raw: DataFrame) -> DataFrame:
    """The stricter variant: only rows whose email looks like an address."""
    return raw.where(F.col("email").isNotNull() & F.col("email").like("%@%.%")).select(
        F.trim("customer_id").alias("customer_id"),
        title_case(F.trim("full_name")).alias("full_name"),
        F.lower(F.trim("email")).alias("email"),
    )


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with each of their orders; customers without orders appear once.

    Written as inner join + anti join. In a left join from the small side the many orders of one
    busy customer cannot be split over tasks, in an inner join they can; the anti join sees each
    customer id of the orders only once.
    """
    who = customers.select("customer_id", "full_name")
    placed = orders.select("customer_id", "order_id", "order_date", "total_amount", "status")
    buyers = placed.select("customer_id").distinct()
    return who.join(placed, "customer_id").unionByName(
        who.join(buyers, "customer_id", "left_anti"), allowMissingColumns=True
    )


def order_metrics(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("order_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").cast(MONEY_SUM).alias("lifetime_value"),
            F.max("order_date").alias("last_order_date"),
        )
    )


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders are reduced to one row per customer before the join, so nothing fans out."""
    lifetime = F.coalesce("lifetime_value", F.lit(0).cast(MONEY_SUM))
    return customers.join(order_metrics(orders), "customer_id", "left").select(
        surrogate_key("customer_id").alias("customer_key"),
        "customer_id",
        "full_name",
        "email",
        F.col("created_date").alias("signup_date"),
        "is_active",
        F.coalesce("total_orders", F.lit(0)).cast("bigint").alias("total_orders"),
        lifetime.alias("lifetime_value"),
        "last_order_date",
        band(lifetime, TIERS, LOWEST_TIER).alias("customer_tier"),
    )


def customers_per_tier(dim: DataFrame) -> DataFrame:
    return dim.groupBy("customer_tier").agg(F.count("*").alias("customers"))


def orders_with_customers(orders: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    """Inner equi-join with a date filter; AQE broadcasts the smaller side when it is small."""
    return (
        orders.where(F.col("order_date") >= F.lit(since).cast("date"))
        .join(customers, "customer_id")
        .select("order_id", "order_date", "total_amount", "customer_id", "full_name", "email")
    )
