"""Queries: projections, joins, aggregations, marts, windows, top-k."""

from pyspark.sql import functions as F

from orefield.functions import convert_timestamp, surrogate_key
from orefield.operators import bi, skew
from orefield.plans import customers, incremental, mergeable, sales, transactions, users
from orefield.session import new_workspace
from orefield.streaming.runs import RunStore
from orefield.workload.oracle_tables import mean, rounded_mean
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW

ALL = "SELECT * FROM "


@query("stg_transactions", ALL + "x_stg")
def _(lake):
    return lake.stg


@query("int_transactions_enriched", ALL + "x_enr")
def _(lake):
    return lake.enriched


@query("int_daily_transactions", ALL + "x_daily")
def _(lake):
    return lake.daily


@query("mart_customer_analytics", ALL + "x_cust")
def _(lake):
    return lake.customer_mart


@query("mart_product_analytics", ALL + "x_prod")
def _(lake):
    return lake.product_mart


@query("mart_daily_summary", ALL + "x_summary")
def _(lake):
    return lake.daily_summary


@query("daily_summary_incremental", ALL + "x_summary")
def _(lake):
    """First load up to the middle of a day, then an incremental run over the grown source."""
    path = new_workspace(lake.spark, "daily-summary")
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")

    def build(raw):
        def rows(since):
            staged = transactions.stage_transactions(raw, EVENTS_NOW)
            if since is not None:
                staged = staged.where(F.col("transaction_timestamp") >= F.lit(since).cast("timestamp_ntz"))
            return transactions.daily_summary(transactions.daily_transactions(staged))

        return rows

    early = lake.raw_transactions.where(F.col("timestamp") < cut)
    incremental.refresh_by_date(lake.spark, path, build(early))
    incremental.refresh_by_date(lake.spark, path, build(lake.raw_transactions))
    return lake.spark.read.parquet(path).select(*lake.daily_summary.columns)


@query("daily_summary_late_merge", ALL + "x_summary")
def _(lake):
    """All days but for rows that come late, then those alone, merged into the days' sums and bitmaps."""
    spark, root = lake.spark, new_workspace(lake.spark, "daily-merge")
    staged = transactions.stage_transactions(lake.raw_transactions, EVENTS_NOW)
    store = RunStore(spark, root, mergeable.merged_days)
    late = F.coalesce(F.col("transaction_id") % 7 == 0, F.lit(False))
    for number, rows in enumerate((staged.where(~late), staged.where(late))):
        store.add(number, mergeable.summary_parts(rows))
    return mergeable.daily_summary(store.read()).select(*lake.daily_summary.columns)


@query(
    "convert_timestamp",
    f"""SELECT event_id, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT))
            AS from_epoch_int,
        date_trunc('second', ts) AS from_epoch_text, ts AS from_iso_z, ts AS from_iso_space,
        ts AS from_timestamp, true AS all_agree FROM events""",
)
def _(lake):
    ts = F.col("ts")
    seconds = F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("bigint")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    forms = lake.events.select(
        "event_id",
        seconds.alias("from_epoch_int"),
        F.concat(F.lit(" "), seconds.cast("string")).alias("from_epoch_text"),
        F.concat(iso, F.lit("Z")).alias("from_iso_z"),
        F.replace(iso, F.lit("T"), F.lit(" ")).alias("from_iso_space"),
        ts.alias("from_timestamp"),
    )
    names = forms.columns[1:]
    out = forms.select("event_id", *[convert_timestamp(forms, c).alias(c) for c in names])
    whole = F.date_trunc("second", "from_timestamp").cast("timestamp_ntz")
    agree = (
        F.col("from_epoch_int").eqNullSafe(whole)
        & F.col("from_epoch_text").eqNullSafe(whole)
        & F.col("from_iso_z").eqNullSafe(F.col("from_timestamp"))
        & F.col("from_iso_space").eqNullSafe(F.col("from_timestamp"))
    )
    return out.withColumn("all_agree", agree)


@query(
    "surrogate_key",
    """SELECT event_id, md5(coalesce(CAST(event_id AS VARCHAR), '_null_') || '|' || event_type || '|'
        || coalesce(CAST(CASE WHEN user_id % 10 <> 0 THEN user_id END AS VARCHAR), '_null_'))
        AS surrogate_key FROM events""",
)
def _(lake):
    rows = lake.events.withColumn("buyer", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return rows.select(
        "event_id", surrogate_key("event_id", "event_type", "buyer").alias("surrogate_key")
    )


@query("stg_customers", ALL + "x_customers")
def _(lake):
    return lake.stg_customers


@query(
    "stg_customers_email",
    """SELECT trim(customer_id) AS customer_id, nice_name AS full_name, lower(trim(email)) AS email
        FROM x_crm_named WHERE email LIKE '%@%.%'""",
)
def _(lake):
    return customers.stage_customers_with_email(lake.crm_customers)


@query("stg_sales", ALL + "x_sales")
def _(lake):
    return lake.stg_sales


@query(
    "sales_light_clean",
    """SELECT trim(transaction_id) AS transaction_id, customer_id, product_name, quantity, unit_price,
        sale_date, region, CAST(quantity * unit_price AS DECIMAL(18,2)) AS total_amount FROM x_rawsales""",
)
def _(lake):
    return sales.light_clean_sales(lake.raw_sales)


@query("clean_to_silver", ALL + "x_silver")
def _(lake):
    return users.clean_to_silver(lake.raw_users, ["created_at", "amount", "name"])


@query(
    "silver_cleaning_report",
    """SELECT (SELECT COUNT(*) FROM x_users) AS rows_before, (SELECT COUNT(*) FROM x_silver) AS rows_after,
        (SELECT COUNT(*) FROM x_users) - (SELECT COUNT(*) FROM x_silver) AS rows_removed""",
)
def _(lake):
    return users.cleaning_report(lake.raw_users)


@query(
    "gold_user_summary",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS created_date, COUNT(id) AS user_count,
        CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
        {rounded_mean("amount")} AS avg_amount FROM x_silver GROUP BY 1""",
)
def _(lake):
    silver = users.clean_to_silver(lake.raw_users, ["created_at", "amount", "name"])
    return users.user_summary(silver)


@query(
    "score_grades",
    """WITH s AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(p_size * 2 AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS m
        FROM part)
        SELECT p_partkey AS id, p_name AS name, p_size * 2 AS score, p_size * 2 > m AS above_average,
        CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' ELSE 'C' END AS grade,
        n AS score_count, m AS avg_score FROM part, s""",
)
def _(lake):
    return users.grade_scores(lake.scores)


@query(
    "calendar_parts",
    """SELECT "date", CAST(quarter("date") AS INTEGER) AS quarter, CAST(year("date") AS INTEGER) AS year,
        "date" - 30 AS days_before FROM x_summary""",
)
def _(lake):
    return sales.calendar_parts(lake.daily_summary, "date")


@query(
    "high_spend_customers",
    """SELECT customer_id, total_transactions, total_spent, avg_transaction_value FROM x_cust
        WHERE total_spent > 500 ORDER BY total_spent DESC, customer_id LIMIT 100""",
)
def _(lake):
    rows = lake.customer_mart.where(F.col("total_spent") > 500)
    columns = ["customer_id", "total_transactions", "total_spent", "avg_transaction_value"]
    return bi.top(rows, columns, "total_spent", "customer_id", 100)


@query(
    "custom_query_join",
    """SELECT order_id, order_date, total_amount, o.customer_id, full_name, email
        FROM x_orders o JOIN x_customers c ON o.customer_id = c.customer_id
        WHERE order_date >= DATE '1998-01-01'""",
)
def _(lake):
    return customers.orders_with_customers(lake.stg_orders, lake.stg_customers, "1998-01-01")


@query(
    "int_customer_orders",
    """SELECT c.customer_id, full_name, order_id, order_date, total_amount, status
        FROM x_customers c LEFT JOIN x_orders o ON c.customer_id = o.customer_id""",
)
def _(lake):
    return customers.customer_orders(lake.stg_customers, lake.stg_orders)


@query("dim_customers", ALL + "x_dim")
def _(lake):
    return customers.dim_customers(lake.stg_customers, lake.stg_orders)


@query("tier_counts", "SELECT customer_tier, COUNT(*) AS customers FROM x_dim GROUP BY 1")
def _(lake):
    return customers.customers_per_tier(customers.dim_customers(lake.stg_customers, lake.stg_orders))


@query(
    "mart_daily_sales",
    f"""SELECT order_date AS order_day, COUNT(DISTINCT order_id) AS total_orders,
        COUNT(DISTINCT customer_id) AS unique_customers,
        CAST(SUM(total_amount) AS DECIMAL(28,2)) AS revenue, {mean("total_amount")} AS avg_order_value
        FROM x_orders WHERE status = 'completed' GROUP BY 1""",
)
def _(lake):
    return sales.daily_sales(lake.stg_orders)


@query(
    "gold_daily_orders",
    """SELECT order_date, COUNT(order_id) AS order_count,
        CAST(SUM(total_amount) AS DECIMAL(28,2)) AS total_amount FROM x_orders GROUP BY 1""",
)
def _(lake):
    return sales.daily_orders(lake.stg_orders)


@query(
    "orders_per_day",
    "SELECT CAST(order_date AS TIMESTAMP) AS day, COUNT(*) AS orders FROM x_orders GROUP BY 1 ORDER BY 1",
)
def _(lake):
    return sales.orders_per_day(lake.stg_orders)


@query(
    "top_revenue_days",
    """SELECT order_date AS day, COUNT(*) AS orders, CAST(SUM(total_amount) AS DECIMAL(28,2)) AS revenue
        FROM x_orders GROUP BY 1 ORDER BY revenue DESC, day LIMIT 10""",
)
def _(lake):
    return sales.top_revenue_days(lake.stg_orders)


@query(
    "top_customers",
    """SELECT customer_id, customer_name, total_transactions, total_spent FROM x_cust_named
        ORDER BY total_spent DESC, customer_id LIMIT 10""",
)
def _(lake):
    columns = ["customer_id", "customer_name", "total_transactions", "total_spent"]
    return bi.top(lake.named_customers, columns, "total_spent", "customer_id", 10)


@query(
    "category_performance",
    """SELECT category, COUNT(*) AS product_count, CAST(SUM(total_units_sold) AS BIGINT) AS units_sold,
        CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS revenue FROM x_prod_named GROUP BY 1
        ORDER BY revenue DESC""",
)
def _(lake):
    metrics = {
        "product_count": F.count("*"),
        "units_sold": F.sum("total_units_sold"),
        "revenue": F.sum("total_revenue").cast("decimal(38,2)"),
    }
    return bi.bi_query(lake.named_products, metrics, ["category"], order=[F.desc("revenue")])


@query(
    "regional_daily_sales",
    """SELECT region, sale_date, COUNT(*) AS transaction_count, CAST(SUM(quantity) AS BIGINT) AS units_sold,
        CAST(SUM(total_amount) AS DECIMAL(28,2)) AS revenue, COUNT(DISTINCT customer_id) AS unique_customers
        FROM x_sales GROUP BY 1, 2""",
)
def _(lake):
    return sales.regional_daily(lake.stg_sales)


@query(
    "mart_regional_sales",
    """WITH d AS (SELECT region, sale_date, COUNT(*) AS transaction_count,
            CAST(SUM(quantity) AS BIGINT) AS units_sold, CAST(SUM(total_amount) AS DECIMAL(28,2)) AS revenue,
            COUNT(DISTINCT customer_id) AS unique_customers FROM x_sales GROUP BY 1, 2)
        SELECT *, CAST(revenue AS DOUBLE) / NULLIF(transaction_count, 0) AS avg_transaction_value,
        CAST(SUM(revenue) OVER (PARTITION BY region ORDER BY sale_date) AS DECIMAL(28,2))
            AS cumulative_revenue,
        CAST(revenue - LAG(revenue) OVER (PARTITION BY region ORDER BY sale_date) AS DECIMAL(28,2))
            AS revenue_change FROM d""",
)
def _(lake):
    return sales.regional_sales(lake.stg_sales)


@query(
    "heavy_customer_join",
    """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 7 <> 1 THEN o_custkey END AS c_custkey, o_totalprice FROM orders)
        SELECT c_mktsegment, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue,
        CAST(SUM(CASE WHEN c_custkey = 1 THEN 1 ELSE 0 END) AS BIGINT) AS heavy FROM o LEFT JOIN customer USING (c_custkey) GROUP BY 1""",
)
def _(lake):
    """Orders of which a third belong to one customer and some to none, with their customers."""
    customer = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 7 != 1, F.col("o_custkey"))
    orders = lake.orders.select("o_orderkey", customer.alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    placed = skew.heavy_join(orders, lake.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "left", spread=["o_orderkey"])
    return placed.groupBy("c_mktsegment").agg(
        F.count("*").alias("orders"), F.sum("price").cast("decimal(28,2)").alias("revenue"), F.count_if(F.col("c_custkey") == 1).alias("heavy")
    )


@query(
    "running_total",
    """SELECT "date", total_revenue, CAST(SUM(total_revenue) OVER (ORDER BY "date") AS DECIMAL(28,2))
        AS running_total FROM x_summary""",
)
def _(lake):
    return sales.running_total(lake.daily_summary, "date", "total_revenue")


DAILY_SALES = """SELECT order_date AS order_day, CAST(SUM(total_amount) AS DECIMAL(28,2)) AS revenue
    FROM x_orders WHERE status = 'completed' GROUP BY 1"""


@query(
    "yoy_lag",
    f"""WITH d AS ({DAILY_SALES}) SELECT order_day, revenue,
        LAG(revenue, 365) OVER (ORDER BY order_day) AS revenue_last_year FROM d""",
)
def _(lake):
    return sales.row_offset_comparison(sales.daily_sales(lake.stg_orders), "order_day", "revenue")


@query(
    "yoy_calendar",
    f"""WITH d AS ({DAILY_SALES}) SELECT a.order_day, a.revenue, b.revenue AS revenue_last_year
        FROM d a LEFT JOIN d b ON b.order_day = CAST(a.order_day - INTERVAL 1 YEAR AS DATE)
        AND NOT (month(a.order_day) = 2 AND day(a.order_day) = 29)""",
)
def _(lake):
    return sales.calendar_year_comparison(sales.daily_sales(lake.stg_orders), "order_day", "revenue")


@query(
    "layer_row_counts",
    """SELECT 'raw' AS layer, 'transactions' AS table_name, COUNT(*) AS row_count FROM x_raw
        UNION ALL SELECT 'staging', 'stg_transactions', COUNT(*) FROM x_stg
        UNION ALL SELECT 'marts', 'mart_customer_analytics', COUNT(*) FROM x_cust
        UNION ALL SELECT 'marts', 'mart_product_analytics', COUNT(*) FROM x_prod
        UNION ALL SELECT 'marts', 'mart_daily_summary', COUNT(*) FROM x_summary""",
)
def _(lake):
    root = new_workspace(lake.spark, "counts")
    frames = {
        ("raw", "transactions"): lake.raw_transactions,
        ("staging", "stg_transactions"): lake.stg,
        ("marts", "mart_customer_analytics"): lake.customer_mart,
        ("marts", "mart_product_analytics"): lake.product_mart,
        ("marts", "mart_daily_summary"): lake.daily_summary,
    }
    out = None
    for (layer, table), df in frames.items():
        if layer != "raw":  # counted as stored: the footers hold the counts
            df.write.parquet(f"{root}/{layer}/{table}")
            df = lake.spark.read.schema(df.schema).parquet(f"{root}/{layer}/{table}")
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    return out


