"""Queries: the dashboards' charts."""

from pyspark.sql import functions as F

from orefield.functions import average, layer_of_suite
from orefield.operators import alerts, bi, freshness
from orefield.workload.oracle_tables import EVENTS_NOW as SQL_NOW
from orefield.workload.oracle_tables import hours, layer_case, mean
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW

WIDE = "DECIMAL(28,2)"


@query(
    "bi_metrics_customer",
    f"""SELECT COUNT(DISTINCT customer_id) AS total_customers,
        CAST(SUM(total_spent) AS DECIMAL(38,2)) AS sum_total_spend,
        {mean("total_spent", WIDE)} AS avg_customer_spend,
        round(AVG(avg_transaction_value), 6) AS avg_order_value FROM x_cust""",
)
def _(lake):
    return bi.bi_query(lake.customer_mart, bi.metric_sets()["customer"])


@query(
    "bi_metrics_product",
    f"""SELECT COUNT(DISTINCT product_id) AS total_products,
        CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS sum_revenue,
        CAST(SUM(total_units_sold) AS BIGINT) AS sum_units_sold,
        {mean("total_revenue", WIDE)} AS avg_revenue_per_product FROM x_prod""",
)
def _(lake):
    return bi.bi_query(lake.product_mart, bi.metric_sets()["product"])


@query(
    "bi_metrics_daily",
    f"""SELECT CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS sum_daily_revenue,
        CAST(SUM(total_transactions) AS BIGINT) AS sum_transactions,
        {mean("total_revenue", WIDE)} AS avg_daily_revenue,
        {mean("total_transactions", WIDE)} AS avg_daily_transactions FROM x_summary""",
)
def _(lake):
    return bi.bi_query(lake.daily_summary, bi.metric_sets()["daily"])


@query(
    "bi_customer_kpis",
    """SELECT COUNT(DISTINCT customer_id) AS total_customers,
        round(AVG(avg_transaction_value), 6) AS avg_order_value FROM x_cust""",
)
def _(lake):
    offered = bi.metric_sets()["customer"]
    return bi.bi_query(
        lake.customer_mart, {k: offered[k] for k in ("total_customers", "avg_order_value")}
    )


@query(
    "bi_top_customers",
    """SELECT customer_name, CAST(SUM(total_spent) AS DECIMAL(38,2)) AS total_spend FROM x_cust_named
        GROUP BY 1 ORDER BY total_spend DESC, customer_name LIMIT 10""",
)
def _(lake):
    return bi.bi_query(
        lake.named_customers, {"total_spend": F.sum("total_spent").cast("decimal(38,2)")},
        ["customer_name"], order=[F.desc("total_spend"), F.asc("customer_name")], limit=10,
    )


@query(
    "bi_lifetime_hist",
    """WITH b AS (SELECT MIN(customer_lifetime_days)::DOUBLE AS lo, MAX(customer_lifetime_days)::DOUBLE AS hi
            FROM x_cust)
        SELECT CASE WHEN hi > lo THEN CAST(least(floor((customer_lifetime_days - lo) * 20 / (hi - lo)), 19)
            AS INTEGER) ELSE 0 END AS bin, COUNT(*) AS customers FROM x_cust, b GROUP BY 1""",
)
def _(lake):
    return bi.histogram(lake.customer_mart, "customer_lifetime_days")


@query(
    "bi_lifetime_dist",
    """SELECT customer_lifetime_days, COUNT(DISTINCT customer_id) AS total_customers FROM x_cust GROUP BY 1
        ORDER BY total_customers DESC, customer_lifetime_days LIMIT 50""",
)
def _(lake):
    return bi.bi_query(
        lake.customer_mart, {"total_customers": F.count_distinct("customer_id")},
        ["customer_lifetime_days"],
        order=[F.desc("total_customers"), F.asc("customer_lifetime_days")], limit=50,
    )


def top_products(metric):
    return f"""SELECT product_name, CAST(SUM({metric}) AS DECIMAL(38,2)) AS {metric} FROM x_prod_named
        GROUP BY 1 ORDER BY {metric} DESC, product_name LIMIT 10"""


@query("bi_top_products", top_products("total_revenue"))
def _(lake):
    return bi.bi_query(
        lake.named_products, {"total_revenue": F.sum("total_revenue").cast("decimal(38,2)")},
        ["product_name"], order=[F.desc("total_revenue"), F.asc("product_name")], limit=10,
    )


@query(
    "bi_category_share",
    """SELECT category, CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS total_revenue,
        CAST(SUM(total_revenue) AS DOUBLE) / (SELECT CAST(SUM(total_revenue) AS DOUBLE) FROM x_prod_named)
            AS share FROM x_prod_named GROUP BY 1""",
)
def _(lake):
    return bi.share_of_total(lake.named_products, "category", "total_revenue")


@query(
    "bi_product_table",
    """SELECT product_name, category, CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS total_revenue,
        CAST(SUM(total_units_sold) AS BIGINT) AS units_sold, CAST(SUM(unique_customers) AS BIGINT)
            AS unique_customers FROM x_prod_named GROUP BY 1, 2
        ORDER BY total_revenue DESC, product_name, category LIMIT 100""",
)
def _(lake):
    metrics = {
        "total_revenue": F.sum("total_revenue").cast("decimal(38,2)"),
        "units_sold": F.sum("total_units_sold"),
        "unique_customers": F.sum("unique_customers"),
    }
    order = [F.desc("total_revenue"), F.asc("product_name"), F.asc("category")]
    return bi.bi_query(lake.named_products, metrics, ["product_name", "category"], order=order, limit=100)


@query(
    "bi_product_customers",
    """SELECT product_name, CAST(SUM(unique_customers) AS BIGINT) AS unique_customers FROM x_prod_named
        GROUP BY 1 ORDER BY unique_customers DESC, product_name LIMIT 10""",
)
def _(lake):
    return bi.bi_query(
        lake.named_products, {"unique_customers": F.sum("unique_customers")}, ["product_name"],
        order=[F.desc("unique_customers"), F.asc("product_name")], limit=10,
    )


@query(
    "bi_daily_kpis",
    """SELECT CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS total_revenue,
        CAST(SUM(total_transactions) AS BIGINT) AS total_transactions FROM x_summary""",
)
def _(lake):
    return bi.bi_query(
        lake.daily_summary,
        {
            "total_revenue": F.sum("total_revenue").cast("decimal(38,2)"),
            "total_transactions": F.sum("total_transactions"),
        },
    )


@query(
    "bi_revenue_trend",
    """SELECT "date", CAST(SUM(total_revenue) AS DECIMAL(38,2)) AS daily_revenue FROM x_summary GROUP BY 1""",
)
def _(lake):
    metrics = {"daily_revenue": F.sum("total_revenue").cast("decimal(38,2)")}
    return bi.bi_query(lake.daily_summary, metrics, time_col="date", grain="P1D")


@query(
    "bi_volume_trend",
    """SELECT "date", CAST(SUM(total_transactions) AS BIGINT) AS transactions FROM x_summary GROUP BY 1""",
)
def _(lake):
    metrics = {"transactions": F.sum("total_transactions")}
    return bi.bi_query(lake.daily_summary, metrics, time_col="date", grain="P1D")


DAILY_COLUMNS = ["date", "total_revenue", "total_transactions", "unique_customers", "avg_transaction_value"]


@query(
    "bi_daily_table",
    """SELECT "date", total_revenue, total_transactions, unique_customers, avg_transaction_value
        FROM x_summary ORDER BY "date" DESC LIMIT 30""",
)
def _(lake):
    return lake.daily_summary.select(*DAILY_COLUMNS).orderBy(F.desc("date")).limit(30)


@query(
    "bi_last_month",
    """SELECT "date", total_revenue FROM x_summary
        WHERE "date" >= DATE '2023-12-20' AND "date" < DATE '2024-01-20'""",
)
def _(lake):
    return bi.last_month(lake.daily_summary, "date", "2024-01-20").select("date", "total_revenue")


@query(
    "bi_last_30_days",
    """SELECT "date", total_transactions, total_revenue, unique_customers FROM x_summary
        WHERE "date" >= DATE '2024-02-10' - 30 ORDER BY "date" """,
)
def _(lake):
    rows = bi.last_days(lake.daily_summary, "date", "2024-02-10")
    columns = ["date", "total_transactions", "total_revenue", "unique_customers"]
    return rows.select(*columns).orderBy("date")


# -- platform operations ------------------------------------------------------------------------------

DAY_SCORE = f"SELECT metric_date, {mean('health_score')} AS avg_health_score FROM x_health GROUP BY 1"


@query(
    "bi_health_score_delta",
    f"""WITH d AS ({DAY_SCORE}) SELECT metric_date, avg_health_score,
        lag(avg_health_score) OVER (ORDER BY metric_date) AS previous,
        avg_health_score - lag(avg_health_score) OVER (ORDER BY metric_date) AS change FROM d""",
)
def _(lake):
    daily = bi.bi_query(
        lake.health, {"avg_health_score": average("health_score")}, time_col="metric_date"
    )
    return bi.with_previous(daily, "metric_date", "avg_health_score")


@query(
    "bi_platform_kpis",
    f"""SELECT {mean("health_score")} AS avg_health_score, MAX(total_dags) AS total_dags,
        CAST(SUM(failed_tasks_24h) AS BIGINT) AS failed_tasks,
        {mean("sla_compliance_percent")} AS sla_compliance FROM x_health""",
)
def _(lake):
    return bi.bi_query(
        lake.health,
        {
            "avg_health_score": average("health_score"),
            "total_dags": F.max("total_dags"),
            "failed_tasks": F.sum("failed_tasks_24h"),
            "sla_compliance": average("sla_compliance_percent"),
        },
    )


def layer_mean(layer):
    chosen = f"FILTER (WHERE layer = '{layer}')"
    return (
        f"CAST(SUM(staleness_hours) {chosen} AS DOUBLE) / NULLIF(COUNT(staleness_hours) {chosen}, 0) AS {layer}"
    )


@query(
    "bi_freshness_heatmap",
    f"""SELECT source_name, {layer_mean("raw")}, {layer_mean("staging")}, {layer_mean("marts")}
        FROM x_fstat GROUP BY 1""",
)
def _(lake):
    return freshness.heatmap(freshness.status_view(lake.freshness))


@query(
    "bi_task_trend",
    """SELECT metric_date, CAST(SUM(failed_tasks_24h) AS BIGINT) AS failed_tasks,
        CAST(SUM(successful_tasks_24h) AS BIGINT) AS successful_tasks FROM x_health GROUP BY 1
        ORDER BY metric_date DESC LIMIT 30""",
)
def _(lake):
    metrics = {
        "failed_tasks": F.sum("failed_tasks_24h"), "successful_tasks": F.sum("successful_tasks_24h"),
    }
    return bi.newest(bi.bi_query(lake.health, metrics, time_col="metric_date", grain="P1D"), "metric_date")


@query(
    "bi_order_trend",
    """SELECT CAST(o_orderdate AS DATE) AS o_orderdate, COUNT(*) AS orders FROM orders GROUP BY 1
        ORDER BY 1 DESC LIMIT 30""",
)
def _(lake):
    """The same kind of trend over years of days: the newest thirty, in order of time."""
    return bi.newest(bi.bi_query(lake.orders, {"orders": F.count("*")}, time_col="o_orderdate", grain="P1D"), "o_orderdate")


@query(
    "bi_dq_trend",
    f"""SELECT execution_date, {layer_case("expectation_suite_name")} AS layer,
        COUNT(*) FILTER (WHERE success) AS passed, COUNT(*) FILTER (WHERE NOT success) AS failed
        FROM x_vr GROUP BY 1, 2""",
)
def _(lake):
    rows = lake.validations.withColumn("layer", layer_of_suite(F.col("expectation_suite_name")))
    metrics = {"passed": F.count_if("success"), "failed": F.count_if(~F.col("success"))}
    return bi.bi_query(rows, metrics, ["layer"], time_col="execution_date", grain="P1D")


@query(
    "bi_sla_trend",
    f"""SELECT metric_date, {mean("sla_compliance_percent")} AS sla_compliance, 95 AS target FROM x_health
        GROUP BY 1 ORDER BY metric_date DESC LIMIT 30""",
)
def _(lake):
    metrics = {"sla_compliance": average("sla_compliance_percent")}
    trend = bi.bi_query(lake.health, metrics, time_col="metric_date", grain="P1D")
    return bi.newest(trend, "metric_date").withColumn("target", F.lit(95))


@query(
    "bi_data_volume",
    """SELECT source_name, CAST(execution_date AS DATE) AS execution_date,
        CAST(SUM(row_count) AS BIGINT) AS total_rows FROM x_ing GROUP BY 1, 2""",
)
def _(lake):
    metrics = {"total_rows": F.sum("row_count")}
    return bi.bi_query(lake.ingestion, metrics, ["source_name"], time_col="execution_date", grain="P1D")


@query(
    "bi_ingestion_stats",
    """SELECT source_name, CAST(execution_date AS DATE) AS execution_date, COUNT(*) AS files_ingested,
        CAST(SUM(row_count) AS BIGINT) AS rows_processed FROM x_ing GROUP BY 1, 2
        ORDER BY execution_date DESC, source_name LIMIT 50""",
)
def _(lake):
    metrics = {"files_ingested": F.count("*"), "rows_processed": F.sum("row_count")}
    order = [F.desc("execution_date"), F.asc("source_name")]
    return bi.bi_query(
        lake.ingestion, metrics, ["source_name"], time_col="execution_date", grain="P1D", order=order, limit=50
    )


@query(
    "bi_open_alerts",
    f"""SELECT id, severity, alert_type, subject, dag_id, task_id, created_at,
        {hours(SQL_NOW, "created_at")} AS hours_since_alert FROM x_al WHERE NOT acknowledged
        ORDER BY created_at DESC, id LIMIT 20""",
)
def _(lake):
    return (
        alerts.unacknowledged(lake.alerts, EVENTS_NOW).orderBy(F.desc("created_at"), "id").limit(20)
    )


@query(
    "bi_health_hourly",
    f"""SELECT metric_time, {mean("health_score")} AS health_score FROM x_health GROUP BY 1
        ORDER BY metric_time DESC LIMIT 168""",
)
def _(lake):
    out = bi.bi_query(
        lake.health, {"health_score": average("health_score")}, time_col="metric_time", grain="PT1H",
        order=[F.desc("metric_time")], limit=168,
    )
    return out.withColumn("metric_time", F.col("metric_time").cast("timestamp_ntz"))


