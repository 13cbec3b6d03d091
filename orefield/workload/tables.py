"""The engine's input tables, derived from the given Parquet tables.

Each property is a lazy DataFrame; ``oracle_tables.CTES`` holds the same definitions in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import alert_type_of_title, health_score, percent
from orefield.operators.ledger import run_finished, run_started
from orefield.operators.quality.suites import ASSETS, CATEGORIES
from orefield.plans import customers, sales, transactions

# Fixed moments that stand in for "now".
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"

SUITE_NAMES = list(ASSETS)


def pick(value: Column, options, otherwise=None) -> Column:
    """CASE value WHEN 0 THEN options[0] ..."""
    expr = F.when(F.lit(False), options[0])
    for i, option in enumerate(options):
        expr = expr.when(value == i, option)
    return expr if otherwise is None else expr.otherwise(otherwise)


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._opened[name]

    # -- given tables ------------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn(
            "k", F.get_json_object("props", "$.k").cast("bigint")
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @cached_property
    def part(self) -> DataFrame:
        return self.table("part")

    # -- transactions and marts --------------------------------------------------------------

    def transactions_of(self, events: DataFrame) -> DataFrame:
        """Bronze transactions with null ids, negative amounts and zero quantities among them."""
        currency = (
            F.when(F.col("event_type") == "signup", " usd")
            .when(F.col("event_type") == "purchase", "EUR ")
            .when(F.col("event_type") == "view", "gbp")
            .when(F.col("event_type") == "click", "USD")
            .otherwise("eur")
        )
        return events.select(
            F.when(F.col("event_id") % 101 != 7, F.col("event_id")).alias("transaction_id"),
            F.col("user_id").alias("customer_id"),
            F.col("k").alias("product_id"),
            F.when(F.col("event_id") % 53 == 5, -F.col("value"))
            .otherwise(F.col("value"))
            .alias("amount"),
            currency.alias("currency"),
            (F.col("k") % 5).cast("int").alias("quantity"),
            F.col("ts").alias("timestamp"),
        )

    @cached_property
    def raw_transactions(self) -> DataFrame:
        return self.transactions_of(self.events)

    @cached_property
    def coded_transactions(self) -> DataFrame:
        """Variant with CUST- / PROD- codes, some malformed."""
        bad = F.col("customer_id") % 40 == 3
        return self.raw_transactions.withColumns(
            {
                "customer_id": F.concat(
                    F.when(bad, "CUS-").otherwise("CUST-"), F.col("customer_id").cast("string")
                ),
                "product_id": F.concat(F.lit("PROD-"), F.col("product_id").cast("string")),
                "currency": F.trim("currency"),
            }
        )

    @cached_property
    def stg(self) -> DataFrame:
        return transactions.stage_transactions(self.raw_transactions, EVENTS_NOW)

    @cached_property
    def enriched(self) -> DataFrame:
        return transactions.enrich_transactions(self.stg)

    @cached_property
    def daily(self) -> DataFrame:
        return transactions.daily_transactions(self.stg)

    @cached_property
    def daily_summary(self) -> DataFrame:
        return transactions.daily_summary(self.daily)

    @cached_property
    def customer_mart(self) -> DataFrame:
        return transactions.customer_analytics(self.enriched)

    @cached_property
    def product_mart(self) -> DataFrame:
        return transactions.product_analytics(self.enriched)

    @cached_property
    def customer_names(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
        )

    @cached_property
    def product_names(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
        )

    @cached_property
    def named_customers(self) -> DataFrame:
        return self.customer_mart.join(self.customer_names, "customer_id", "left")

    @cached_property
    def named_products(self) -> DataFrame:
        return self.product_mart.join(self.product_names, "product_id", "left")

    # -- customers, products, orders, sales, users ---------------------------------------------

    @cached_property
    def raw_customers(self) -> DataFrame:
        nation = self.table("nation")
        rows = self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        return rows.select(
            F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("customer_id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 10 != 0, email).alias("email"),
            F.col("n_name").alias("country"),
            F.lit("2024-01-01").alias("created_at"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("PROD-"), F.col("p_partkey").cast("string")).alias("product_id"),
            F.col("p_name").alias("name"),
            pick(F.col("p_size") % 9, CATEGORIES, F.col("p_type")).alias("category"),
            F.col("p_retailprice").alias("price"),
            F.lit("2024-01-01").alias("created_at"),
        )

    @cached_property
    def crm_customers(self) -> DataFrame:
        key = F.col("c_custkey")
        name = F.lower(F.replace("c_name", F.lit("#"), F.lit(" ")))
        email = F.concat(F.lit(" USER"), key.cast("string"), F.lit("@Example.com "))
        return self.customer.select(
            F.concat(F.lit(" C"), key.cast("string"), F.lit(" ")).alias("customer_id"),
            F.concat(F.lit("  "), name).alias("full_name"),
            F.when(key % 10 != 0, F.when(key % 10 == 1, F.lit("broken")).otherwise(email)).alias("email"),
            F.date_add(F.lit("2020-01-01").cast("date"), (key % 365).cast("int"))
            .cast("string")
            .alias("created_date"),
            pick(key % 5, ["Yes", "TRUE", "1", "no"]).alias("is_active"),
        )

    @cached_property
    def stg_customers(self) -> DataFrame:
        return customers.stage_customers(self.crm_customers, EVENTS_NOW)

    @cached_property
    def raw_orders(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", " Completed")
            .when(F.col("o_orderstatus") == "O", "open")
            .otherwise("pending")
        )
        return self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("total_amount"),
            status.alias("status"),
        )

    @cached_property
    def stg_orders(self) -> DataFrame:
        return sales.stage_orders(self.raw_orders)

    @cached_property
    def raw_sales(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        where = self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            region, F.col("n_regionkey") == F.col("r_regionkey")
        )
        placed = self.orders.join(where, F.col("o_custkey") == F.col("c_custkey"))
        # Both sides grow with the data: shuffle them, where AQE splits a hot key, never broadcast.
        placed = placed.hint("merge")
        rows = self.lineitem.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.part, F.col("l_partkey") == F.col("p_partkey")
        )
        code = F.concat(
            F.lit(" T"), F.col("l_orderkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"), F.lit(" "),
        )
        return rows.select(
            code.alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.concat(F.lit(" "), F.col("p_name")).alias("product_name"),
            (F.col("l_quantity").cast("int") - 2).alias("quantity"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
            F.col("l_shipdate").cast("date").alias("sale_date"),
            F.concat(F.lower("r_name"), F.lit(" ")).alias("region"),
        )

    @cached_property
    def stg_sales(self) -> DataFrame:
        return sales.stage_sales(self.raw_sales, EVENTS_NOW)

    @cached_property
    def raw_users(self) -> DataFrame:
        part = F.col("l_partkey").cast("string")
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.concat(F.lit("user_"), part).alias("name"),
            F.when(
                F.col("l_partkey") % 10 != 0, F.concat(F.lit("u"), part, F.lit("@example.com"))
            ).alias("email"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            (F.col("p_size") * 2).alias("score"),
        )

    # -- ledgers ---------------------------------------------------------------------------------

    @cached_property
    def ingestion(self) -> DataFrame:
        status, key = F.col("o_orderstatus"), F.col("o_orderkey")
        created = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
        rows = F.when(status != "F", F.floor("o_totalprice").cast("bigint"))
        return self.orders.select(
            key.alias("id"),
            F.concat(F.lit("src_"), (F.col("o_custkey") % 20).cast("string")).alias("source_name"),
            pick(F.col("o_custkey") % 3, ["csv", "json"], "postgres").alias("source_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("execution_date"),
            rows.alias("row_count"),
            (rows * 8).alias("file_size_bytes"),
            F.when(status == "O", F.md5(key.cast("string"))).alias("checksum"),
            F.when(status == "F", "failed").when(status == "O", "success").otherwise("running")
            .alias("status"),
            F.when(status == "F", F.concat(F.lit("load failed for "), key.cast("string")))
            .alias("error_message"),
            created.alias("created_at"),
            (created + F.make_dt_interval(mins=F.lit(5))).alias("updated_at"),
        )

    @cached_property
    def run_events(self) -> DataFrame:
        runs = self.ingestion.withColumns(
            {"run_id": F.col("id"), "started_at": F.col("created_at")}
        )
        done = runs.where(F.col("status") != "running")
        return run_started(runs).unionByName(
            run_finished(
                done, F.col("status") == "success", F.col("row_count"), F.col("error_message"),
                F.col("updated_at"),
            )
        )

    @cached_property
    def watermark_ledger(self) -> DataFrame:
        return self.ingestion.where(F.col("status") == "success").select(
            "source_name",
            F.lit("updated_at").alias("watermark_column"),
            F.concat(F.col("execution_date"), F.lit(" 00:00:00")).alias("watermark_value"),
            F.lit("timestamp").alias("watermark_type"),
            "updated_at",
        )

    @cached_property
    def schema_history(self) -> DataFrame:
        listed = F.repeat(F.lit('{"type":"string"},'), (F.col("k") % 7 + 1).cast("int"))
        columns = F.regexp_replace(listed, ",$", "")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("feed_"), (F.col("user_id") % 10).cast("string")).alias("source_name"),
            F.concat(
                F.lit('{"columns":['), columns, F.lit('],"row_count":'), F.col("k").cast("string"),
                F.lit("}"),
            ).alias("schema_metadata"),
            F.date_format("ts", "yyyy-MM-dd").alias("execution_date"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def validations(self) -> DataFrame:
        suite, ok = F.col("user_id") % len(SUITE_NAMES), (F.col("k") % 23).cast("int")
        return self.events.select(
            F.col("event_id").alias("run_id"),
            pick(suite, SUITE_NAMES).alias("expectation_suite_name"),
            pick(suite, list(ASSETS.values())).alias("data_asset_name"),
            F.col("ts").alias("validation_time"),
            (ok == 22).alias("success"),
            F.lit(22).alias("total_expectations"),
            ok.alias("successful_expectations"),
            (F.lit(22) - ok).alias("unsuccessful_expectations"),
            percent(ok, F.lit(22)).cast("decimal(5,2)").alias("success_percent"),
            F.to_date("ts").alias("execution_date"),
        )

    # -- runs, health, freshness, alerts ------------------------------------------------------------

    @cached_property
    def tasks(self) -> DataFrame:
        kind = F.col("event_type")
        state = (
            F.when(kind == "error", "failed")
            .when(kind == "view", "running")
            .when(kind == "signup", "queued")
            .otherwise("success")
        )
        seconds = F.round(F.col("value") * 60).cast("decimal(18,6)")
        end = F.when(state.isin("failed", "success"), F.col("ts") + F.make_dt_interval(secs=seconds))
        return self.events.select(
            F.col("event_id").alias("run_id"),
            F.concat(F.lit("dag_"), (F.col("user_id") % 20).cast("string")).alias("dag_id"),
            kind.alias("task_id"),
            F.col("ts").alias("execution_date"),
            state.alias("state"),
            F.col("ts").alias("start_date"),
            end.alias("end_date"),
            F.col("k").alias("priority_weight"),
            F.col("value"),
        )

    @cached_property
    def sla_misses(self) -> DataFrame:
        return self.tasks.where(F.col("value") > 200).select(
            "dag_id", "task_id", "execution_date", F.col("start_date").alias("timestamp")
        )

    @cached_property
    def dags(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.select(
            F.concat(F.lit("dag_"), key.cast("string")).alias("dag_id"),
            (key % 4 != 0).alias("is_active"),
            (key % 3 == 0).alias("is_paused"),
        )

    @cached_property
    def health(self) -> DataFrame:
        def state(name):
            return F.count_if(F.col("state") == name)

        hourly = self.tasks.groupBy(
            F.date_trunc("hour", "start_date").cast("timestamp_ntz").alias("metric_time")
        ).agg(
            (state("success") > 0).alias("scheduler_healthy"),
            F.countDistinct("dag_id").alias("total_dags"),
            F.countDistinct(F.when(F.col("state") == "success", F.col("dag_id"))).alias("active_dags"),
            state("failed").alias("failed_tasks_24h"),
            state("success").alias("successful_tasks_24h"),
            state("running").alias("running_tasks"),
            state("queued").alias("queued_tasks"),
            percent(state("success") + state("running"), F.count("*")).alias("sla_compliance_percent"),
            F.max("value").alias("avg_data_freshness_hours"),
            F.count_if(F.col("value") > 100).alias("stale_sources_count"),
        )
        score = health_score(
            F.col("scheduler_healthy"), F.col("failed_tasks_24h"), F.col("sla_compliance_percent"),
            F.col("stale_sources_count"), F.col("queued_tasks"),
        )
        return hourly.withColumns(
            {
                "metric_date": F.to_date("metric_time"),
                "health_score": score,
                "issues": F.when(F.col("failed_tasks_24h") > 5, "High failure rate").otherwise(""),
            }
        )

    @cached_property
    def freshness(self) -> DataFrame:
        layer = (
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "raw")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "staging")
            .otherwise("marts")
        )
        rows = self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("src_"), (F.col("o_custkey") % 20).cast("string")).alias("source_name"),
            layer.alias("layer"),
            F.col("o_orderdate").alias("last_update_time"),
            F.floor("o_totalprice").cast("bigint").alias("row_count"),
            (
                F.col("o_orderdate")
                + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
            ).alias("check_time"),
        )
        hours = ((F.col("row_count") % 5000) / 100).cast("decimal(10,2)")
        allowed = F.when(F.col("layer") == "raw", 24).when(F.col("layer") == "staging", 12).otherwise(6)
        return rows.withColumns(
            {"staleness_hours": hours, "expected_freshness_hours": allowed}
        ).withColumn("is_fresh", F.col("staleness_hours") < F.col("expected_freshness_hours"))

    def alerts_of(self, events: DataFrame) -> DataFrame:
        user, k = F.col("user_id").cast("string"), F.col("k")
        number = F.col("user_id") % 20
        dag = pick(
            number,
            ["sample_batch_ingestion", "dbt_transform", "data_quality_checks", "example_hello_world",
             "example_monitoring"],
            F.concat(F.lit("dag_"), number.cast("string")),
        )
        title = pick(
            k % 7,
            [
                F.concat(F.lit("Task Failure: "), user), F.concat(F.lit("Data Quality Alert: "), user),
                F.lit("SLA Missed"), F.lit("Platform Health Alert"),
                F.concat(F.lit("Data Freshness: "), user), F.concat(F.lit("Volume Anomaly: "), user),
            ],
            F.lit("Something else"),
        )
        fields = F.concat(
            F.lit('[{"title":"DAG","value":"'), dag, F.lit('"},{"title":"Task","value":"'),
            F.col("event_type"), F.lit('"},{"title":"Execution Date","value":"'),
            F.date_format("ts", "yyyy-MM-dd"), F.lit('"},{"title":"Try Number","value":"'),
            k.cast("string"), F.lit('"},{"title":"Log URL","value":"http://log/'), user, F.lit('"}]'),
        )
        return events.where(F.col("event_type").isin("error", "click")).select(
            F.col("event_id").alias("id"),
            title.alias("title"),
            pick(k % 5, ["critical", "high", "medium", "low"], "low").alias("severity"),
            title.alias("subject"),
            dag.alias("dag_id"),
            F.col("event_type").alias("task_id"),
            fields.alias("fields"),
            F.col("ts").alias("created_at"),
            (k % 3 == 0).alias("acknowledged"),
            (k % 10 == 0).alias("is_retry"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self.alerts_of(self.events).withColumn(
            "alert_type", alert_type_of_title(F.col("title"))
        )

    # -- governance ---------------------------------------------------------------------------------

    @cached_property
    def owners(self) -> DataFrame:
        key = F.col("c_custkey")
        text = key.cast("string")
        nation = F.col("c_nationkey").cast("string")
        return self.customer.select(
            F.concat(F.lit("ds_"), text).alias("dataset_name"),
            F.concat(F.lit("schema_"), (key % 5).cast("string")).alias("schema_name"),
            F.lit("lake").alias("database_name"),
            F.col("c_name").alias("owner_name"),
            F.concat(F.lit("owner"), text, F.lit("@example.com")).alias("owner_email"),
            F.col("c_mktsegment").alias("owner_team"),
            F.concat(F.lit("steward_"), nation).alias("steward_name"),
            F.concat(F.lit("steward_"), nation, F.lit("@example.com")).alias("steward_email"),
            F.concat(F.lit("domain_"), nation).alias("business_domain"),
            pick(key % 4, ["public", "internal", "confidential"], "restricted").alias("data_classification"),
            (key % 3 == 0).alias("pii_flag"),
        )

    @cached_property
    def access_requests(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "approved")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("rejected")
        )
        return self.orders.select(
            F.col("o_orderkey").alias("id"), *_dataset(F.col("o_custkey"), "dataset_name", "schema_name"),
            status.alias("status"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders.select(
            key.alias("id"),
            pick(key % 6, ["table", "dbt_node", "schema", "container", "dashboard"], "topic").alias("source_type"),
            *_dataset(F.col("o_custkey"), "source_name", "source_schema"),
            F.lit("table").alias("target_type"),
            *_dataset(key % 997, "target_name", "target_schema"),
            F.col("o_orderpriority").alias("transformation_type"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def manifest(self) -> DataFrame:
        parents = F.array(
            F.concat(F.lit("source.lake.orders_"), (F.col("o_orderkey") % 50).cast("string")),
            F.concat(F.lit("model.lake.seg_"), (F.col("o_custkey") % 5).cast("string")),
        )
        return self.orders.select(
            F.concat(F.lit("model.lake.cust_"), F.col("o_custkey").cast("string")).alias("child"),
            parents.alias("parents"),
        )

    @cached_property
    def catalog_tables(self) -> DataFrame:
        return self.part.select(*_dataset(F.col("p_partkey"), "table_name", "schema_name"))

    @cached_property
    def catalog_columns(self) -> DataFrame:
        return self.part.select(
            *_dataset(F.col("p_partkey"), "table_name", "schema_name"),
            F.col("p_type").alias("column_name"),
            F.when(F.col("p_size") != 7, F.col("p_name")).alias("description"),
        )

    @cached_property
    def supply_edges(self) -> DataFrame:
        """part -> supplier -> nation -> region as dataset lineage."""
        def node(kind, key):
            return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))

        supplied = self.lineitem.select(
            node("part", "l_partkey").alias("source"), node("supplier", "l_suppkey").alias("target")
        )
        located = self.table("supplier").select(
            node("supplier", "s_suppkey").alias("source"), node("nation", "s_nationkey").alias("target")
        )
        belongs = self.table("nation").select(
            node("nation", "n_nationkey").alias("source"), node("region", "n_regionkey").alias("target")
        )
        return supplied.unionByName(located).unionByName(belongs)


def _dataset(key: Column, name: str, schema: str) -> list[Column]:
    return [
        F.concat(F.lit("ds_"), key.cast("string")).alias(name),
        F.concat(F.lit("schema_"), (key % 5).cast("string")).alias(schema),
    ]
