"""Queries: single rules, suites, checkpoints and the validation ledger."""

from pyspark.sql import functions as F

from orefield.functions import convert_timestamp
from orefield.operators import freshness, governance, runs
from orefield.operators.quality import history, suites, validation
from orefield.operators.quality.rules import evaluate, repeated_values, rule
from orefield.session import new_workspace
from orefield.sources.layers import path_exists
from orefield.workload.oracle_tables import EVENTS_NOW as SQL_NOW
from orefield.workload.oracle_tables import hours, layer_case, mean, pct, rounded_mean
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW, ORDERS_NOW

EMAIL = suites.EMAIL.replace("'", "''")
DAYS = "- INTERVAL 7 DAY"


# -- oracle text ---------------------------------------------------------------------------------


def col_rule(kind, column, fails, mostly=None):
    """(kind, column, evaluated, unexpected, success) of a rule over non-null values."""
    unexpected = f"COUNT(*) FILTER (WHERE {column} IS NOT NULL AND ({fails}))"
    success = "u = 0" if mostly is None else f"coalesce((e - u)::DOUBLE / NULLIF(e, 0) >= {mostly}, true)"
    return kind, column, f"COUNT({column})", unexpected, success


def null_rule(column):
    return "not_null", column, "COUNT(*)", f"COUNT(*) FILTER (WHERE {column} IS NULL)", "u = 0"


def unique_rule(column, table):
    repeated = (
        f"(SELECT coalesce(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL "
        f"GROUP BY {column}) WHERE n > 1)"
    )
    return "unique", column, f"COUNT({column})", repeated, "u = 0"


def fixed_rule(kind, column, success):
    return kind, column, "NULL", "NULL", str(success).lower()


def rows_rule():
    return "row_count", None, "rows", "NULL", "n >= 1"


def results_sql(table, rules, extra=""):
    parts = []
    for i, (kind, column, evaluated, unexpected, success) in enumerate(rules):
        name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
        e = "NULL" if evaluated in ("NULL", "rows") else evaluated
        schema_only = "true" if evaluated == "NULL" else "false"
        parts.append(
            f"SELECT {i + 1} AS rule_no, '{kind}' AS rule, {name} AS column_name, COUNT(*) AS n, "
            f"CAST({e} AS BIGINT) AS e, CAST({unexpected} AS BIGINT) AS u, {schema_only} AS schema_only "
            f"FROM {table}"
        )
    cases = " ".join(f"WHEN {i + 1} THEN {r[4]}" for i, r in enumerate(rules))
    return f"""WITH counted AS ({" UNION ALL ".join(parts)})
        SELECT {extra}rule_no, rule, column_name, CASE rule_no {cases} END AS success,
        CASE WHEN NOT schema_only THEN n END AS element_count, u AS unexpected_count,
        {pct("u", "e")} AS unexpected_percent FROM counted"""


def one_rule(key, table, sql_rule, frame, *rules):
    """Register a query that evaluates ``rules`` on ``frame(lake)``."""

    @query(key, results_sql(table, sql_rule))
    def _(lake):
        return evaluate(frame(lake), list(rules))


def exists(column, present=True):
    return fixed_rule("exists", column, present)


# -- single rules ------------------------------------------------------------------------------------

one_rule(
    "dq_row_count", "x_raw", [("row_count", None, "rows", "NULL", "n >= 1 AND n <= 5000")],
    lambda lake: lake.raw_transactions, rule("row_count", min=1, max=5000),
)
one_rule(
    "dq_not_null", "x_raw", [null_rule("transaction_id"), null_rule("amount")],
    lambda lake: lake.raw_transactions, rule("not_null", "transaction_id"), rule("not_null", "amount"),
)
one_rule(
    "dq_unique", "lineitem", [unique_rule("l_orderkey", "lineitem"), unique_rule("l_shipdate", "lineitem")],
    lambda lake: lake.lineitem, rule("unique", "l_orderkey"), rule("unique", "l_shipdate"),
)
one_rule(
    "dq_between", "x_raw",
    [
        col_rule("between", "amount", "amount < 0.01 OR amount > 400"),
        col_rule("between", "quantity", "quantity <= 0"),
        col_rule("between", "product_id", "product_id < 5 OR product_id >= 90"),
    ],
    lambda lake: lake.raw_transactions,
    rule("between", "amount", min=0.01, max=400),
    rule("between", "quantity", min=0, strict_min=True),
    rule("between", "product_id", min=5, max=90, strict_max=True),
)
one_rule(
    "dq_in_set", "x_raw",
    [col_rule("in_set", "currency", "currency NOT IN ('USD','EUR','GBP','usd','eur','gbp')")],
    lambda lake: lake.raw_transactions, rule("in_set", "currency", values=suites.RAW_CURRENCIES),
)
one_rule(
    "dq_regex", "x_coded",
    [
        col_rule("matches", "customer_id", r"NOT regexp_matches(customer_id, '^CUST-\d+$')"),
        col_rule("matches", "product_id", r"NOT regexp_matches(product_id, '^PROD-\d+$')"),
    ],
    lambda lake: lake.coded_transactions,
    rule("matches", "customer_id", regex=suites.CUSTOMER_CODE),
    rule("matches", "product_id", regex=suites.PRODUCT_CODE),
)
one_rule(
    "dq_length", "part", [col_rule("length_between", "p_name", "length(p_name) < 5 OR length(p_name) > 10")],
    lambda lake: lake.part, rule("length_between", "p_name", min=5, max=10),
)
one_rule(
    "dq_pair_order", "x_cust",
    [
        ("pair_at_least", "last_transaction_date",
         "COUNT(*) FILTER (WHERE last_transaction_date IS NOT NULL AND first_transaction_date IS NOT NULL)",
         "COUNT(*) FILTER (WHERE last_transaction_date < first_transaction_date)", "u = 0"),
        ("pair_at_least", "last_transaction_date",
         "COUNT(*) FILTER (WHERE last_transaction_date IS NOT NULL AND first_transaction_date IS NOT NULL)",
         "COUNT(*) FILTER (WHERE last_transaction_date <= first_transaction_date)", "u = 0"),
    ],
    lambda lake: lake.customer_mart,
    rule("pair_at_least", "last_transaction_date", other="first_transaction_date", or_equal=True),
    rule("pair_at_least", "last_transaction_date", other="first_transaction_date"),
)
one_rule(
    "dq_currency", "x_raw",
    [
        col_rule("currency_code", "currency",
                 "upper(currency) NOT IN ('USD','EUR','GBP','JPY','CHF','CAD','AUD')"),
        col_rule("currency_code", "currency", "upper(currency) NOT IN ('GBP')"),
    ],
    lambda lake: lake.raw_transactions,
    rule("currency_code", "currency"), rule("currency_code", "currency", codes=["GBP"]),
)
one_rule(
    "dq_positive_amount", "x_raw",
    [
        col_rule("positive_amount", "amount", "amount <= 0"),
        col_rule("positive_amount", "quantity", "quantity < 0"),
        col_rule("positive_amount", "currency", "true"),
    ],
    lambda lake: lake.raw_transactions,
    rule("positive_amount", "amount"),
    rule("positive_amount", "quantity", strictly_positive=False),
    rule("positive_amount", "currency"),
)
one_rule(
    "dq_recent", "x_raw",
    [("recent", "timestamp", 'COUNT("timestamp")',
      f'COUNT(*) FILTER (WHERE "timestamp" < {SQL_NOW} {DAYS})', "u = 0")],
    lambda lake: lake.raw_transactions, rule("recent", "timestamp", as_of=EVENTS_NOW),
)
one_rule(
    "dq_mostly", "x_rawcust",
    [col_rule("matches", "email", f"NOT regexp_matches(email, '{EMAIL}')", 0.95),
     col_rule("length_between", "name", "length(name) > 17", 0.5)],
    lambda lake: lake.raw_customers,
    rule("matches", "email", mostly=0.95, regex=suites.EMAIL),
    rule("length_between", "name", mostly=0.5, max=17),
)
one_rule(
    "dq_dbt_generic", "x_stg",
    [
        unique_rule("transaction_id", "x_stg"), null_rule("transaction_id"), null_rule("customer_id"),
        null_rule("product_id"), null_rule("amount"), null_rule("currency"),
        col_rule("in_set", "currency", "currency NOT IN ('USD','EUR','GBP')"), null_rule("quantity"),
        null_rule("transaction_timestamp"),
    ],
    lambda lake: lake.stg,
    rule("unique", "transaction_id"), rule("not_null", "transaction_id"), rule("not_null", "customer_id"),
    rule("not_null", "product_id"), rule("not_null", "amount"), rule("not_null", "currency"),
    rule("in_set", "currency", values=suites.CURRENCIES), rule("not_null", "quantity"),
    rule("not_null", "transaction_timestamp"),
)


@query(
    "dq_duplicates",
    """SELECT COUNT(l_orderkey) - COUNT(DISTINCT l_orderkey) AS duplicate_count,
        (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM lineitem
            GROUP BY l_orderkey) WHERE n > 1) AS rows_in_duplicate_groups FROM lineitem""",
)
def _(lake):
    both = lake.lineitem.agg(
        (F.count("l_orderkey") - F.count_distinct("l_orderkey")).alias("duplicate_count")
    )
    repeated = repeated_values(lake.lineitem, "l_orderkey").scalar()
    return both.withColumn("rows_in_duplicate_groups", repeated)


@query("dq_positive_violations", "SELECT amount AS invalid_value FROM x_raw WHERE amount <= 0")
def _(lake):
    return lake.raw_transactions.where(F.col("amount") <= 0).select(
        F.col("amount").alias("invalid_value")
    )


@query(
    "dq_singular_tests",
    """SELECT 'amounts_positive' AS test_name, COUNT(*) FILTER (WHERE amount <= 0) AS failures FROM x_stg
        UNION ALL SELECT 'timestamps_kept', COUNT(*) FILTER (WHERE product_id = 0) FROM x_raw""",
)
def _(lake):
    amounts = lake.stg.agg(F.count_if(F.col("amount") <= 0).alias("failures")).select(
        F.lit("amounts_positive").alias("test_name"), "failures"
    )
    # One product's timestamps are broken on purpose: exactly those must be found.
    broken = F.concat(F.col("timestamp").cast("string"), F.lit("?"))
    text = lake.raw_transactions.withColumn(
        "as_text", F.when(F.col("product_id") == 0, broken).otherwise(F.col("timestamp").cast("string"))
    )
    same = convert_timestamp(text, "as_text").eqNullSafe(F.col("timestamp"))
    kept = text.agg(F.count_if(~same).alias("failures")).select(
        F.lit("timestamps_kept").alias("test_name"), "failures"
    )
    return amounts.unionByName(kept)


@query(
    "source_freshness",
    f"""SELECT MAX("timestamp") AS max_loaded_at, round({hours(SQL_NOW, 'MAX("timestamp")')}, 2) AS age_hours,
        CASE WHEN {hours(SQL_NOW, 'MAX("timestamp")')} <= 24 THEN 'pass'
            WHEN {hours(SQL_NOW, 'MAX("timestamp")')} <= 48 THEN 'warn' ELSE 'error' END AS state FROM x_raw""",
)
def _(lake):
    return freshness.freshness_state(lake.raw_transactions, "timestamp", EVENTS_NOW)


# -- scalar checks -------------------------------------------------------------------------------------


@query(
    "dq_sql_checks",
    """WITH c AS (SELECT 'rows' AS check_name, COUNT(*)::DOUBLE AS value FROM x_stg
            UNION ALL SELECT 'customers', COUNT(DISTINCT customer_id)::DOUBLE FROM x_stg
            UNION ALL SELECT 'negative_amounts', COUNT(*) FILTER (WHERE amount < 0)::DOUBLE FROM x_stg
            UNION ALL SELECT 'largest_amount', MAX(amount)::DOUBLE FROM x_stg)
        SELECT check_name, value, coalesce(value >= 1 AND value <= 100000, false) AS passed FROM c""",
)
def _(lake):
    checks = lake.stg.agg(
        F.count("*").alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_if(F.col("amount") < 0).alias("negative_amounts"),
        F.max("amount").alias("largest_amount"),
    )
    return validation.run_scalar_checks(checks, 1, 100000)


@query(
    "dq_ingestion_checks",
    """WITH c AS (SELECT 'named_sources' AS check_name, COUNT(*) FILTER (WHERE source_name IS NOT NULL)::DOUBLE
                AS value FROM x_ing
            UNION ALL SELECT 'runs_on_day', COUNT(*) FILTER (WHERE execution_date = '2001-08-01' AND status = 'success')::DOUBLE FROM x_ing
            UNION ALL SELECT 'duplicate_ids', (COUNT(id) - COUNT(DISTINCT id))::DOUBLE FROM x_ing
            UNION ALL SELECT 'marks_of_24_hours', COUNT(*) FILTER (WHERE updated_at >= TIMESTAMP '2001-08-02' - INTERVAL 24 HOUR)::DOUBLE FROM x_wm
            UNION ALL SELECT 'tables_exist', COUNT(*)::DOUBLE FROM information_schema.tables WHERE table_name IN ('orders', 'events'))
        SELECT check_name, value, value <> 0 AS passed FROM c""",
)
def _(lake):
    checks = lake.ingestion.agg(
        F.count_if(F.col("source_name").isNotNull()).alias("named_sources"),
        F.count_if((F.col("execution_date") == "2001-08-01") & (F.col("status") == "success")).alias("runs_on_day"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"),
    )
    fresh = F.col("updated_at") >= runs.since(ORDERS_NOW, 24)
    there = sum(path_exists(lake.spark, f"{lake.dir}/{t}.parquet") for t in ("orders", "events"))
    checks = checks.withColumns(
        {"marks_of_24_hours": lake.watermark_ledger.agg(F.count_if(fresh)).scalar(), "tables_exist": F.lit(there).cast("bigint")}
    )
    return validation.run_scalar_checks(checks)


@query(
    "dq_pass_value",
    """SELECT 'negative_totals' AS check_name, COUNT(*) FILTER (WHERE total_amount < 0)::DOUBLE AS value,
        COUNT(*) FILTER (WHERE total_amount < 0) = 0 AS passed FROM x_orders""",
)
def _(lake):
    checks = lake.stg_orders.agg(F.count_if(F.col("total_amount") < 0).alias("negative_totals"))
    return validation.run_scalar_checks(checks, 0, 0)


@query(
    "dq_daily_count",
    """SELECT transaction_date, total_transactions, total_transactions >= 260 AS passed FROM x_daily""",
)
def _(lake):
    return lake.daily.select(
        "transaction_date", "total_transactions", (F.col("total_transactions") >= 260).alias("passed")
    )


@query(
    "dq_referential_integrity",
    """SELECT 'lineitem_orders' AS relation, COUNT(*) AS orphan_rows,
            COUNT(DISTINCT l_orderkey) AS orphan_keys FROM lineitem WHERE l_orderkey NOT IN
            (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
        UNION ALL SELECT 'transactions_products', COUNT(*), COUNT(DISTINCT product_id) FROM x_stg
            WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""",
)
def _(lake):
    """Orphans per relation; the fact side is counted per key before it is joined."""

    def orphans(name, facts, key, keys):
        counted = facts.groupBy(key).agg(F.count("*").alias("n"))
        return (
            counted.join(keys.toDF(key).distinct(), key, "left_anti")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
                F.count("*").alias("orphan_keys"),
            )
            .select(F.lit(name).alias("relation"), "orphan_rows", "orphan_keys")
        )

    settled = lake.orders.where("o_orderstatus <> 'P'").select("o_orderkey")
    listed = lake.part.where("p_size > 10").select("p_partkey")
    return orphans("lineitem_orders", lake.lineitem, "l_orderkey", settled).unionByName(
        orphans("transactions_products", lake.stg, "product_id", listed)
    )


@query(
    "dq_reconcile_totals",
    """WITH a AS (SELECT CAST("timestamp" AS DATE) AS day, COUNT(*) AS n,
            CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM x_raw GROUP BY 1),
        b AS (SELECT transaction_date AS day, total_transactions AS n, total_amount AS total FROM x_daily)
        SELECT coalesce(a.day, b.day) AS day, a.n AS source_rows, b.n AS target_rows,
        a.total AS source_total, b.total AS target_total,
        CAST(coalesce(a.total, 0) - coalesce(b.total, 0) AS DECIMAL(28,2)) AS difference,
        a.n IS NOT DISTINCT FROM b.n AND a.total IS NOT DISTINCT FROM b.total AS reconciled
        FROM a FULL JOIN b ON a.day = b.day""",
)
def _(lake):
    """Raw against mart per day: both sides reduced first, then a full join on the day."""
    source = lake.raw_transactions.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("source_rows"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(28,2)").alias("source_total"),
    )
    target = lake.daily.select(
        F.col("transaction_date").alias("day"),
        F.col("total_transactions").alias("target_rows"),
        F.col("total_amount").alias("target_total"),
    )
    zero = F.lit(0).cast("decimal(28,2)")
    difference = F.coalesce("source_total", zero) - F.coalesce("target_total", zero)
    same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_total").eqNullSafe(
        F.col("target_total")
    )
    return source.join(target, "day", "full_outer").select(
        "day", "source_rows", "target_rows", "source_total", "target_total",
        difference.cast("decimal(28,2)").alias("difference"), same.alias("reconciled"),
    )


@query(
    "dq_completeness_sla",
    f"""WITH c AS (SELECT 'email' AS column_name, COUNT(email) AS p, COUNT(*) AS n FROM x_rawcust
            UNION ALL SELECT 'name', COUNT(name), COUNT(*) FROM x_rawcust
            UNION ALL SELECT 'country', COUNT(country), COUNT(*) FROM x_rawcust),
        l AS (SELECT * FROM (VALUES ('bronze', 95.0::DOUBLE), ('silver', 99.0::DOUBLE), ('gold', 99.5::DOUBLE))
            v(layer, target_percent))
        SELECT layer, column_name, {pct("p", "n")} AS completeness_percent, target_percent,
        {pct("p", "n")} > target_percent AS meets_target FROM c, l""",
)
def _(lake):
    columns = ["email", "name", "country"]
    out = governance.completeness(lake.raw_customers, columns, "bronze")
    for layer in ("silver", "gold"):
        out = out.unionByName(governance.completeness(lake.raw_customers, columns, layer))
    return out


# -- suites --------------------------------------------------------------------------------------------

RAW_TRANSACTIONS_SQL = [
    fixed_rule("column_set", None, True), rows_rule(), exists("transaction_id"),
    null_rule("transaction_id"), unique_rule("transaction_id", "x_coded"), exists("customer_id"),
    null_rule("customer_id"),
    col_rule("matches", "customer_id", r"NOT regexp_matches(customer_id, '^CUST-\d+$')"),
    exists("product_id"), null_rule("product_id"),
    col_rule("matches", "product_id", r"NOT regexp_matches(product_id, '^PROD-\d+$')"),
    exists("amount"), null_rule("amount"),
    col_rule("between", "amount", "amount < 0.01 OR amount > 1000000"),
    exists("currency"), null_rule("currency"),
    col_rule("in_set", "currency", "currency NOT IN ('USD','EUR','GBP','usd','eur','gbp')"),
    exists("quantity"), null_rule("quantity"),
    col_rule("between", "quantity", "quantity < 1 OR quantity > 10000"),
    exists("timestamp"), null_rule("timestamp"),
]
RAW_CUSTOMERS_SQL = [
    fixed_rule("column_set", None, True), rows_rule(), exists("customer_id"), null_rule("customer_id"),
    unique_rule("customer_id", "x_rawcust"),
    col_rule("matches", "customer_id", r"NOT regexp_matches(customer_id, '^CUST-\d+$')"),
    exists("name"), null_rule("name"),
    col_rule("length_between", "name", "length(name) NOT BETWEEN 1 AND 255"),
    exists("email"), null_rule("email"),
    col_rule("matches", "email", f"NOT regexp_matches(email, '{EMAIL}')"),
    unique_rule("email", "x_rawcust"), exists("country"), null_rule("country"),
    col_rule("length_between", "country", "length(country) NOT BETWEEN 2 AND 100"),
    exists("created_at"), null_rule("created_at"),
]
RAW_PRODUCTS_SQL = [
    fixed_rule("column_set", None, True), rows_rule(), exists("product_id"), null_rule("product_id"),
    unique_rule("product_id", "x_rawprod"),
    col_rule("matches", "product_id", r"NOT regexp_matches(product_id, '^PROD-\d+$')"),
    exists("name"), null_rule("name"),
    col_rule("length_between", "name", "length(name) NOT BETWEEN 1 AND 255"),
    exists("category"), null_rule("category"),
    col_rule("in_set", "category", "category NOT IN ('Electronics','Clothing','Food','Books','Home',"
             "'Sports','Toys','Other')"),
    exists("price"), null_rule("price"),
    col_rule("between", "price", "price < 0.01 OR price > 100000"),
    exists("created_at"), null_rule("created_at"),
]


def staging_sql(named):
    """Under the model's own names the column list and the load time do not hold."""
    return [
        fixed_rule("column_list", None, named), rows_rule(), null_rule("transaction_id"),
        unique_rule("transaction_id", "x_stg"), null_rule("customer_id"), null_rule("product_id"),
        null_rule("amount"), col_rule("between", "amount", "amount < 0.01"), null_rule("currency"),
        col_rule("in_set", "currency", "currency NOT IN ('USD','EUR','GBP')"), null_rule("quantity"),
        col_rule("between", "quantity", "quantity < 1"), null_rule("transaction_timestamp"),
        fixed_rule("of_type", "transaction_timestamp", True),
        ("not_null", "loaded_at", "COUNT(*)", "COUNT(*) FILTER (WHERE _loaded_at IS NULL)", "u = 0"),
    ]


def measure_sql(name, column=None):
    column = column or name
    return [
        exists(name),
        ("between", name, f"COUNT({column})", f"COUNT(*) FILTER (WHERE {column} < 0)", "u = 0"),
    ]


def key_sql(name, column, table):
    kind, _c, e, u, ok = unique_rule(column, table)
    return [
        rows_rule(), exists(name),
        ("not_null", name, "COUNT(*)", f"COUNT(*) FILTER (WHERE {column} IS NULL)", "u = 0"),
        (kind, name, e, u, ok),
    ]


MART_CUSTOMER_SQL = [
    *key_sql("customer_id", "customer_id", "x_cust"), *measure_sql("total_transactions"),
    *measure_sql("total_revenue", "total_spent"), *measure_sql("avg_order_value", "avg_transaction_value"),
    exists("first_transaction_date"), exists("last_transaction_date"),
    ("pair_at_least", "last_transaction_date", "COUNT(last_transaction_date)",
     "COUNT(*) FILTER (WHERE last_transaction_date < first_transaction_date)", "u = 0"),
]
MART_DAILY_SQL = [
    *key_sql("transaction_date", '"date"', "x_summary"), *measure_sql("total_transactions"),
    *measure_sql("total_revenue"), *measure_sql("unique_customers"), *measure_sql("unique_products"),
    *measure_sql("avg_order_value", "avg_transaction_value"),
]
MART_PRODUCT_SQL = [
    *key_sql("product_id", "product_id", "x_prod"), *measure_sql("total_units_sold"),
    *measure_sql("total_revenue"), *measure_sql("unique_customers"),
    *measure_sql("avg_transaction_amount", "avg_price_per_unit"),
]

SUITE_SQL = {
    "raw_transactions_suite": ("x_coded", RAW_TRANSACTIONS_SQL),
    "raw_customers_suite": ("x_rawcust", RAW_CUSTOMERS_SQL),
    "raw_products_suite": ("x_rawprod", RAW_PRODUCTS_SQL),
    "staging_transactions_suite": ("x_stg", staging_sql(True)),
    "mart_customer_analytics_suite": ("x_cust", MART_CUSTOMER_SQL),
    "mart_product_analytics_suite": ("x_prod", MART_PRODUCT_SQL),
    "mart_daily_summary_suite": ("x_summary", MART_DAILY_SQL),
}


def suite_sql(suite):
    table, rules = SUITE_SQL[suite]
    quoted = [
        (k, c, e.replace("COUNT(timestamp)", 'COUNT("timestamp")'), u, ok) for k, c, e, u, ok in rules
    ]
    return results_sql(table, quoted, extra=f"'{suite}' AS suite, ")


def assets(lake):
    return {
        "raw.transactions": lake.coded_transactions,
        "raw.customers": lake.raw_customers,
        "raw.products": lake.raw_products,
        "staging.stg_transactions": lake.stg,
        "marts.mart_customer_analytics": lake.customer_mart,
        "marts.mart_product_analytics": lake.product_mart,
        "marts.mart_daily_summary": lake.daily_summary,
    }


def stored_assets(lake):
    """The same with the marts written out first, as a pipeline would: built once, checked often."""
    root = new_workspace(lake.spark, "assets")
    found = assets(lake)
    for name in [n for n in found if n.startswith("marts.")]:
        found[name].write.parquet(f"{root}/{name}")
        found[name] = lake.spark.read.parquet(f"{root}/{name}")
    return found


SUITE_KEYS = {
    "dq_suite_raw": "raw_transactions_suite",
    "dq_suite_customers": "raw_customers_suite",
    "dq_suite_products": "raw_products_suite",
    "dq_suite_staging": "staging_transactions_suite",
    "dq_suite_mart_customer": "mart_customer_analytics_suite",
    "dq_suite_mart_product": "mart_product_analytics_suite",
    "dq_suite_mart_daily": "mart_daily_summary_suite",
}


def register_suite(key, suite):
    @query(key, suite_sql(suite))
    def _(lake):
        name = suites.ASSETS[suite]
        df = assets(lake)[name]
        if not name.startswith("raw."):  # a model is built once, and read again for each uniqueness rule
            path = f"{new_workspace(lake.spark, 'asset')}/{name}"
            df.write.parquet(path)
            df = lake.spark.read.schema(df.schema).parquet(path)
        return validation.run_suite(validation.with_suite_names(df, suite), suite)


for _key, _suite in SUITE_KEYS.items():
    register_suite(_key, _suite)


@query(
    "dq_suite_staging_as_modelled",
    results_sql(
        "x_stg",
        [*staging_sql(False)[:-1], ("not_null", "loaded_at", "rows", "NULL", "false")],
        extra="'staging_transactions_suite' AS suite, ",
    ).replace("CASE WHEN NOT schema_only THEN n END", "CASE WHEN NOT schema_only AND rule_no < 15 THEN n END"),
)
def _(lake):
    """On the model's own column names: a rule over a missing column fails, nothing crashes."""
    return validation.run_suite(lake.stg, "staging_transactions_suite")


ALL_RESULTS = "SELECT * FROM (" + ") UNION ALL BY NAME SELECT * FROM (".join(
    suite_sql(s) for s in SUITE_SQL
) + ")"


@query(
    "dq_checkpoint_full",
    f"""SELECT suite, COUNT(*) AS evaluated, COUNT(*) FILTER (WHERE success) AS successful,
        COUNT(*) FILTER (WHERE NOT success) AS unsuccessful,
        CAST(round({pct("COUNT(*) FILTER (WHERE success)", "COUNT(*)")}, 2) AS DECIMAL(5,2)) AS success_percent,
        bool_and(success) AS success FROM ({ALL_RESULTS}) GROUP BY suite""",
)
def _(lake):
    return validation.summarise(validation.run_checkpoint(stored_assets(lake)))


# -- validation ledger -----------------------------------------------------------------------------------


@query(
    "validation_log",
    f"""SELECT 'full-1' AS run_id, suite AS expectation_suite_name, {SQL_NOW} AS validation_time,
        bool_and(success) AS success, COUNT(*) AS total_expectations,
        COUNT(*) FILTER (WHERE success) AS successful_expectations,
        COUNT(*) FILTER (WHERE NOT success) AS unsuccessful_expectations,
        CAST(round({pct("COUNT(*) FILTER (WHERE success)", "COUNT(*)")}, 2) AS DECIMAL(5,2)) AS success_percent,
        DATE '2024-01-31' AS execution_date FROM ({ALL_RESULTS}) WHERE suite LIKE 'raw%' GROUP BY suite""",
)
def _(lake):
    """A checkpoint's summaries appended to the ledger and read back."""
    path = new_workspace(lake.spark, "validations")
    summary = validation.summarise(validation.run_checkpoint(assets(lake), "raw_only"))
    rows = history.validation_rows(summary, F.lit("full-1"), EVENTS_NOW)
    rows.write.mode("append").parquet(path)
    return lake.spark.read.parquet(path)


@query(
    "dq_recent_results",
    f"""SELECT run_id, expectation_suite_name, validation_time, success, total_expectations,
        successful_expectations, success_percent FROM x_vr
        WHERE validation_time > {SQL_NOW} {DAYS} AND expectation_suite_name = 'raw_products_suite'
        ORDER BY validation_time DESC, run_id DESC LIMIT 100""",
)
def _(lake):
    return history.recent_results(lake.validations, EVENTS_NOW, "raw_products_suite")


@query(
    "dq_suite_health",
    f"""SELECT expectation_suite_name, COUNT(*) AS total_runs,
        COUNT(*) FILTER (WHERE success) AS successful_runs,
        round({pct("COUNT(*) FILTER (WHERE success)", "COUNT(*)")}, 2) AS run_success_rate,
        {mean("success_percent", "DECIMAL(5,2)")} AS avg_success_percent, MAX(validation_time) AS last_run
        FROM x_vr WHERE validation_time > {SQL_NOW} - INTERVAL 30 DAY GROUP BY 1""",
)
def _(lake):
    return history.suite_health(lake.validations, EVENTS_NOW)


@query(
    "dq_daily_metrics",
    f"""SELECT execution_date AS metric_date, expectation_suite_name,
        {layer_case("expectation_suite_name")} AS layer, COUNT(*) AS total_validations,
        COUNT(*) FILTER (WHERE success) AS successful_validations,
        CAST(SUM(total_expectations) AS BIGINT) AS total_expectations,
        CAST(SUM(successful_expectations) AS BIGINT) AS successful_expectations,
        {rounded_mean("success_percent")} AS avg_success_percent,
        MIN(success_percent) AS min_success_percent, MAX(success_percent) AS max_success_percent
        FROM x_vr GROUP BY 1, 2""",
)
def _(lake):
    return history.daily_metrics(lake.validations)


@query(
    "dq_alerts",
    """SELECT run_id AS validation_result_id, 'failure' AS alert_type,
        CASE WHEN success_percent < 50 THEN 'critical' WHEN success_percent < 75 THEN 'high'
            WHEN success_percent < 90 THEN 'medium' ELSE 'low' END AS severity,
        expectation_suite_name, data_asset_name,
        'Validation failed: ' || successful_expectations || '/' || total_expectations
            || ' expectations passed (' || CAST(round(success_percent, 1) AS DECIMAL(5,1)) || '%)' AS message
        FROM x_vr WHERE NOT success""",
)
def _(lake):
    return history.failure_alerts(lake.validations)


@query(
    "dq_status_view",
    f"""SELECT expectation_suite_name, {layer_case("expectation_suite_name")} AS layer,
        COUNT(*) AS total_runs_7d, COUNT(*) FILTER (WHERE success) AS successful_runs_7d,
        {rounded_mean("success_percent")} AS avg_success_percent_7d, MAX(validation_time) AS last_validation,
        bool_and(success) FILTER (WHERE validation_time > {SQL_NOW} - INTERVAL 1 DAY) AS healthy_last_24h
        FROM x_vr WHERE validation_time > {SQL_NOW} {DAYS} GROUP BY 1, 2""",
)
def _(lake):
    return history.status_view(lake.validations, EVENTS_NOW)


@query(
    "dq_summary",
    f"""SELECT COUNT(*) AS total_validations, COUNT(*) FILTER (WHERE success) AS passed_validations,
        COUNT(*) FILTER (WHERE NOT success) AS failed_validations,
        round({pct("COUNT(*) FILTER (WHERE success)", "COUNT(*)")}, 2) AS validation_rate,
        CAST(SUM(total_expectations) AS BIGINT) AS total_expectations,
        CAST(SUM(successful_expectations) AS BIGINT) AS passed_expectations,
        round({pct("SUM(successful_expectations)", "SUM(total_expectations)")}, 2) AS expectation_rate,
        (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT expectation_suite_name AS s FROM x_vr
            WHERE NOT success)) AS failed_suites FROM x_vr""",
)
def _(lake):
    return history.validation_summary(lake.validations)


@query(
    "dq_layer_summary",
    f"""SELECT {layer_case("expectation_suite_name", prefix=False)} AS layer, COUNT(*) AS total,
        COUNT(*) FILTER (WHERE success) AS passed, COUNT(*) FILTER (WHERE NOT success) AS failed
        FROM x_vr GROUP BY 1""",
)
def _(lake):
    return history.layer_summary(lake.validations)


@query(
    "dq_trends",
    """SELECT expectation_suite_name, validation_time, run_id, success, success_percent, total_expectations,
        successful_expectations FROM x_vr""",
)
def _(lake):
    return history.trend_series(lake.validations)


def register_rollup(grain):
    @query(
        f"dq_trends_{grain}",
        f"""SELECT expectation_suite_name, CAST(date_trunc('{grain}', validation_time) AS DATE) AS bucket,
            COUNT(*) AS runs, COUNT(*) FILTER (WHERE success) AS successful_runs,
            {mean("success_percent", "DECIMAL(5,2)")} AS avg_success_percent FROM x_vr GROUP BY 1, 2""",
    )
    def _(lake):
        return history.trend_rollup(lake.validations, grain)


for _grain in ("day", "week", "month"):
    register_rollup(_grain)
