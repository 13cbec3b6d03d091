"""The shipped suites and the four checkpoints over them."""

from __future__ import annotations

from orefield.operators.quality.rules import Rule, rule

# Column lists, patterns, sets and bounds the suites check.
TRANSACTION_COLUMNS = [
    "transaction_id", "customer_id", "product_id", "amount", "currency", "quantity", "timestamp",
]
STAGED_COLUMNS = [
    "transaction_id", "customer_id", "product_id", "amount", "currency", "quantity",
    "transaction_timestamp", "loaded_at",
]
CUSTOMER_COLUMNS = ["customer_id", "name", "email", "country", "created_at"]
PRODUCT_COLUMNS = ["product_id", "name", "category", "price", "created_at"]
CUSTOMER_CODE = r"^CUST-\d+$"
PRODUCT_CODE = r"^PROD-\d+$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CURRENCIES = ["USD", "EUR", "GBP"]
RAW_CURRENCIES = ["USD", "EUR", "GBP", "usd", "eur", "gbp"]
CATEGORIES = ["Electronics", "Clothing", "Food", "Books", "Home", "Sports", "Toys", "Other"]


def _present(column: str, *more: Rule) -> list[Rule]:
    return [rule("exists", column), rule("not_null", column), *more]


def _measure(column: str) -> list[Rule]:
    return [rule("exists", column), rule("between", column, min=0)]


def _key(column: str, *more: Rule) -> list[Rule]:
    return _present(column, rule("unique", column), *more)


NOT_EMPTY = rule("row_count", min=1)

RAW_TRANSACTIONS = [
    rule("column_set", columns=TRANSACTION_COLUMNS, exact=False),
    NOT_EMPTY,
    *_key("transaction_id"),
    *_present("customer_id", rule("matches", "customer_id", regex=CUSTOMER_CODE)),
    *_present("product_id", rule("matches", "product_id", regex=PRODUCT_CODE)),
    *_present("amount", rule("between", "amount", min=0.01, max=1000000)),
    *_present("currency", rule("in_set", "currency", values=RAW_CURRENCIES)),
    *_present("quantity", rule("between", "quantity", min=1, max=10000)),
    *_present("timestamp"),
]
RAW_CUSTOMERS = [
    rule("column_set", columns=CUSTOMER_COLUMNS, exact=False),
    NOT_EMPTY,
    *_key("customer_id", rule("matches", "customer_id", regex=CUSTOMER_CODE)),
    *_present("name", rule("length_between", "name", min=1, max=255)),
    *_present("email", rule("matches", "email", regex=EMAIL), rule("unique", "email")),
    *_present("country", rule("length_between", "country", min=2, max=100)),
    *_present("created_at"),
]
RAW_PRODUCTS = [
    rule("column_set", columns=PRODUCT_COLUMNS, exact=False),
    NOT_EMPTY,
    *_key("product_id", rule("matches", "product_id", regex=PRODUCT_CODE)),
    *_present("name", rule("length_between", "name", min=1, max=255)),
    *_present("category", rule("in_set", "category", values=CATEGORIES)),
    *_present("price", rule("between", "price", min=0.01, max=100000)),
    *_present("created_at"),
]
STAGING_TRANSACTIONS = [
    rule("column_list", columns=STAGED_COLUMNS),
    NOT_EMPTY,
    rule("not_null", "transaction_id"),
    rule("unique", "transaction_id"),
    rule("not_null", "customer_id"),
    rule("not_null", "product_id"),
    rule("not_null", "amount"),
    rule("between", "amount", min=0.01),
    rule("not_null", "currency"),
    rule("in_set", "currency", values=CURRENCIES),
    rule("not_null", "quantity"),
    rule("between", "quantity", min=1),
    rule("not_null", "transaction_timestamp"),
    rule("of_type", "transaction_timestamp", type="timestamp"),
    rule("not_null", "loaded_at"),
]
MART_CUSTOMER = [
    NOT_EMPTY,
    *_key("customer_id"),
    *_measure("total_transactions"),
    *_measure("total_revenue"),
    *_measure("avg_order_value"),
    rule("exists", "first_transaction_date"),
    rule("exists", "last_transaction_date"),
    rule("pair_at_least", "last_transaction_date", other="first_transaction_date", or_equal=True),
]
MART_DAILY = [
    NOT_EMPTY,
    *_key("transaction_date"),
    *_measure("total_transactions"),
    *_measure("total_revenue"),
    *_measure("unique_customers"),
    *_measure("unique_products"),
    *_measure("avg_order_value"),
]
MART_PRODUCT = [
    NOT_EMPTY,
    *_key("product_id"),
    *_measure("total_units_sold"),
    *_measure("total_revenue"),
    *_measure("unique_customers"),
    *_measure("avg_transaction_amount"),
]

SUITES: dict[str, list[Rule]] = {
    "raw_transactions_suite": RAW_TRANSACTIONS,
    "raw_customers_suite": RAW_CUSTOMERS,
    "raw_products_suite": RAW_PRODUCTS,
    "staging_transactions_suite": STAGING_TRANSACTIONS,
    "mart_customer_analytics_suite": MART_CUSTOMER,
    "mart_product_analytics_suite": MART_PRODUCT,
    "mart_daily_summary_suite": MART_DAILY,
}

# Table each suite checks.
ASSETS = {
    "raw_transactions_suite": "raw.transactions",
    "raw_customers_suite": "raw.customers",
    "raw_products_suite": "raw.products",
    "staging_transactions_suite": "staging.stg_transactions",
    "mart_customer_analytics_suite": "marts.mart_customer_analytics",
    "mart_product_analytics_suite": "marts.mart_product_analytics",
    "mart_daily_summary_suite": "marts.mart_daily_summary",
}

SCOPES = {"raw_only": "raw.", "staging_only": "staging.", "marts_only": "marts.", "full": ""}

# The suites name some columns otherwise than the models do; renaming a model's output with
# these lets a suite run on it with its intended meaning.
MODEL_TO_SUITE_NAMES = {
    "staging_transactions_suite": {"_loaded_at": "loaded_at"},
    "mart_customer_analytics_suite": {
        "total_spent": "total_revenue", "avg_transaction_value": "avg_order_value",
    },
    "mart_daily_summary_suite": {
        "date": "transaction_date", "avg_transaction_value": "avg_order_value",
    },
    "mart_product_analytics_suite": {"avg_price_per_unit": "avg_transaction_amount"},
}


def suites_in_scope(scope: str = "full") -> list[str]:
    if scope not in SCOPES:
        raise ValueError(f"unknown validation scope: {scope}")
    return [s for s, asset in ASSETS.items() if asset.startswith(SCOPES[scope])]
