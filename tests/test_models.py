import random
from collections import defaultdict
from datetime import date
from decimal import Decimal

from rows import rows_of
from pyspark.sql import functions as F

from orefield.operators.latest import first_per_key, insert_absent, upsert
from orefield.plans import customers, incremental, sales, snapshots, transactions, users
from orefield.workload.tables import EVENTS_NOW

RAW = "transaction_id bigint, customer_id bigint, product_id bigint, amount double, currency string, quantity int, timestamp string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_staging_keeps_only_valid_rows(spark):
    df = raw(
        spark,
        (1, 1, 1, 10.0, " usd ", 1, "2024-01-01T10:00:00Z"),
        (None, 1, 1, 10.0, "usd", 1, "2024-01-01T10:00:00Z"),
        (2, 1, 1, 0.0, "usd", 1, "2024-01-01T10:00:00Z"),
        (3, 1, 1, 5.0, "usd", 0, "2024-01-01T10:00:00Z"),
        (4, 1, 1, None, "usd", 1, "2024-01-01T10:00:00Z"),
        (5, 1, 1, 5.0, "EUR", 2, "1704103200"),
    )
    staged = transactions.stage_transactions(df, EVENTS_NOW)
    assert rows_of(staged, "transaction_id", "currency", "amount") == [
        (1, "USD", Decimal("10.00")), (5, "EUR", Decimal("5.00")),
    ]
    assert {r["transaction_timestamp"].hour for r in staged.collect()} == {10}


def test_enrichment_edges(spark):
    times = ["2024-01-07T08:59:59Z", "2024-01-07T09:00:00Z", "2024-01-08T17:59:59Z", "2024-01-08T18:00:00Z"]
    df = raw(spark, *[(i, 1, 1, 100.0 + (i == 3), "usd", 2, t) for i, t in enumerate(times)])
    out = transactions.enrich_transactions(transactions.stage_transactions(df, EVENTS_NOW))
    got = rows_of(out, "transaction_id", "time_category", "transaction_day_of_week", "is_high_value")
    assert got == [
        (0, "off_hours", 0, False), (1, "business_hours", 0, False),
        (2, "business_hours", 1, False), (3, "off_hours", 1, True),
    ]


def daily(lake, until=None):
    rows = lake.raw_transactions
    if until:
        rows = rows.where(F.col("timestamp") < F.lit(until).cast("timestamp_ntz"))

    def build(since):
        staged = transactions.stage_transactions(rows, EVENTS_NOW)
        if since is not None:
            staged = staged.where(F.col("transaction_timestamp") >= F.lit(since).cast("timestamp_ntz"))
        return transactions.daily_summary(transactions.daily_transactions(staged))

    return build


def test_incremental_runs_equal_a_full_load(spark, lake, folder):
    for until in ["2024-01-05 12:00:00", "2024-01-05 18:00:00", "2024-01-20 03:00:00", None, None]:
        incremental.refresh_by_date(spark, f"{folder}/inc", daily(lake, until))
    incremental.refresh_by_date(spark, f"{folder}/full", daily(lake), full_refresh=True)
    columns = lake.daily_summary.columns
    one, two = (rows_of(spark.read.parquet(f"{folder}/{p}"), *columns) for p in ("inc", "full"))
    assert one == two == rows_of(lake.daily_summary, *columns)


def test_late_rows_wait_for_lookback_or_full_refresh(spark, lake, folder):
    early = F.col("timestamp") < F.lit("2024-01-03").cast("timestamp_ntz")
    missing = lake.raw_transactions.where(~early)

    def build(rows):
        def at(since):
            staged = transactions.stage_transactions(rows, EVENTS_NOW)
            if since is not None:
                staged = staged.where(F.col("transaction_timestamp") >= F.lit(since).cast("timestamp_ntz"))
            return transactions.daily_summary(transactions.daily_transactions(staged))

        return at

    incremental.refresh_by_date(spark, folder, build(missing))
    days = lambda: spark.read.parquet(folder).select("date").distinct().count()
    before = days()
    incremental.refresh_by_date(spark, folder, build(lake.raw_transactions))
    assert days() == before
    incremental.refresh_by_date(spark, folder, build(lake.raw_transactions), lookback_days=60)
    assert days() == before + 2


def test_first_per_key_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randrange(1000), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    expected = defaultdict(list)
    for k, v, i in rows:
        expected[k].append((-v, i))
    want = sorted((k, -v, i) for k, found in expected.items() for v, i in sorted(found)[:2])
    got = first_per_key(df, ["k"], [F.desc("v"), F.asc("i")], 2)
    assert rows_of(got) == sorted(want, key=repr)


def test_upsert_is_idempotent_and_changes_win_ties(spark):
    schema = "k string, v int, at int"
    current = spark.createDataFrame([("a", 1, 1), ("b", 2, 5)], schema)
    changes = spark.createDataFrame([("a", 9, 1), ("b", 0, 4), ("c", 3, 1)], schema)
    once = upsert(current, changes, ["k"], ["at"])
    assert rows_of(once) == [("a", 9, 1), ("b", 2, 5), ("c", 3, 1)]
    assert rows_of(upsert(once, changes, ["k"], ["at"])) == rows_of(once)
    fresh = insert_absent(current, changes, ["k"])
    assert rows_of(fresh, "k") == [("c",)]


def test_silver_keeps_first_and_drops_null_email(spark):
    rows = [(1, "a@x", 5.0, "2024-01-02"), (1, "b@x", 6.0, "2024-01-01"), (2, None, 1.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "id int, email string, amount double, created_at string")
    assert rows_of(users.clean_to_silver(df, ["created_at"]), "id", "email") == [(1, "b@x")]
    assert tuple(users.cleaning_report(df).first()) == (3, 1, 2)


def test_every_customer_appears_with_orders_or_once(spark):
    who = spark.createDataFrame([("c1", "A"), ("c2", "B")], "customer_id string, full_name string")
    orders = spark.createDataFrame(
        [("c1", 1, 5.0), ("c1", 2, 6.0), ("zz", 3, 7.0)], "customer_id string, order_id int, total_amount double"
    ).withColumns({"order_date": F.lit("2024-01-01").cast("date"), "status": F.lit("open")})
    got = customers.customer_orders(who, orders)
    left = who.join(orders, "customer_id", "left").select(*got.columns)
    assert rows_of(got) == rows_of(left) and got.count() == 3


def test_tiers(spark):
    who = spark.createDataFrame([(f"c{i}",) for i in range(4)], "customer_id string").withColumns(
        {c: F.lit("x") for c in ("full_name", "email")} | {"created_date": F.lit("2024-01-01").cast("date"), "is_active": F.lit(True)}
    )
    orders = spark.createDataFrame(
        [("c0", 1, Decimal("999.99")), ("c1", 2, Decimal("1000")), ("c2", 3, Decimal("500"))],
        "customer_id string, order_id int, total_amount decimal(18,2)",
    ).withColumn("order_date", F.lit("2024-01-01").cast("date"))
    dim = customers.dim_customers(who, orders)
    assert rows_of(dim, "customer_id", "customer_tier", "total_orders") == [
        ("c0", "Silver", 1), ("c1", "Gold", 1), ("c2", "Silver", 1), ("c3", "Bronze", 0),
    ]


def test_calendar_comparison_skips_leap_day(spark):
    days = [date(2023, 2, 28), date(2023, 3, 1), date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d date, v int")
    got = dict((r[0], r[2]) for r in sales.calendar_year_comparison(df, "d", "v").collect())
    assert got == {days[0]: None, days[1]: None, days[2]: 0, days[3]: None, days[4]: 1}


def test_snapshots_fold_like_the_full_history(spark):
    rng = random.Random(3)
    per_day = {d: {k: rng.choice("xyz") for k in range(6) if rng.random() < 0.8} for d in range(1, 9)}
    rows = [(k, v, date(2024, 1, d), d) for d, states in per_day.items() for k, v in states.items()]
    versions = spark.createDataFrame(rows, "k int, tier string, day date, n int")
    whole = snapshots.slowly_changing(versions, ["k"], ["tier"], "day", ["n"])
    schema = "k int, tier string, valid_from date, valid_to date, is_current boolean"
    state = spark.createDataFrame([], schema)
    for d, states in per_day.items():
        new = spark.createDataFrame(list(states.items()), "k int, tier string")
        folded = snapshots.apply_snapshot(state, new, ["k"], ["tier"], f"2024-01-0{d}")
        state = spark.createDataFrame(folded.select(*state.columns).collect(), schema)
    assert rows_of(state) == rows_of(whole.select(*state.columns))
