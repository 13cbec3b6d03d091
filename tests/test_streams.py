from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from rows import rows_of

from orefield.operators import alerts
from orefield.operators.quality.rules import rule
from orefield.plans import mergeable, transactions
from orefield.streaming import jobs
from orefield.streaming.runs import RunStore
from orefield.workload.tables import EVENTS_NOW


def arrive(lake, folder, first, last):
    """Land the raw rows of some days as one more file."""
    day = F.dayofmonth("timestamp")
    lake.raw_transactions.where((day >= first) & (day <= last)).coalesce(1).write.mode("append").parquet(folder)


def staged(spark, lake, folder):
    stream = jobs.file_stream(spark, folder, lake.raw_transactions.schema, files_per_trigger=1)
    return transactions.stage_transactions(stream, EVENTS_NOW)


def test_restarted_ingest_takes_each_file_once(spark, lake, folder):
    source, target, check = (f"{folder}/{n}" for n in ("in", "out", "check"))
    schema = lake.raw_transactions.schema
    for days in ((1, 10), (11, 31), None):
        if days:
            arrive(lake, source, *days)
        jobs.run_to_parquet(jobs.file_stream(spark, source, schema), target, check)
    assert spark.read.parquet(target).count() == lake.raw_transactions.count()


def test_mart_upsert_over_batches_and_replay(spark, lake, folder):
    source = f"{folder}/in"
    write = jobs.upsert_daily_mart(f"{folder}/staged", f"{folder}/mart")
    # the second and third batches touch days the first one had already
    for first, last in ((1, 12), (10, 20), (20, 31)):
        day = F.dayofmonth("timestamp")
        part = lake.raw_transactions.where((day >= first) & (day <= last))
        if first > 1:
            part = part.where(~((day <= last - 8) & (F.col("transaction_id") % 2 == 0)))
        part.coalesce(1).write.mode("append").parquet(source)
        jobs.run_batches(staged(spark, lake, source), write, f"{folder}/check")
    everything = transactions.stage_transactions(spark.read.parquet(source), EVENTS_NOW)
    want = transactions.daily_summary(transactions.daily_transactions(everything))
    mart = lambda: spark.read.parquet(f"{folder}/mart").select(*want.columns)
    assert rows_of(mart()) == rows_of(want)
    # a batch delivered again under its number changes nothing
    day = F.dayofmonth("timestamp")
    second = lake.raw_transactions.where((day >= 10) & (day <= 20)).where(~((day <= 12) & (F.col("transaction_id") % 2 == 0)))
    write(transactions.stage_transactions(second, EVENTS_NOW), 1)
    assert rows_of(mart()) == rows_of(want)


def test_gate_parts_rows(spark, lake, folder):
    arrive(lake, f"{folder}/in", 1, 31)
    stream = jobs.file_stream(spark, f"{folder}/in", lake.raw_transactions.schema)
    gate = jobs.quality_gate([rule("not_null", "transaction_id"), rule("between", "amount", min=0.01)], f"{folder}/out")
    jobs.run_batches(stream, gate, f"{folder}/check")
    out = spark.read.parquet(f"{folder}/out")
    good = lake.raw_transactions.where("transaction_id IS NOT NULL AND amount >= 0.01").count()
    assert out.where("passed = 'true'").count() == good
    assert out.count() == lake.raw_transactions.count()
    assert out.where("passed = 'false' AND size(broken_rules) = 0").count() == 0


@pytest.fixture(params=[1, 3, 20])
def batches(request, spark, lake, folder):
    """The events as 20 files, newest days first in name and time, some files for each batch."""
    day = F.dayofmonth("ts")
    events = lake.table("events")
    for i in range(20):
        part = events.where(F.pmod(31 - day, F.lit(20)) == i)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.file_stream(spark, f"{folder}/in", events.schema, files_per_trigger=request.param)
    return stream.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def test_revenue_holds_for_any_split(spark, lake, folder, batches):
    """Files come newest day first, so most rows are late: closed days are corrected, state stays small."""
    rows = transactions.stage_transactions(lake.transactions_of(batches), EVENTS_NOW)
    store = jobs.revenue_store(spark, f"{folder}/runs", fan=2)
    jobs.run_batches(rows, jobs.keep_in(lambda s: jobs.revenue_store(s, f"{folder}/runs", fan=2), jobs.revenue_parts), f"{folder}/check")
    got = jobs.daily_revenue(store.read())
    assert rows_of(got) == rows_of(lake.daily.select(*got.columns))
    found = store.manifest()
    assert sum(r["kind"] == "open" for r in found["runs"]) <= 2
    if found["batch"] > 10:
        last = lake.daily.agg(F.max("transaction_date")).first()[0]
        days = {r["day"] for r in store.read("open").select("day").collect()}
        assert found["late_rows"] > 0 and all((last - d).days <= 3 for d in days)


def test_days_close_in_order(spark, folder):
    """Days that come in order: open runs hold the last days only, closed ones each day once, late rows correct them."""
    store = jobs.revenue_store(spark, folder, fan=2)
    rows = lambda day, who: spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00", who, 5)], "t string, customer_id long, amount int").select(
        F.col("t").cast("timestamp_ntz").alias("transaction_timestamp"), "customer_id", F.col("amount").cast("decimal(18,2)").alias("amount"))
    for i in range(24):
        store.add(i, jobs.revenue_parts(rows(1 + i // 2, i % 2)))
    open_days = {r["day"].day for r in store.read("open").collect()}
    assert min(open_days) >= 9 and store.manifest()["late_rows"] == 0
    closed = store.read("closed").where("what = 'sums'").select("day").collect()
    assert len(closed) == len(set(closed)) and {r["day"].day for r in closed} >= set(range(1, 9))
    store.add(24, jobs.revenue_parts(rows(1, 7).union(rows(1, 0))))
    first = jobs.daily_revenue(store.read()).orderBy("transaction_date").first()
    assert tuple(first)[1:] == (4, 20, 3) and store.manifest()["late_rows"] > 0
    assert {r["day"].day for r in store.read("open").collect()} == open_days


def test_many_batches_meet_few_runs(spark, folder):
    """50 batches of the same days: runs are bounded, results exact, what is superseded goes."""
    store = RunStore(spark, folder, mergeable.merged_days, fan=3)
    one = lambda i: spark.createDataFrame([("2024-01-01 00:00:00", i % 7, i, 2.0, 3), ("2024-01-02 00:00:00", None, 40_000 * i, None, 3)],
        "t string, customer_id long, product_id long, amount double, quantity int").select(
        F.col("t").cast("timestamp_ntz").alias("transaction_timestamp"), "customer_id", "product_id", F.col("amount").cast("decimal(18,2)").alias("amount"), "quantity")
    for i in range(50):
        runs = store.add(i, mergeable.summary_parts(one(i)))["runs"]
        assert len(runs) <= 2 * 4, i
        store.expire()
    got = rows_of(mergeable.daily_summary(store.read()).drop("date"))
    assert set(got) == {(50, None, None, None, 0, 50), (50, Decimal("300.00"), Decimal("100.00"), 2.0, 7, 50)}
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/runs").count()
    assert held < 60
    # delivered again, or half done before: nothing changes
    store.add(49, mergeable.summary_parts(one(49)))
    assert rows_of(mergeable.daily_summary(store.read()).drop("date")) == got


def test_a_failed_batch_starts_from_the_manifest_before(spark, folder, monkeypatch):
    store = RunStore(spark, folder, mergeable.merged_days, fan=2)
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1, 1, 2.0, 3)], "t string, customer_id long, product_id long, amount double, quantity int")
    parts = mergeable.summary_parts(rows.withColumn("transaction_timestamp", F.col("t").cast("timestamp_ntz")).withColumn("amount", F.col("amount").cast("decimal(18,2)")))
    store.add(0, parts)
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.add(1, parts)
    monkeypatch.setattr(store, "_publish", publish)
    assert mergeable.daily_summary(store.read()).first()["total_transactions"] == 1
    store.add(1, parts)
    assert mergeable.daily_summary(store.read()).first()["total_transactions"] == 2


def test_bitmaps_count_negative_and_far_ids(spark):
    ids = [0, -1, 1, 32768, 32769, -32768, 10**12, None, 1]
    rows = spark.createDataFrame([(f"2024-01-01 00:00:0{i}", x) for i, x in enumerate(ids)], "t string, c long").withColumn("day", F.lit("2024-01-01").cast("date"))
    half = [mergeable.day_parts(rows.where(F.substring("t", 19, 1).cast("int") % 2 == k), F.col("day"), {"n": F.count("*")}, ["c"]) for k in (0, 1)]
    merged = mergeable.merged_days(half[0].unionByName(half[1]))
    assert merged.groupBy("day").agg(mergeable.distinct_of("c").alias("n")).first()["n"] == 7


def test_alerts_hold_for_any_split(spark, lake, folder, batches):
    keys = ["dag_id", "title"]
    found, whole = lake.alerts_of(batches), lake.alerts_of(lake.events)
    store = lambda s: jobs.burst_store(s, f"{folder}/runs", keys, fan=2)
    jobs.run_batches(found, jobs.keep_in(store, jobs.dedup_parts(keys)), f"{folder}/check")
    got = jobs.deduplicated_alerts(store(spark).read(), keys)
    want = alerts.deduplicate(whole, keys)
    assert rows_of(got, "id") == rows_of(want, "id") and got.count() > whole.select(*keys).distinct().count()
    if store(spark).manifest()["batch"] > 10:
        # What is open lies within the delay and the gap of the last alert, and is one burst for each key in each run.
        last = whole.agg(F.max("created_at")).first()[0]
        rows = store(spark).read("open").collect()
        assert all((last - r["last"]).total_seconds() <= 3600 + 900 + 86400 for r in rows)


def test_late_alert_joins_two_bursts(spark, folder):
    keys = ["k"]
    rows = lambda *at: spark.createDataFrame([("a", f"2024-01-{d:02d} {t}", i) for i, (d, t) in enumerate(at)], "k string, t string, id int").select(
        "k", F.col("t").cast("timestamp_ntz").alias("created_at"), "id")
    store = jobs.burst_store(spark, folder, keys, fan=2)
    reduce = lambda r: alerts.alert_slices(r, keys).drop("slice")
    store.add(0, reduce(rows((1, "10:00:00"), (1, "10:20:00"))))
    store.add(1, reduce(rows((2, "10:00:00"))))
    store.add(2, reduce(rows((3, "10:00:00"))))
    assert store.read().count() == 4 and store.read("open").count() <= 2
    store.add(3, reduce(rows((1, "10:10:00"))))
    starts = rows_of(jobs.deduplicated_alerts(store.read(), keys), "created_at")
    assert [str(x[0]) for x in sorted(starts)] == ["2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-03 10:00:00"]


def test_windows_hold_for_replays(spark, lake, folder):
    store, rows = jobs.window_store(spark, folder, fan=2), lake.alerts
    for number, part in ((0, "id % 2 = 0"), (1, "id % 2 = 1"), (1, "id % 2 = 1")):
        store.add(number, alerts.window_counts(rows.where(part)))
    assert rows_of(alerts.summed_windows(store.read(), 2)) == rows_of(alerts.window_summary(rows, limit=2))
