import random
from datetime import datetime, timedelta

import pytest
from rows import rows_of
from pyspark.sql import functions as F

from orefield.operators import alerts, bi, freshness, governance, health, lineage, runs, skew, volume

NOW = "2024-01-10 12:00:00"
START = datetime(2024, 1, 1)


def test_freshness_limits(spark, ts):
    ledger = ts(
        [("a", "success", "2024-01-09 12:00:00", 5), ("b", "success", "2024-01-09 11:00:00", 5),
         ("c", "failed", "2024-01-10 11:00:00", 5)],
        "source_name string, status string, updated_at string, row_count long", "updated_at",
    )
    one = freshness.source_freshness(ledger, NOW)
    assert rows_of(one, "source_name", "staleness_hours", "is_fresh") == [
        ("a", 24.0, True), ("b", 25.0, False), ("c", None, False),
    ]
    with pytest.raises(freshness.StaleError, match=r"2 stale sources: c \(never loaded\), b \(25.0h\)"):
        freshness.require_fresh(one)
    freshness.require_fresh(one.where("is_fresh"))
    marks = ts([("m", "ts", "2024-01-10 12:00:00")], "source_name string, watermark_column string, updated_at string", "updated_at")
    runs_ = ts(
        [("mart_x", "marts.x", True, "2024-01-10 06:00:00"), ("staging_y", "s.y", False, NOW)],
        "expectation_suite_name string, data_asset_name string, success boolean, validation_time string",
        "validation_time",
    )
    swept = freshness.sweep(ledger, marks, runs_, NOW)
    # here the limit itself is stale already, and an age of zero is kept
    assert rows_of(swept, "source_name", "layer", "staleness_hours", "is_fresh") == [
        ("a", "raw", 24.0, False), ("b", "raw", 25.0, False), ("m.ts", "raw", 0.0, True),
        ("marts.x", "marts", 6.0, False),
    ]
    summary = freshness.layer_summary(swept, shown=1)
    assert rows_of(summary, "layer", "total", "fresh", "stale", "stale_sources") == [
        ("marts", 1, 0, 1, "marts.x"), ("raw", 3, 1, 2, "b"), ("staging", 0, 0, 0, ""),
    ]


def test_freshness_states(spark, ts):
    state = lambda t: freshness.freshness_state(ts([(t,)], "t string", "t"), "t", NOW).first()["state"]
    assert [state(t) for t in ("2024-01-09 12:00:00", "2024-01-09 11:59:59", "2024-01-08 11:00:00", None)] == [
        "pass", "warn", "error", "error",
    ]


@pytest.fixture
def tasks(ts):
    def make(rows):
        return ts(
            rows,
            "run_id int, dag_id string, task_id string, state string, start_date string, end_date string",
            "start_date", "end_date",
        ).withColumn("execution_date", F.col("start_date"))

    return make


def test_sla_three_of_five(tasks):
    at = "2024-01-10 0{}:00:00"
    rows = [(i, "d", "t", "success", at.format(i), at.format(i + 1)) for i in range(3)]
    rows += [(i, "d", "t", "failed", at.format(i), at.format(i + 2)) for i in (4, 5)]
    rows += [(9, "d", "t", "running", at.format(7), None)]
    got = runs.sla_check(tasks(rows), NOW, expected_minutes=60)
    assert rows_of(got) == [("d", "t", 5, 3, 2, 60.0)]
    delays = runs.sla_rows(tasks(rows), NOW).first()
    assert (delays["sla_met"], delays["delay_seconds"]) == (False, 3600)


def test_all_runs_of_the_window_count(tasks):
    rows = []
    for i in range(14):
        start = datetime(2024, 1, 10) + timedelta(minutes=i)
        rows.append((i, "d", "t", "success", str(start), str(start + timedelta(minutes=1 if i > 3 else 90))))
    assert rows_of(runs.sla_check(tasks(rows), NOW)) == [("d", "t", 14, 10, 4, 71.43)]
    assert rows_of(runs.sla_check(tasks(rows), NOW, last_runs=10)) == [("d", "t", 10, 10, 0, 100.0)]


def test_tracking_keeps_the_expected_completion(tasks, spark):
    at = "2024-01-10 0{}:00:00"
    rows = runs.sla_rows(tasks([(1, "d", "t", "success", at.format(1), at.format(3)), (2, "e", "t", "success", at.format(1), at.format(2))]), NOW)
    old = rows.where("dag_id = 'd'").withColumns(
        {"expected_completion": F.col("expected_completion") - F.expr("INTERVAL 5 MINUTES"), "sla_met": F.lit(True), "delay_seconds": F.lit(0)}
    )
    other = old.withColumn("dag_id", F.lit("gone"))
    got = {r["dag_id"]: r for r in runs.track_sla(old.unionByName(other), rows).collect()}
    assert set(got) == {"d", "e", "gone"} and not got["d"]["sla_met"] and got["d"]["delay_seconds"] == 3600
    assert got["d"]["expected_completion"] == old.first()["expected_completion"] != rows.where("dag_id = 'd'").first()["expected_completion"]
    assert got["e"]["sla_met"] and got["gone"]["sla_met"]


def test_whole_dags_have_their_own_key(tasks):
    at = "2024-01-10 0{}:00:00"
    whole = runs.dag_runs_as_tasks(tasks([(1, "d", "x", "success", at.format(1), at.format(3))]).drop("task_id"))
    assert rows_of(runs.sla_check(whole, NOW, 90)) == [("d", "__dag__", 1, 0, 1, 0.0)]


def test_time_used_by_running_tasks(tasks):
    rows = tasks([(1, "d", "t", "running", "2024-01-10 09:00:00", None), (2, "d", "t", "success", "2024-01-10 09:00:00", "2024-01-10 10:00:00")])
    assert rows_of(runs.sla_time_used(rows, "2024-01-10 12:00:00", 240), "run_id", "percent_used") == [(1, 75.0)]


def test_failure_rates_and_snapshot(tasks, spark, ts):
    rows = [(i, f"d{i % 2}", "t", s, "2024-01-10 11:30:00", None) for i, s in enumerate(["failed", "success", "failed", "queued"])]
    rows.append((9, "d9", "t", "running", "2024-01-01 00:00:00", None))
    df = tasks(rows)
    assert rows_of(runs.failures_by_dag(df, NOW)) == [("d0", 2, 100.0)]
    rate = runs.failure_rate(df, NOW).first()
    assert (rate["failure_rate_percent"], rate["failure_issue"], rate["queue_issue"]) == (50.0, True, False)
    assert tuple(runs.queue_snapshot(df, NOW).first()) == (1, 1, 0)
    misses = ts([("2024-01-10 00:00:00",)] * 30, "timestamp string", "timestamp")
    snap = runs.task_snapshot(df, misses, NOW).first()
    assert (snap["failed_tasks_24h"], snap["running_tasks"], snap["queued_tasks"]) == (2, 1, 1)
    assert (snap["sla_misses_24h"], snap["sla_compliance"], snap["heartbeat_age_seconds"]) == (30, 25.0, 1800)
    nothing = runs.task_snapshot(df.where("false"), misses, NOW).first()
    assert (nothing["failure_rate"], nothing["sla_compliance"]) == (0.0, 100.0)


def ledger_of(spark, *rows):
    return spark.createDataFrame(
        [(s, n, d, "success") for s, n, d in rows], "source_name string, row_count long, execution_date string, status string"
    )


def test_volume_anomalies(spark):
    log = ledger_of(spark, *[(s, 100, "2024-01-09") for s in "abcd"], ("a", 100, "2023-01-01"))
    current = spark.createDataFrame(
        [("a", 105), ("b", 180), ("c", 150), ("d", 0), ("new", 7)], "source_name string, current_count long"
    )
    got = volume.volume_anomaly(current, log, NOW)
    assert rows_of(got, "source_name", "deviation_percent", "is_anomaly", "sample_count") == [
        ("a", 5.0, False, 1), ("b", 80.0, True, 1), ("c", 50.0, False, 1), ("d", 100.0, True, 1),
        ("new", None, False, 0),
    ]
    sweep = volume.volume_sweep(ledger_of(spark, *[("a", n, "2024-01-09") for n in (10, 90)], ("b", 0, "2024-01-09"), ("c", 5, "2024-01-09")), NOW)
    assert rows_of(sweep, "source_name", "is_anomaly") == [("a", True), ("b", True), ("c", False)]


def test_no_health_rows_gives_the_default(lake):
    row = health.latest_score(lake.health.where("false")).first()
    assert row["health_score"] == 100 and row["metric_time"] is None


# -- alerts --------------------------------------------------------------------------------------------


def test_dedup_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"dag_{rng.randrange(12)}"
        rows.append((i, key, START + timedelta(seconds=rng.randrange(6 * 86400), microseconds=rng.randrange(10**6))))
    # exact gaps of the window, and equal times
    edge = START + timedelta(days=9)
    rows += [(5000 + n, "edge", edge + timedelta(minutes=15 * n)) for n in range(3)]
    rows += [(6000, "edge2", edge), (6001, "edge2", edge), (6002, "edge2", edge + timedelta(minutes=15, microseconds=1))]
    expected, last = [], {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] > timedelta(minutes=15):
            expected.append((key, i))
        last[key] = at
    df = (
        spark.createDataFrame([(i, k, str(t)) for i, k, t in rows], "id int, dag_id string, created_at string")
        .withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"), "is_retry": F.lit(False)})
        .repartition(7)
    )
    assert rows_of(alerts.deduplicate(df, ["dag_id"]), "dag_id", "id") == sorted(expected, key=repr)


def test_retries_and_excluded_dags_stay_out(spark):
    df = spark.createDataFrame(
        [(1, "a", False), (2, "b", True), (3, "example_monitoring", False)], "id int, dag_id string, is_retry boolean"
    ).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))
    assert rows_of(alerts.deduplicate(df, ["dag_id"]), "id") == [(1,)]


def test_fields_with_a_repeated_title_keep_the_last(spark):
    text = '[{"title":"DAG","value":"d"},{"title":"Try Number","value":"1"},{"title":"Try Number","value":"2"},{"title":"Log URL","value":null}]'
    df = spark.createDataFrame([(text,), ("[]",), (None,)], "fields string")
    got = [(r["dag_id"], r["task_id"], r["metadata"]) for r in alerts.parse_fields(df).collect()]
    assert got[0] == ("d", None, {"try_number": "2", "log_url": None})
    assert got[1] == (None, None, {}) and got[2] == (None, None, None)


def test_subject_is_cut_for_display_only(spark):
    df = spark.createDataFrame([(1, "SLA " + "x" * 900, "HIGH", "[]", None)], "id int, title string, severity string, fields string, created_at string")
    row = alerts.alert_rows(df).select("*", alerts.shown_subject()).first()
    assert len(row["subject"]) == 904 and len(row["subject_shown"]) == 500 and row["alert_type"] == "sla_miss" and row["severity"] == "high"


def test_routing_suppression_escalation(spark, ts):
    df = ts(
        [(1, "dbt_transform", "low", "2024-01-10 11:00:00", False), (2, "my_dbt_transform", "critical", "2024-01-10 11:50:00", False),
         (3, "x", "medium", "2024-01-10 11:00:00", False), (4, "x", "critical", "2024-01-10 11:45:00", False),
         (5, "x", "low", "2020-01-01 00:00:00", False), (6, "x", "high", "2020-01-01 00:00:00", True)],
        "id int, dag_id string, severity string, created_at string, acknowledged boolean", "created_at",
    )
    routed = {r["id"]: (r["channels"], r["routed_severity"]) for r in alerts.route(df).collect()}
    assert routed[1] == ("slack,email", "HIGH") and routed[2] == ("slack,email", "CRITICAL")
    assert routed[3] == ("slack", "MEDIUM")
    hidden = alerts.suppress_below(df, "HIGH").where("suppressed")
    assert rows_of(hidden, "id") == [(1,), (3,), (5,)]
    assert rows_of(alerts.to_escalate(df, NOW), "id") == []
    assert rows_of(alerts.to_escalate(df, "2024-01-10 12:00:01"), "id") == [(3,), (4,)]


def test_quality_alert_severity(spark):
    df = spark.createDataFrame(
        [("marts", 0, 10), ("raw", 6, 10), ("raw", 5, 10), ("raw", 2, 10), ("raw", 0, 0)], "l string, f int, t int"
    )
    got = df.select(alerts.quality_alert_severity(F.col("l"), F.col("f"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == ["CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "MEDIUM"]


# -- governance ------------------------------------------------------------------------------------------


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def test_reachability_ends_on_cycles_and_takes_fewest_hops(spark):
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y"), ("s", "s"))
    roots = spark.createDataFrame([("a",), ("s",)], "root string")
    assert rows_of(lineage.reachable(edges, roots)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    up = spark.createDataFrame([("d",)], "root string")
    assert rows_of(lineage.reachable(edges, up, upstream=True)) == [("d", "a", 2), ("d", "b", 2), ("d", "c", 1)]
    assert rows_of(lineage.reachable(edges, up, upstream=True, max_hops=1)) == [("d", "c", 1)]
    assert rows_of(lineage.reachable(edges, up)) == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """4,000 nodes in a row, with a way back and a short cut: 14 rounds at most, hops exact."""
    n, written, rounds = 4000, lineage._written, []
    monkeypatch.setattr(lineage, "_written", lambda rows, path: rounds.append(path) or written(rows, path))
    chain = spark.range(n - 1).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    more = spark.createDataFrame([(str(n - 1), "0"), ("10", "2000")], "source string, target string")
    found = lineage.reachable(chain.union(more), spark.createDataFrame([("0",)], "root string"))
    want = {i: i if i < 2000 or i < 11 else 11 + i - 2000 for i in range(1, n)}
    assert {int(r["node"]): r["hops"] for r in found.collect()} == want
    assert sum("round=" in x for x in rounds) - 1 <= 14


def test_doubling_equals_breadth_first(spark):
    rng = random.Random(9)
    for _ in range(3):
        pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
        want = set()
        for root in ("n0", "n1", "n2"):
            seen, front, hops = {root}, {root}, 0
            while front:
                front, hops = {b for a, b in pairs if a in front} - seen, hops + 1
                seen |= front
                want |= {(root, x, hops) for x in front}
        roots = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "root string")
        assert set(rows_of(lineage.reachable(edges_of(spark, *pairs), roots))) == want
        assert set(rows_of(lineage.reachable(edges_of(spark, *pairs), roots, max_hops=3))) == {x for x in want if x[2] <= 3}


def test_medallion_lineage(spark):
    edges = lineage.medallion_edges(spark)
    assert edges.count() == 10
    roots = spark.createDataFrame([("raw",)], "root string")
    reached = lineage.reachable(edges, roots)
    assert reached.count() == 10
    assert reached.where(F.col("node").endswith("_dashboard")).count() == 3


def test_ownership_equals_the_either_end_join(spark):
    rng = random.Random(7)
    name = lambda: f"d{rng.randrange(8)}"
    owner_rows = [(f"d{i}", "s", *["x"] * 8, True) for i in range(8)]
    owners = spark.createDataFrame(
        owner_rows, ", ".join(f"{c} string" for c in governance.OWNER_COLUMNS[:-1]) + ", pii_flag boolean"
    )
    asked = [(i, name(), "s", rng.choice(["approved", "pending"])) for i in range(60)]
    requests = spark.createDataFrame(asked, "id int, dataset_name string, schema_name string, status string")
    linked = [(i, "d0" if i % 3 == 0 else name(), "s", name(), rng.choice(["s", "other"])) for i in range(90)]
    edges = spark.createDataFrame(
        linked, "id int, source_name string, source_schema string, target_name string, target_schema string"
    )
    got = governance.active_ownership(owners, requests, edges)
    want = []
    for d in {r[0] for r in owner_rows}:
        grants = sum(1 for r in asked if r[1] == d and r[3] == "approved")
        ends = sum(1 for e in linked if (e[1] == d and e[2] == "s") or (e[3] == d and e[4] == "s"))
        want.append((d, grants, ends))
    assert rows_of(got, "dataset_name", "active_access_grants", "lineage_connections") == sorted(want, key=repr)


def test_qualified_names(spark):
    df = spark.createDataFrame([("table", "s", "n"), ("container", "s", "n"), ("dashboard", "s", "n"), ("odd", "s", "n"), ("table", "s", "")], "k string, s string, n string")
    got = [r[0] for r in df.select(lineage.qualified_name(F.col("k"), F.col("s"), F.col("n"))).collect()]
    assert got == [f"{lineage.WAREHOUSE_SERVICE}.s.n", f"{lineage.OBJECT_SERVICE}.n", "superset.n", "s.n", None]


def test_metadata_quality_floor_and_status(spark):
    tables = spark.createDataFrame([(f"t{i}", "s") for i in range(5)], "table_name string, schema_name string")
    columns = spark.createDataFrame([("c", None)] * 10 + [("c", "text")], "column_name string, description string")
    owners = lambda n: spark.createDataFrame([(f"t{i}", "s") for i in range(n)], "dataset_name string, schema_name string")
    score = lambda n, errors=0: tuple(governance.metadata_quality(tables, columns, owners(n), errors).select("quality_score", "overall_status").first())
    assert score(5) == (95.0, "healthy") and score(5, 1) == (95.0, "warning") and score(5, 6) == (95.0, "critical")
    assert score(2) == (80.0, "healthy") and score(1) == (75.0, "warning")
    many = spark.range(300).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("table_name"), F.lit("s").alias("schema_name"))
    assert governance.metadata_quality(many, columns, owners(5)).first()["quality_score"] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(0, 101)], "v double")
    got = dict(rows_of(bi.histogram(df, "v", 10)))
    assert got == {**{b: 10 for b in range(9)}, 9: 11}
    same = spark.createDataFrame([(5,), (5,), (None,)], "v int")
    assert rows_of(bi.histogram(same, "v", 10)) == [(0, 2)]


def test_last_month_is_half_open(spark):
    df = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-04-01')) AS d")
    row = bi.last_month(df, "d", "2024-03-31").agg(F.min("d").cast("string"), F.max("d").cast("string")).first()
    assert tuple(row) == ("2024-02-29", "2024-03-30")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_keys_are_dealt_out(spark, how):
    """A key with half the rows, a null key, keys on one side only: the rows of the plain join, none in one task."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 != 3, F.col("id") % 500).alias("k"), F.col("id").alias("v")
    )
    small = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).union(spark.createDataFrame([(7, 1)], "k long, w long"))
    assert set(skew.heavy_keys(rows, "k", 0.2)) == {7}
    found = skew.heavy_join(rows, small, "k", how, parts=8)
    assert rows_of(found) == rows_of(rows.join(small, "k", how))
    if how in ("inner", "left"):
        before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
        try:
            for n, v in zip(before, ("false", "-1"), strict=True):
                spark.conf.set(n, v)
            sizes = [r["count"] for r in skew.heavy_join(rows, small, "k", how, parts=8).groupBy(F.spark_partition_id()).count().collect()]
            plain = [r["count"] for r in rows.join(small, "k", how).groupBy(F.spark_partition_id()).count().collect()]
        finally:
            for n, v in before.items():
                spark.conf.set(n, v)
        assert max(sizes) < 0.6 * max(plain)


def test_heavy_join_refuses_other_kinds(spark):
    one = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        skew.heavy_join(one, one, "k", "full")
    assert skew.heavy_join(one.where("k > 9"), one, "k").count() == 0
