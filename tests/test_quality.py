import random

import pytest
from rows import rows_of
from pyspark.sql import functions as F

from orefield.operators.quality import history, suites, validation
from orefield.operators.quality.rules import evaluate, repeated_values, rule


def outcome(df, *rules):
    columns = ["rule_no", "success", "element_count", "unexpected_count"]
    return [tuple(r) for r in evaluate(df, list(rules)).orderBy("rule_no").select(*columns).collect()]


def test_shipped_suites_have_their_rules():
    sizes = {name: len(rules) for name, rules in suites.SUITES.items()}
    assert list(sizes.values()) == [22, 18, 17, 15, 13, 12, 14]
    assert sum(sizes.values()) == 111


def test_scopes():
    assert len(suites.suites_in_scope("full")) == 7
    assert suites.suites_in_scope("raw_only") == [
        "raw_transactions_suite", "raw_customers_suite", "raw_products_suite",
    ]
    assert suites.suites_in_scope("staging_only") == ["staging_transactions_suite"]
    assert len(suites.suites_in_scope("marts_only")) == 3
    with pytest.raises(ValueError, match="scope"):
        suites.suites_in_scope("some")


def test_nulls_are_ignored_except_by_not_null(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (3, "zz"), (3, "b")], "v int, s string")
    assert outcome(
        df,
        rule("not_null", "v"),
        rule("unique", "v"),
        rule("between", "v", min=1, max=2),
        rule("between", "v", min=1, strict_min=True),
        rule("in_set", "s", values=["a", "b"]),
        rule("length_between", "s", max=1),
        rule("matches", "s", regex="^[ab]"),
        rule("row_count", min=4, max=4),
        rule("row_count", max=3),
    ) == [
        (1, False, 4, 1), (2, False, 4, 2), (3, False, 4, 2), (4, False, 4, 1), (5, False, 4, 1),
        (6, False, 4, 1), (7, False, 4, 1), (8, True, 4, None), (9, False, 4, None),
    ]


def test_missing_columns_fail_without_an_error(spark):
    df = spark.createDataFrame([(1,)], "v int")
    got = outcome(
        df, rule("not_null", "w"), rule("unique", "w"), rule("between", "w", min=1), rule("exists", "w"),
        rule("pair_at_least", "v", other="w"), rule("of_type", "w", type="integer"), rule("exists", "v"),
    )
    assert [g[1] for g in got] == [False] * 6 + [True]


def test_column_rules(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = outcome(
        df,
        rule("column_set", columns=["b", "a"]),
        rule("column_set", columns=["a"]),
        rule("column_set", columns=["a"], exact=False),
        rule("column_set", columns=["a", "b", "c"], exact=False),
        rule("column_list", columns=["a", "b"]),
        rule("column_list", columns=["b", "a"]),
        rule("of_type", "a", type="integer"),
    )
    assert [g[1] for g in got] == [True, False, True, False, True, False, True]


def test_empty_table(spark):
    df = spark.createDataFrame([], "v int")
    got = outcome(df, rule("row_count", min=1), rule("not_null", "v"), rule("unique", "v"))
    assert got == [(1, False, 0, None), (2, True, 0, 0), (3, True, 0, 0)]


def test_plug_in_rules(spark):
    df = spark.createDataFrame(
        [("10.5", "usd", "2024-01-10"), ("-1", "xyz", "2023-01-01"), ("abc", "JPY", "bad"), ("0", None, None)],
        "amount string, code string, at string",
    )
    assert outcome(
        df,
        rule("positive_amount", "amount"),
        rule("positive_amount", "amount", strictly_positive=False),
        rule("currency_code", "code"),
        rule("currency_code", "code", codes=["USD"]),
        rule("recent", "at", as_of="2024-01-12 00:00:00", max_age_days=5),
    ) == [(1, False, 4, 3), (2, False, 4, 2), (3, False, 4, 1), (4, False, 4, 2), (5, False, 4, 2)]
    with pytest.raises(ValueError, match="max_age_days"):
        evaluate(df, [rule("recent", "at", as_of="2024-01-12", max_age_days=0)])


def test_mostly_boundary(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "v int")
    at = lambda mostly: outcome(df, rule("between", "v", mostly=mostly, min=5))[0][1]
    assert at(0.95) and not at(0.951)


def test_suite_does_not_depend_on_partitioning(lake):
    one = validation.run_suite(lake.coded_transactions, "raw_transactions_suite")
    other = validation.run_suite(lake.coded_transactions.repartition(13), "raw_transactions_suite")
    assert rows_of(one) == rows_of(other)


def test_uniqueness_with_a_value_in_a_third_of_the_rows(spark):
    rng = random.Random(1)
    values = ["hot" if i % 3 == 0 else str(rng.randrange(3000)) for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(9)
    repeated = sum(1 for v in values if values.count(v) > 1)
    assert outcome(df, rule("unique", "v")) == [(1, False, 6000, repeated)]


def test_gates_raise_with_what_failed(spark):
    df = spark.createDataFrame([(None, 1)], "a int, b int")
    results = validation.run_suite(df, "mine", [rule("not_null", "a")] * 7 + [rule("not_null", "b")])
    with pytest.raises(validation.ValidationError, match=r"7 rules failed.*and 2 more"):
        validation.require_success(results)
    validation.require_success(results.where("success"))
    summary = validation.summarise(results).first()
    assert (summary["evaluated"], summary["successful"], float(summary["success_percent"])) == (8, 1, 12.5)


def test_scalar_checks(spark):
    checks = spark.createDataFrame([(0, 5, None)], "zero int, five int, nothing int")
    plain = dict(rows_of(validation.run_scalar_checks(checks), "check_name", "passed"))
    assert plain == {"zero": False, "five": True, "nothing": False}
    limited = validation.run_scalar_checks(checks, 0, 4)
    assert dict(rows_of(limited, "check_name", "passed")) == {"zero": True, "five": False, "nothing": False}
    with pytest.raises(validation.ValidationError, match=r"\(2/3\)"):
        validation.require_checks(limited)


def test_suite_names_on_model_columns(lake):
    mart = lake.customer_mart
    plain = validation.run_suite(mart, "mart_customer_analytics_suite").where("NOT success").count()
    named = validation.with_suite_names(mart, "mart_customer_analytics_suite")
    assert plain == 4
    assert validation.run_suite(named, "mart_customer_analytics_suite").where("NOT success").count() == 0


def test_marked_rows(spark):
    df = spark.createDataFrame([(1, 5), (None, -1), (2, None)], "id int, v int")
    rules = [rule("not_null", "id"), rule("between", "v", min=0)]
    got = validation.mark_rows(df, rules).select("broken_rules").collect()
    assert [r[0] for r in got] == [[], ["not_null:id", "between:v"], []]
    with pytest.raises(ValueError, match="unique"):
        validation.mark_rows(df, [rule("unique", "id")])


@pytest.mark.parametrize(
    ("percent", "severity"),
    [(49.99, "critical"), (50.0, "high"), (74.99, "high"), (75.0, "medium"), (89.99, "medium"), (90.0, "low")],
)
def test_failure_severity_steps(spark, percent, severity):
    df = spark.range(1).select(history.severity_of_percent(F.lit(percent)).alias("s"))
    assert df.first()["s"] == severity


def test_daily_metrics_mean_is_exact(spark):
    rows = [(d, "raw_x", True, 3, 2, 66.67) for d in ("2024-01-01",) * 3] + [("2024-01-01", "raw_x", False, 3, 0, 0.0)]
    df = spark.createDataFrame(
        rows, "execution_date string, expectation_suite_name string, success boolean, "
        "total_expectations int, successful_expectations int, success_percent double"
    ).withColumn("success_percent", F.col("success_percent").cast("decimal(5,2)"))
    row = history.daily_metrics(df).first()
    assert (row["layer"], row["total_validations"], row["avg_success_percent"]) == ("raw", 4, 50.0)


def test_wide_values_are_counted_by_hashes_first(spark):
    """Text of 2 kB that is nearly unique: the exchange over all rows carries hashes, and counts are exact."""
    text = F.rpad(F.concat(F.lit("v"), F.when(F.col("id") % 100 == 1, 5).otherwise(F.col("id")).cast("string")), 2000, "x")
    rows = spark.range(3000).select(F.when(F.col("id") != 17, text).alias("t"), F.struct(F.col("id") % 2999).alias("s"))
    for column, want in (("t", 31), ("s", 2)):
        assert repeated_values(rows, column).first()["u"] == want
    plan = repeated_values(rows, "t")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any("hashpartitioning(h" in x for x in exchanges)
    assert repeated_values(rows.limit(0), "t").first()["u"] == 0
