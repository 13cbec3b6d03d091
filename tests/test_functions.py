import hashlib
from datetime import datetime

import pytest
from rows import rows_of
from pyspark.sql import functions as F

from orefield import functions as fn

NEW_YEAR = datetime(2021, 1, 1)


@pytest.mark.parametrize(
    ("literal", "dtype"),
    [
        ("1609459200", "bigint"),
        ("1609459200", "int"),
        ("1609459200", "string"),
        (" 1609459200.0 ", "string"),
        ("2021-01-01T00:00:00Z", "string"),
        ("2021-01-01 00:00:00", "string"),
        ("2021-01-01", "date"),
        ("2021-01-01 00:00:00", "timestamp_ntz"),
        ("2021-01-01 00:00:00", "timestamp"),
        ("1609459200.0", "double"),
        ("1609459200.0", "decimal(18,2)"),
    ],
)
def test_all_timestamp_forms_agree(spark, literal, dtype):
    df = spark.range(1).select(F.lit(literal).cast(dtype).alias("t"))
    assert df.select(fn.convert_timestamp(df, "t").alias("t")).first()["t"] == NEW_YEAR


def test_unreadable_timestamp_is_null(spark):
    df = spark.createDataFrame([("soon",), (None,)], "t string")
    assert rows_of(df.select(fn.convert_timestamp(df, "t").alias("t"))) == [(None,), (None,)]


def test_surrogate_key_text(spark):
    df = spark.createDataFrame([(7, None), (7, "x")], "a int, b string")
    got = [r[0] for r in df.select(fn.surrogate_key("a", "b")).collect()]
    assert got == [hashlib.md5(b"7|_null_").hexdigest(), hashlib.md5(b"7|x").hexdigest()]


def test_fingerprint_ignores_order_and_layout_but_not_content(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))

    def mark(d):
        return d.agg(fn.dataset_fingerprint("id", "k").alias("f")).first()["f"]

    assert mark(df) == mark(df.repartition(7, "k").orderBy(F.desc("id")))
    assert mark(df) != mark(df.withColumn("k", F.when(F.col("id") == 5, 99).otherwise(F.col("k"))))


@pytest.mark.parametrize(
    ("inputs", "score"),
    [
        ((True, 0, 100.0, 0, 0), 100),
        ((False, 0, 100.0, 0, 0), 80),
        ((True, 5, 100.0, 0, 0), 95),
        ((True, 6, 100.0, 0, 0), 85),
        ((True, 10, 100.0, 0, 0), 85),
        ((True, 11, 100.0, 0, 0), 75),
        ((True, 0, 95.0, 0, 0), 100),
        ((True, 0, 94.0, 0, 0), 95),
        ((True, 0, 89.9, 0, 0), 85),
        ((True, 0, 79.9, 0, 0), 75),
        ((True, 0, 100.0, 1, 0), 95),
        ((True, 0, 100.0, 3, 0), 90),
        ((True, 0, 100.0, 6, 0), 80),
        ((True, 0, 100.0, 0, 51), 95),
        ((True, 0, 100.0, 0, 101), 90),
        ((False, 11, 10.0, 6, 101), 0),
        ((None, None, None, None, None), 100),
    ],
)
def test_health_score_steps(spark, inputs, score):
    schema = "h boolean, f bigint, s double, t bigint, q bigint"
    df = spark.createDataFrame([inputs], schema)
    fn.register_health_score(spark)
    columns = [F.col(c) for c in "hfstq"]
    row = df.select(
        fn.health_score(*columns).alias("a"), F.expr("health_score(h, f, s, t, q)").alias("b")
    ).first()
    assert (row["a"], row["b"]) == (score, score)


def test_labels(spark):
    df = spark.createDataFrame(
        [(3.0, True), (12.0, True), (48.0, False), (None, False)], "h double, fresh boolean"
    )
    got = df.select(
        fn.freshness_color(F.col("h")), fn.freshness_status(F.col("fresh"), F.col("h"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("green", "FRESH"), ("yellow", "AGING"), ("red", "STALE"), ("red", "STALE"),
    ]
    suites = spark.createDataFrame([("raw_a",), ("my_raw",), ("mart_b",), ("Staging_c",)], "s string")
    got = suites.select(fn.layer_of_suite(F.col("s")), fn.layer_mentioned(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("raw", "raw"), ("other", "raw"), ("marts", "marts"), ("other", "staging"),
    ]
    severities = spark.createDataFrame([("CRITICAL",), ("low",), ("odd",)], "s string")
    ranks = severities.select(fn.severity_rank(F.col("s"))).collect()
    assert [r[0] for r in ranks] == [1, 4, 5]


def test_title_rules_are_tried_in_order(spark):
    titles = ["Task Failure: SLA job", "SLA Missed", "Data Freshness", "nothing"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r[0] for r in df.select(fn.alert_type_of_title(F.col("t"))).collect()]
    assert got == ["task_failure", "sla_miss", "data_freshness", "general"]


def test_title_case(spark):
    texts = ["o'neil-smith", "ANNA  maria", "é. 3rd-floor", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(fn.title_case(F.col("t"))).collect()]
    assert got == ["O'Neil-Smith", "Anna  Maria", "É. 3rd-Floor", "", None]


@pytest.mark.parametrize(
    ("dtype", "expected"),
    [("double", [4, 2, 4, -2]), ("decimal(9,1)", [4, 3, 4, -3]), ("int", [3, 2, 3, -2])],
)
def test_to_integer_rounds_fractions(spark, dtype, expected):
    df = spark.createDataFrame([(3.7,), (2.5,), (3.5,), (-2.5,)], "v double")
    df = df.select(F.col("v").cast(dtype).alias("v"))
    assert [r[0] for r in df.select(fn.to_integer(df, "v")).collect()] == expected


def test_masks(spark):
    df = spark.createDataFrame([("Ann-42", "a@b.c", "open")], "n string, e string, k string")
    row = df.select(*[fn.mask_column(c, t) for c, t in zip("nek", ["direct", "indirect", ""], strict=True)])
    assert tuple(row.first()) == ("xxx-nn", hashlib.sha256(b"a@b.c").hexdigest(), "open")


def test_means_and_percentages(spark):
    df = spark.createDataFrame([(2.0,), (2.01,), (None,)], "v double")
    row = df.agg(fn.average("v"), fn.rounded_average("v")).first()
    assert tuple(row) == (2.005, 2.01)
    none = df.where("false").agg(fn.average("v"), fn.percent(F.count("v"), F.count("*"), empty=100))
    assert tuple(none.first()) == (None, 100.0)
