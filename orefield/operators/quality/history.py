"""Queries over the ledger of validation runs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import layer_mentioned, layer_of_suite, percent, rounded_average
from orefield.functions.labels import first_match

# Fixed values: (success percent below, severity).
ALERT_SEVERITIES = [(50, "critical"), (75, "high"), (90, "medium")]


def validation_rows(summary: DataFrame, run_id: Column, at: str) -> DataFrame:
    """Summaries in the shape of the validation ledger."""
    moment = F.lit(at).cast("timestamp_ntz")
    return summary.select(
        run_id.alias("run_id"),
        F.col("suite").alias("expectation_suite_name"),
        moment.alias("validation_time"),
        "success",
        F.col("evaluated").alias("total_expectations"),
        F.col("successful").alias("successful_expectations"),
        F.col("unsuccessful").alias("unsuccessful_expectations"),
        "success_percent",
        F.to_date(moment).alias("execution_date"),
    )


def mean_percent(column="success_percent") -> Column:
    return F.sum(column).cast("double") / F.count(column)


def recent_results(
    ledger: DataFrame, as_of: str, suite: str | None = None, days: int = 7, limit: int = 100
) -> DataFrame:
    rows = ledger.where(F.col("validation_time") > _days_before(as_of, days))
    if suite:
        rows = rows.where(F.col("expectation_suite_name") == suite)
    return (
        rows.select(
            "run_id", "expectation_suite_name", "validation_time", "success",
            "total_expectations", "successful_expectations", "success_percent",
        )
        .orderBy(F.desc("validation_time"), F.desc("run_id"))
        .limit(limit)
    )


def _days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def suite_health(ledger: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    ok, runs = F.count_if("success"), F.count("*")
    return (
        ledger.where(F.col("validation_time") > _days_before(as_of, days))
        .groupBy("expectation_suite_name")
        .agg(
            runs.alias("total_runs"),
            ok.alias("successful_runs"),
            percent(ok, runs).alias("run_success_rate"),
            mean_percent().alias("avg_success_percent"),
            F.max("validation_time").alias("last_run"),
        )
    )


def daily_metrics(ledger: DataFrame) -> DataFrame:
    """Metrics per day and suite in one aggregation.

    The mean is exact and rounded once, where a running mean re-rounds at each insert.
    """
    return ledger.groupBy(
        F.col("execution_date").alias("metric_date"), "expectation_suite_name"
    ).agg(
        F.first(layer_of_suite(F.col("expectation_suite_name"))).alias("layer"),
        F.count("*").alias("total_validations"),
        F.count_if("success").alias("successful_validations"),
        F.sum("total_expectations").alias("total_expectations"),
        F.sum("successful_expectations").alias("successful_expectations"),
        rounded_average("success_percent").alias("avg_success_percent"),
        F.min("success_percent").alias("min_success_percent"),
        F.max("success_percent").alias("max_success_percent"),
    )


def severity_of_percent(success_percent: Column) -> Column:
    return first_match(
        [(success_percent < limit, F.lit(name)) for limit, name in ALERT_SEVERITIES], F.lit("low")
    )


def failure_alerts(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("success")).select(
        F.col("run_id").alias("validation_result_id"),
        F.lit("failure").alias("alert_type"),
        severity_of_percent(F.col("success_percent")).alias("severity"),
        "expectation_suite_name",
        "data_asset_name",
        F.format_string(
            "Validation failed: %d/%d expectations passed (%.1f%%)",
            "successful_expectations",
            "total_expectations",
            F.col("success_percent").cast("double"),
        ).alias("message"),
    )


def status_view(ledger: DataFrame, as_of: str) -> DataFrame:
    last_day = F.col("validation_time") > _days_before(as_of, 1)
    return (
        ledger.where(F.col("validation_time") > _days_before(as_of, 7))
        .groupBy(
            "expectation_suite_name",
            layer_of_suite(F.col("expectation_suite_name")).alias("layer"),
        )
        .agg(
            F.count("*").alias("total_runs_7d"),
            F.count_if("success").alias("successful_runs_7d"),
            rounded_average("success_percent").alias("avg_success_percent_7d"),
            F.max("validation_time").alias("last_validation"),
            F.bool_and(F.when(last_day, F.col("success"))).alias("healthy_last_24h"),
        )
    )


def validation_summary(ledger: DataFrame) -> DataFrame:
    runs, ok = F.count("*"), F.count_if("success")
    rules, rules_ok = F.sum("total_expectations"), F.sum("successful_expectations")
    return ledger.agg(
        runs.alias("total_validations"),
        ok.alias("passed_validations"),
        (runs - ok).alias("failed_validations"),
        percent(ok, runs, empty=0).alias("validation_rate"),
        rules.alias("total_expectations"),
        rules_ok.alias("passed_expectations"),
        percent(rules_ok, rules, empty=0).alias("expectation_rate"),
        F.array_join(
            F.sort_array(F.collect_set(F.when(~F.col("success"), F.col("expectation_suite_name")))),
            ",",
        ).alias("failed_suites"),
    )


def layer_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(layer_mentioned(F.col("expectation_suite_name")).alias("layer")).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def trend_series(ledger: DataFrame) -> DataFrame:
    """Each suite's runs in time order."""
    return ledger.select(
        "expectation_suite_name", "validation_time", "run_id", "success", "success_percent",
        "total_expectations", "successful_expectations",
    ).orderBy("expectation_suite_name", "validation_time", "run_id")


def trend_rollup(ledger: DataFrame, grain: str = "day") -> DataFrame:
    if grain not in ("day", "week", "month"):
        raise ValueError(f"unknown grain: {grain}")
    bucket = F.to_date(F.date_trunc(grain, "validation_time"))
    return ledger.groupBy("expectation_suite_name", bucket.alias("bucket")).agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("successful_runs"),
        mean_percent().alias("avg_success_percent"),
    )
