"""Alerts as data: severity, routing, suppression, aggregation, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.functions import alert_type_of_title, hours_between, severity_rank
from orefield.functions.labels import first_match
from orefield.functions.times import seconds_between

# Fixed values
ROUTES = [
    (r"^sample_batch_ingestion$", "slack,email", "HIGH"),
    (r"^dbt_transform$", "slack,email", "HIGH"),
    (r"^data_quality_checks$", "slack,email", "CRITICAL"),
]
SEVERITY_CHANNELS = {"CRITICAL": "slack,email", "HIGH": "slack,email", "MEDIUM": "slack", "LOW": "slack"}
ESCALATE_AFTER_MINUTES = {"critical": 15, "high": 30, "medium": 60}
DEDUP_MINUTES = 15
EXCLUDED_DAGS = ["example_hello_world", "example_monitoring"]
WINDOW_MINUTES = 5
MAX_ALERTS_PER_WINDOW = 10
THRESHOLDS = {
    "freshness_raw_hours": 24,
    "freshness_staging_hours": 24,
    "freshness_marts_hours": 48,
    "sla_completion_hours": 4,
    "sla_alert_at_percent": 80,
    "quality_min_success_percent": 90,
    "health_min_score": 70,
    "heartbeat_max_minutes": 5,
    "max_queued_tasks": 100,
    "task_failure_rate_percent": 10,
}
FIELD_TITLES = {"dag": "dag_id", "task": "task_id", "execution_date": "execution_date"}
FIELDS_TYPE = T.ArrayType(
    T.StructType().add("title", T.StringType()).add("value", T.StringType())
)
#: Characters of a subject that a display shows; the stored row keeps the whole title.
SUBJECT_SHOWN = 500


def _field_key(field: Column) -> Column:
    return F.replace(F.lower(field["title"]), F.lit(" "), F.lit("_"))


def _entries_of(column: str, key) -> Column:
    return F.filter(column, lambda f: f["key"] == key)


def parse_fields(alerts: DataFrame, column: str = "fields") -> DataFrame:
    """Known fields become columns, the others a map under snake_case keys."""
    entries = F.from_json(column, FIELDS_TYPE)
    named = F.transform(entries, lambda f: F.struct(_field_key(f).alias("key"), f["value"].alias("value")))
    rest = F.filter("_named", lambda f: ~f["key"].isin(list(FIELD_TITLES)))
    out = alerts.withColumn("_named", named)
    for key, name in FIELD_TITLES.items():
        out = out.withColumn(name, F.try_element_at(_entries_of("_named", key), F.lit(-1))["value"])
    # A title that occurs twice keeps its last value.
    keys = F.array_distinct(F.transform("_rest", lambda f: f["key"]))
    last_value = F.transform(
        keys, lambda k: F.element_at(_entries_of("_rest", k), -1)["value"]
    )
    return (
        out.withColumn("_rest", rest)
        .withColumn("metadata", F.map_from_arrays(keys, last_value))
        .drop("_named", "_rest")
    )


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Incoming alerts in the shape of the history table."""
    return parse_fields(alerts).select(
        "id",
        alert_type_of_title(F.col("title")).alias("alert_type"),
        F.lower("severity").alias("severity"),
        F.col("title").alias("subject"),
        "dag_id",
        "task_id",
        "execution_date",
        F.to_json("metadata").alias("metadata"),
        "created_at",
    )


def shown_subject(length: int = SUBJECT_SHOWN) -> Column:
    return F.substring("subject", 1, length).alias("subject_shown")


def suppress_below(alerts: DataFrame, minimum: str = "MEDIUM") -> DataFrame:
    """Every alert stays; those under the minimum severity are marked with the reason."""
    below = severity_rank(F.col("severity")) > severity_rank(F.lit(minimum))
    return alerts.withColumn("suppressed", below).withColumn(
        "suppression_reason", F.when(below, "Below severity threshold")
    )


def quality_alert_severity(layer: Column, failed: Column, total: Column) -> Column:
    rate = F.coalesce(F.try_divide(failed.cast("double"), total.cast("double")), F.lit(0.0))
    return first_match(
        [((layer == "marts") | (rate > 0.5), F.lit("CRITICAL")), (rate > 0.2, F.lit("HIGH"))],
        F.lit("MEDIUM"),
    )


def task_failure_alerts(tasks: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "dag_id", "task_id")
    return tasks.where(F.col("state") == "failed").select(
        "run_id",
        F.concat(F.lit("Task Failure: "), name).alias("title"),
        F.format_string("Task `%s` in DAG `%s` has failed.", "task_id", "dag_id").alias("message"),
        F.when(F.col("priority_weight") > 10, "CRITICAL").otherwise("HIGH").alias("severity"),
    )


def unacknowledged(alerts: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return (
        alerts.where(~F.col("acknowledged"))
        .select(
            "id", "alert_type", "severity", "subject", "dag_id", "task_id", "created_at",
            hours_between(now, "created_at", digits=None).alias("hours_since_alert"),
        )
        .orderBy(severity_rank(F.col("severity")), F.desc("created_at"), "id")
    )


# Tag of a DAG -> channels, severity; the first tag of this list counts.
TAG_ROUTES = [("critical", "slack,email", "CRITICAL"), ("production", "slack,email", "HIGH"), ("monitoring", "slack", "MEDIUM")]


def route(alerts: DataFrame, routes=None, tags: str | None = None) -> DataFrame:
    """First matching dag pattern decides channels and severity, else the severity's own channels.

    With ``tags`` (a column with the DAG's tags) a known tag decides before the patterns.
    """
    routes = ROUTES if routes is None else routes
    dag, severity = F.col("dag_id"), F.upper("severity")
    tagged = [(F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), t), c, s) for t, c, s in TAG_ROUTES] if tags else []
    routes = tagged + [(dag.rlike(p), c, s) for p, c, s in routes]
    default = first_match(
        [(severity == s, F.lit(c)) for s, c in SEVERITY_CHANNELS.items()], F.lit("slack")
    )
    return alerts.withColumns(
        {
            "channels": first_match([(hit, F.lit(c)) for hit, c, _ in routes], default),
            "routed_severity": first_match([(hit, F.lit(s)) for hit, _, s in routes], severity),
        }
    )


def alert_slices(alerts: DataFrame, keys: list[str], minutes: int = DEDUP_MINUTES) -> DataFrame:
    """(keys, slice, first, last): what deduplication needs of each key and slice of ``minutes``.

    Slices of parts of the alerts may be put together by ``merged_bursts`` in any order.
    """
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    return alerts.groupBy(*keys, F.floor(micros / F.lit(minutes * 60_000_000)).alias("slice")).agg(
        F.min(F.struct("created_at", "id")).alias("first"), F.max("created_at").alias("last")
    )


def merged_bursts(parts: DataFrame, keys: list[str], minutes: int = DEDUP_MINUTES) -> DataFrame:
    """(keys, first, last): bursts put together where an alert follows within ``minutes``.

    ``parts`` are slices or bursts of parts of the alerts; merging them in any order gives the same.
    """
    order = Window.partitionBy(*keys).orderBy("first.created_at", "first.id")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("first.created_at"))
    starts = F.when(F.col("_before").isNull() | (gap > minutes * 60_000_000), 1).otherwise(0)
    numbered = parts.select(*keys, "first", "last").withColumn("_before", before).withColumn("_burst", F.sum(starts).over(order))
    return numbered.groupBy(*keys, "_burst").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_burst")


def burst_starts(slices: DataFrame, keys: list[str], minutes: int = DEDUP_MINUTES) -> DataFrame:
    """Of a slice only the first alert can go out, and only the last alert before it can hold it back."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("slice"))
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("first.created_at"))
    return (
        slices.withColumn("_before", before)
        .where(F.col("_before").isNull() | (gap > minutes * 60_000_000))
        .select(*keys, F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"))
    )


def may_go_out(
    alerts: DataFrame, excluded_dags: list[str] | None = None, drop_retries: bool = True, excluded_tasks: list[str] | None = None
) -> DataFrame:
    excluded = EXCLUDED_DAGS if excluded_dags is None else excluded_dags
    rows = alerts.where(~F.col("dag_id").isin(excluded))
    if excluded_tasks:
        rows = rows.where(~F.coalesce(F.col("task_id").isin(excluded_tasks), F.lit(False)))
    return rows.where(~F.col("is_retry")) if drop_retries else rows


def deduplicate(
    alerts: DataFrame,
    keys: list[str],
    minutes: int = DEDUP_MINUTES,
    excluded_dags: list[str] | None = None,
    drop_retries: bool = True,
) -> DataFrame:
    """Alerts that go out: none of the same key within ``minutes`` before them.

    The rows are reduced to (key, slice) before the shuffle, and the window then sees one row per
    slice however many alerts a noisy key raised.
    """
    rows = may_go_out(alerts, excluded_dags, drop_retries)
    return burst_starts(alert_slices(rows, keys, minutes), keys, minutes)


SEVERITIES = ("critical", "high", "medium", "low")


def window_counts(alerts: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """(window_start, severity, alert_type, n): counts that may be summed over parts of the alerts."""
    slot = F.window(F.col("created_at"), f"{minutes} minutes")
    counts = alerts.groupBy(slot.alias("w"), "severity", "alert_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "severity", "alert_type", "n")


def summed_windows(counts: DataFrame, limit: int = MAX_ALERTS_PER_WINDOW) -> DataFrame:
    """Totals per window, by severity and by type (type=count, in order of type); over ``limit`` one summary is sent."""
    by_type = counts.groupBy("window_start", "alert_type").agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITIES]
    )
    types = F.sort_array(F.collect_list(F.concat_ws("=", "alert_type", F.col("n").cast("string"))))
    return by_type.groupBy("window_start").agg(
        F.sum("n").alias("total_alerts"), *[F.sum(s).alias(f"{s}_count") for s in SEVERITIES],
        F.count("alert_type").alias("alert_types"), F.array_join(types, ",").alias("alerts_by_type"),
    ).withColumn("send_summary", F.col("total_alerts") > limit)


def window_summary(
    alerts: DataFrame, minutes: int = WINDOW_MINUTES, limit: int = MAX_ALERTS_PER_WINDOW
) -> DataFrame:
    """Alert counts per window; more than ``limit`` are sent as one summary."""
    return summed_windows(window_counts(alerts, minutes), limit)


def to_escalate(alerts: DataFrame, as_of: str) -> DataFrame:
    """Unacknowledged alerts older than their severity allows; low never escalates."""
    now = F.lit(as_of).cast("timestamp_ntz")
    allowed = first_match(
        [(F.col("severity") == s, F.lit(m)) for s, m in ESCALATE_AFTER_MINUTES.items()],
        F.lit(None).cast("int"),
    )
    age = seconds_between(now, "created_at") / F.lit(60.0)
    return (
        alerts.where(~F.col("acknowledged"))
        .withColumn("escalate_after_minutes", allowed)
        .where(age > F.col("escalate_after_minutes"))
        .select("id", "severity", "created_at", "escalate_after_minutes")
    )


def breaches(metrics: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Metrics (name, value, direction) against the registry; 'max' must not be exceeded,
    'min' not be undercut."""
    table = F.create_map(
        *[F.lit(x) for k, v in (thresholds or THRESHOLDS).items() for x in (k, float(v))]
    )
    limit = F.try_element_at(table, F.col("metric"))
    breached = F.when(F.col("direction") == "min", F.col("value") < limit).otherwise(
        F.col("value") > limit
    )
    return metrics.withColumn("threshold", limit).withColumn(
        "breached", F.coalesce(breached, F.lit(False))
    )
