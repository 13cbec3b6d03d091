"""Queries: alerts as data."""

from pyspark.sql import functions as F

from orefield.functions import alert_type_of_title, layer_of_suite, percent, seconds_between
from orefield.operators import alerts, freshness, runs
from orefield.workload.oracle_tables import ALERT_TYPE, hours, layer_case, mean, severity_case
from orefield.workload.oracle_tables import EVENTS_NOW as SQL_NOW
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW


@query("alert_type_classify", f"SELECT id, title, {ALERT_TYPE} AS alert_type FROM x_al0")
def _(lake):
    return lake.alerts_of(lake.events).select(
        "id", "title", alert_type_of_title(F.col("title")).alias("alert_type")
    )


@query(
    "alert_metadata_map",
    """SELECT id, alert_type, severity, title || ' ' || repeat('é', CAST(id % 1000 AS INTEGER)) AS subject,
        left(title || ' ' || repeat('é', CAST(id % 1000 AS INTEGER)), 500) AS subject_shown, dag_id, task_id,
        strftime(created_at, '%Y-%m-%d') AS execution_date,
        '{"try_number":"' || k || '","log_url":"http://log/' || user_id || '"}' AS metadata,
        created_at FROM x_al""",
)
def _(lake):
    """Field lists to columns plus a map, shown as JSON in field order."""
    incoming = lake.alerts_of(lake.events)
    # Titles up to 1,000 characters longer: stored whole, cut for display only.
    longer = F.concat_ws(" ", "title", F.repeat(F.lit("é"), (F.col("id") % 1000).cast("int")))
    rows = alerts.alert_rows(incoming.withColumn("title", longer)).select("*", alerts.shown_subject())
    pair = F.from_json("metadata", "map<string,string>")
    in_order = F.to_json(
        F.struct(pair["try_number"].alias("try_number"), pair["log_url"].alias("log_url"))
    )
    return rows.withColumn("metadata", in_order)


@query(
    "alert_suppression",
    f"""SELECT id, severity, {severity_case("severity")} > 2 AS suppressed,
        CASE WHEN {severity_case("severity")} > 2 THEN 'Below severity threshold' END AS suppression_reason
        FROM x_al""",
)
def _(lake):
    kept = alerts.suppress_below(lake.alerts, "HIGH")
    return kept.select("id", "severity", "suppressed", "suppression_reason")


@query(
    "dq_alert_severity",
    f"""SELECT run_id, {layer_case("expectation_suite_name")} AS layer,
        CASE WHEN {layer_case("expectation_suite_name")} = 'marts'
                OR (22 - successful_expectations)::DOUBLE / 22 > 0.5 THEN 'CRITICAL'
            WHEN (22 - successful_expectations)::DOUBLE / 22 > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
        FROM x_vr WHERE NOT success""",
)
def _(lake):
    layer = layer_of_suite(F.col("expectation_suite_name"))
    return lake.validations.where(~F.col("success")).select(
        "run_id",
        layer.alias("layer"),
        alerts.quality_alert_severity(
            layer, F.col("unsuccessful_expectations"),
            F.col("total_expectations"),
        ).alias("severity"),
    )


@query(
    "task_failure_alerts",
    """SELECT run_id, 'Task Failure: ' || dag_id || '.' || task_id AS title,
        'Task `' || task_id || '` in DAG `' || dag_id || '` has failed.' AS message,
        CASE WHEN priority_weight > 10 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
        FROM x_ti WHERE state = 'failed'""",
)
def _(lake):
    return alerts.task_failure_alerts(lake.tasks)


@query(
    "unacknowledged_alerts",
    f"""SELECT id, alert_type, severity, subject, dag_id, task_id, created_at,
        {hours(SQL_NOW, "created_at")} AS hours_since_alert FROM x_al WHERE NOT acknowledged""",
)
def _(lake):
    return alerts.unacknowledged(lake.alerts, EVENTS_NOW)


@query(
    "alert_routing",
    """SELECT id, dag_id, severity,
        CASE WHEN dag_id IN ('sample_batch_ingestion', 'dbt_transform', 'data_quality_checks')
            OR severity IN ('critical', 'high') THEN 'slack,email' ELSE 'slack' END AS channels,
        CASE WHEN dag_id IN ('sample_batch_ingestion', 'dbt_transform') THEN 'HIGH'
            WHEN dag_id = 'data_quality_checks' THEN 'CRITICAL' ELSE upper(severity) END AS routed_severity
        FROM x_al""",
)
def _(lake):
    return alerts.route(lake.alerts.select("id", "dag_id", "severity"))


@query(
    "alert_routing_tags",
    """SELECT id, CASE WHEN id % 4 = 0 OR id % 6 = 0 THEN 'slack,email' WHEN id % 5 = 0 THEN 'slack'
            WHEN dag_id IN ('sample_batch_ingestion', 'dbt_transform', 'data_quality_checks') OR severity IN ('critical', 'high')
            THEN 'slack,email' ELSE 'slack' END AS channels,
        CASE WHEN id % 4 = 0 THEN 'CRITICAL' WHEN id % 6 = 0 THEN 'HIGH' WHEN id % 5 = 0 THEN 'MEDIUM'
            WHEN dag_id IN ('sample_batch_ingestion', 'dbt_transform') THEN 'HIGH'
            WHEN dag_id = 'data_quality_checks' THEN 'CRITICAL' ELSE upper(severity) END AS routed_severity FROM x_al""",
)
def _(lake):
    """A DAG's tags decide before its name: critical, then production, then monitoring."""
    def tag(n, name):
        return F.when(F.col("id") % n == 0, F.lit(name))

    tags = F.array_compact(F.array(tag(5, "monitoring"), tag(6, "production"), tag(4, "critical"), F.lit("daily")))
    return alerts.route(lake.alerts.withColumn("tags", tags), tags="tags").select("id", "channels", "routed_severity")


@query(
    "alert_dedup",
    """SELECT dag_id, alert_type, id, created_at FROM (SELECT *, lag(created_at) OVER
            (PARTITION BY dag_id, alert_type ORDER BY created_at, id) AS before FROM x_al
            WHERE dag_id NOT IN ('example_hello_world', 'example_monitoring') AND NOT is_retry)
        WHERE before IS NULL OR created_at - before > INTERVAL 15 MINUTE""",
)
def _(lake):
    return alerts.deduplicate(lake.alerts, ["dag_id", "alert_type"])


def severity_count(name):
    return f"COUNT(*) FILTER (WHERE severity = '{name}') AS {name}_count"


WINDOW_SQL = f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, * FROM x_al),
        t AS (SELECT window_start, string_agg(alert_type || '=' || n, ',' ORDER BY alert_type || '=' || n) AS alerts_by_type
            FROM (SELECT window_start, alert_type, COUNT(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1)
        SELECT window_start, COUNT(*) AS total_alerts,
        {", ".join(severity_count(s) for s in ("critical", "high", "medium", "low"))},
        COUNT(DISTINCT alert_type) AS alert_types, any_value(alerts_by_type) AS alerts_by_type,
        COUNT(*) > 2 AS send_summary FROM w JOIN t USING (window_start) GROUP BY 1"""


@query("alert_window_summary", WINDOW_SQL)
def _(lake):
    return alerts.window_summary(lake.alerts, limit=2)


@query(
    "alert_escalation",
    f"""SELECT id, severity, created_at, escalate_after_minutes FROM (SELECT *, CASE severity
            WHEN 'critical' THEN 15 WHEN 'high' THEN 30 WHEN 'medium' THEN 60 END AS escalate_after_minutes
            FROM x_al WHERE NOT acknowledged)
        WHERE (epoch_us({SQL_NOW}) - epoch_us(created_at)) / 6e7 > escalate_after_minutes""",
)
def _(lake):
    return alerts.to_escalate(lake.alerts, EVENTS_NOW)


@query(
    "alert_thresholds",
    f"""WITH m AS (SELECT 'quality_min_success_percent' AS metric, expectation_suite_name AS subject,
                {mean("success_percent")} AS value, 'min' AS direction FROM x_vr GROUP BY 2
            UNION ALL SELECT 'health_min_score', CAST(metric_date AS VARCHAR), MIN(health_score)::DOUBLE, 'min'
                FROM x_health GROUP BY 2
            UNION ALL SELECT 'max_queued_tasks', CAST(metric_date AS VARCHAR), SUM(queued_tasks)::DOUBLE, 'max'
                FROM x_health GROUP BY 2
            UNION ALL SELECT 'freshness_' || layer || '_hours', source_name, staleness_hours::DOUBLE, 'max' FROM x_fstat
            UNION ALL SELECT 'sla_completion_hours', CAST(run_id AS VARCHAR),
                (epoch_us(end_date) - epoch_us(start_date)) / 1e6 / 60.0::DOUBLE / 60.0::DOUBLE, 'max' FROM x_ti WHERE state IN ('success', 'failed')
            UNION ALL SELECT 'sla_alert_at_percent', CAST(run_id AS VARCHAR),
                round(100.0::DOUBLE * ((epoch_us({SQL_NOW}) - epoch_us(start_date)) / 1e6 / 60.0::DOUBLE) / 240.0::DOUBLE, 2), 'max'
                FROM x_ti WHERE state = 'running' AND start_date <= {SQL_NOW}
            UNION ALL SELECT 'heartbeat_max_minutes', dag_id, floor((epoch_us({SQL_NOW}) - epoch_us(MAX(start_date))) / 1000000) / 60.0::DOUBLE, 'max'
                FROM x_ti GROUP BY 2
            UNION ALL SELECT 'task_failure_rate_percent', dag_id,
                100.0::DOUBLE * COUNT(*) FILTER (WHERE state = 'failed')::DOUBLE / COUNT(*)::DOUBLE, 'max' FROM x_ti GROUP BY 2),
        t AS (SELECT m.*, limits.threshold FROM m JOIN (VALUES ('quality_min_success_percent', 90.0::DOUBLE), ('health_min_score', 70.0::DOUBLE),
            ('max_queued_tasks', 100.0::DOUBLE), ('freshness_raw_hours', 24.0::DOUBLE), ('freshness_staging_hours', 24.0::DOUBLE),
            ('freshness_marts_hours', 48.0::DOUBLE), ('sla_completion_hours', 4.0::DOUBLE), ('sla_alert_at_percent', 80.0::DOUBLE),
            ('heartbeat_max_minutes', 5.0::DOUBLE), ('task_failure_rate_percent', 10.0::DOUBLE)) AS limits(metric, threshold) USING (metric))
        SELECT *, CASE direction WHEN 'min' THEN value < threshold ELSE value > threshold END AS breached
        FROM t""",
)
def _(lake):
    mean_percent = F.sum("success_percent").cast("double") / F.count("success_percent")
    quality = lake.validations.groupBy(F.col("expectation_suite_name").alias("subject")).agg(
        mean_percent.alias("value")
    )
    day = F.col("metric_date").cast("string").alias("subject")
    scores = lake.health.groupBy(day).agg(F.min("health_score").cast("double").alias("value"))
    queued = lake.health.groupBy(day).agg(F.sum("queued_tasks").cast("double").alias("value"))

    def metric(df, name, direction):
        return df.select(
            F.lit(name).alias("metric"), "subject", "value", F.lit(direction).alias("direction")
        )

    rows = (
        metric(quality, "quality_min_success_percent", "min")
        .unionByName(metric(scores, "health_min_score", "min"))
        .unionByName(metric(queued, "max_queued_tasks", "max"))
    )
    stale = freshness.status_view(lake.freshness).select(
        F.concat(F.lit("freshness_"), "layer", F.lit("_hours")).alias("metric"), F.col("source_name").alias("subject"),
        F.col("staleness_hours").cast("double").alias("value"), F.lit("max").alias("direction"),
    )
    run, dag = F.col("run_id").cast("string").alias("subject"), F.col("dag_id").alias("subject")
    finished = lake.tasks.where(F.col("state").isin("success", "failed"))
    hours = finished.select(run, (seconds_between("end_date", "start_date") / F.lit(60.0) / F.lit(60.0)).alias("value"))
    begun = lake.tasks.where(F.col("start_date") <= F.lit(EVENTS_NOW).cast("timestamp_ntz"))
    limit = 60 * alerts.THRESHOLDS["sla_completion_hours"]
    used = runs.sla_time_used(begun, EVENTS_NOW, limit).select(run, F.col("percent_used").alias("value"))
    beats = freshness.heartbeat_age(lake.tasks, "dag_id", "start_date", EVENTS_NOW)
    beats = beats.select(F.col("producer").alias("subject"), (F.col("age_seconds") / F.lit(60.0)).alias("value"))
    failed = lake.tasks.groupBy(dag).agg(percent(F.count_if(F.col("state") == "failed"), F.count("*"), digits=None).alias("value"))
    for name, df in [
        ("sla_completion_hours", hours), ("sla_alert_at_percent", used), ("heartbeat_max_minutes", beats), ("task_failure_rate_percent", failed),
    ]:
        rows = rows.unionByName(metric(df, name, "max"))
    rows = rows.unionByName(stale)
    return alerts.breaches(rows)
