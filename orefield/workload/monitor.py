"""Queries: freshness, SLA, volume, task runs, health."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orefield.functions import health_score, register_health_score
from orefield.operators import freshness, health, runs, volume
from orefield.operators.watermarks import current_watermarks
from orefield.workload.oracle_tables import EVENTS_NOW as SQL_NOW
from orefield.workload.oracle_tables import HEALTH_SCORE, hours, layer_case, mean, pct, rounded_mean
from orefield.workload.oracle_tables import ORDERS_NOW as SQL_ORDERS_NOW
from orefield.session import new_workspace
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW, ORDERS_NOW

SLA_NOW = "2024-01-30 00:00:00"
SQL_SLA_NOW = f"TIMESTAMP '{SLA_NOW}'"
DAY_BEFORE = f"start_date >= {SQL_SLA_NOW} - INTERVAL 24 HOUR"


def state(name):
    return f"COUNT(*) FILTER (WHERE state = '{name}')"


# -- freshness -------------------------------------------------------------------------------------

STALE = hours(SQL_ORDERS_NOW, "last_update")


@query(
    "freshness_check",
    f"""WITH l AS (SELECT source_name, MAX(CASE WHEN status = 'success' THEN updated_at END) AS last_update
            FROM x_ing GROUP BY 1)
        SELECT source_name, 'raw' AS layer, last_update, round({STALE}, 2) AS staleness_hours,
        coalesce({STALE} <= 24, false) AS is_fresh, 24 AS threshold_hours FROM l""",
)
def _(lake):
    return freshness.source_freshness(lake.ingestion, ORDERS_NOW)


@query(
    "freshness_recorded",
    f"""WITH l AS (SELECT source_name, MAX(CASE WHEN status = 'success' THEN updated_at END) AS last_update
            FROM x_ing GROUP BY 1),
        o AS (SELECT source_name, MAX(CASE WHEN status = 'success' AND updated_at < TIMESTAMP '2000-01-01' THEN updated_at END) AS last_update
            FROM x_ing WHERE updated_at < TIMESTAMP '2000-01-01' GROUP BY 1)
        SELECT source_name, last_update, {SQL_ORDERS_NOW} AS check_time FROM l
        UNION ALL SELECT source_name, last_update, TIMESTAMP '2000-01-01' FROM o""",
)
def _(lake):
    """Two checks whose rows are appended to the metrics' history, read back."""
    path = f"{new_workspace(lake.spark, 'freshness')}/metrics"
    for at in ("2000-01-01 00:00:00", ORDERS_NOW):
        moment = F.lit(at).cast("timestamp_ntz")
        before = lake.ingestion.where(F.col("updated_at") < moment) if at < "2001" else lake.ingestion
        rows = freshness.source_freshness(before, at).withColumn("check_time", moment)
        held = health.append_metrics(rows, path)
    return held.select("source_name", "last_update", "check_time")


@query("freshness_status", "SELECT * FROM x_fstat")
def _(lake):
    return freshness.status_view(lake.freshness)


SWEEP = f"""SELECT *, round({hours(SQL_ORDERS_NOW, "last_update")}, 2) AS staleness_hours,
    coalesce({hours(SQL_ORDERS_NOW, "last_update")} < threshold_hours, false) AS is_fresh FROM (
    SELECT *, CASE layer WHEN 'raw' THEN 24 WHEN 'staging' THEN 12 WHEN 'marts' THEN 6 END AS threshold_hours
    FROM (SELECT source_name, 'raw' AS layer, MAX(updated_at) AS last_update,
            CAST(SUM(row_count) AS BIGINT) AS row_count FROM x_ing WHERE status = 'success' GROUP BY 1
        UNION ALL SELECT source_name || '.' || watermark_column, 'raw', updated_at, 0 FROM x_wm_now
        UNION ALL SELECT data_asset_name, {layer_case("expectation_suite_name")}, MAX(validation_time), 0
            FROM (SELECT * REPLACE (validation_time - INTERVAL 8217 DAY AS validation_time) FROM x_vr)
            WHERE success AND {layer_case("expectation_suite_name")} IN ('staging', 'marts') GROUP BY 1, 2))"""


def _sweep(lake):
    # The two ledgers come from tables of different years; validations are moved to the orders' time.
    moved = lake.validations.withColumn(
        "validation_time", F.col("validation_time") - F.make_dt_interval(F.lit(8217))
    )
    marks = current_watermarks(lake.watermark_ledger)
    return freshness.sweep(lake.ingestion, marks, moved, ORDERS_NOW)


@query("freshness_sweep", SWEEP)
def _(lake):
    return _sweep(lake)


@query(
    "freshness_layer_summary",
    f"""WITH s AS ({SWEEP}), t AS (SELECT layer, string_agg(source_name, ',' ORDER BY source_name) AS names
            FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY staleness_hours DESC, source_name)
                AS rn FROM s WHERE NOT is_fresh) WHERE rn <= 5 GROUP BY 1),
        l AS (SELECT * FROM (VALUES ('raw', 24), ('staging', 12), ('marts', 6)) v(layer, threshold_hours)),
        c AS (SELECT layer, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_fresh) AS fresh,
            COUNT(*) FILTER (WHERE NOT is_fresh) AS stale, {mean("staleness_hours")} AS avg_staleness_hours
            FROM s GROUP BY 1)
        SELECT l.layer, l.threshold_hours, coalesce(total, 0) AS total, coalesce(fresh, 0) AS fresh,
        coalesce(stale, 0) AS stale, avg_staleness_hours, coalesce(names, '') AS stale_sources
        FROM l LEFT JOIN c ON l.layer = c.layer LEFT JOIN t ON l.layer = t.layer""",
)
def _(lake):
    return freshness.layer_summary(_sweep(lake))


@query(
    "heartbeat_age",
    f"""SELECT dag_id AS producer, MAX(start_date) AS last_seen,
        datediff_s AS age_seconds, datediff_s <= 300 AS healthy FROM (SELECT dag_id, start_date,
            CAST(floor((epoch_us({SQL_NOW}) - epoch_us(MAX(start_date) OVER (PARTITION BY dag_id))) / 1000000)
            AS BIGINT) AS datediff_s FROM x_ti) GROUP BY 1, 3""",
)
def _(lake):
    return freshness.heartbeat_age(lake.tasks, "dag_id", "start_date", EVENTS_NOW)


# -- runs ----------------------------------------------------------------------------------------------


@query(
    "task_state_counts",
    f"""SELECT {state("failed")} AS failed, {state("success")} AS success, {state("running")} AS running,
        {state("queued")} AS queued, COUNT(*) AS total FROM x_ti WHERE {DAY_BEFORE}""",
)
def _(lake):
    return runs.state_counts(lake.tasks, SLA_NOW)


@query(
    "failures_by_dag",
    f"""SELECT dag_id, {state("failed")} AS failure_count, round({pct(state("failed"), "COUNT(*)")}, 2)
        AS failure_rate FROM x_ti WHERE {DAY_BEFORE} GROUP BY 1 HAVING {state("failed")} > 0
        ORDER BY failure_count DESC, dag_id LIMIT 10""",
)
def _(lake):
    return runs.failures_by_dag(lake.tasks, SLA_NOW)


@query(
    "task_failure_rate",
    f"""SELECT {state("failed")} AS failed_tasks_24h, {state("success")} AS successful_tasks_24h,
        {state("running")} AS running_tasks, {state("queued")} AS queued_tasks, COUNT(*) AS total_tasks_24h,
        round({pct(state("failed"), "COUNT(*)")}, 2) AS failure_rate_percent,
        {pct(state("failed"), "COUNT(*)")} > 10 AS failure_issue, {state("queued")} > 100 AS queue_issue
        FROM x_ti WHERE {DAY_BEFORE}""",
)
def _(lake):
    return runs.failure_rate(lake.tasks, SLA_NOW)


@query(
    "recent_failures",
    """SELECT run_id, dag_id, task_id, execution_date, end_date FROM x_ti WHERE state = 'failed'
        ORDER BY end_date DESC, run_id DESC LIMIT 10""",
)
def _(lake):
    return runs.recent_failures(lake.tasks)


@query(
    "queue_snapshot",
    f"""SELECT {state("queued")} AS queued, {state("running")} AS running, {state("scheduled")} AS scheduled
        FROM x_ti WHERE start_date >= {SQL_NOW} - INTERVAL 1 HOUR
        OR state IN ('queued', 'running', 'scheduled')""",
)
def _(lake):
    return runs.queue_snapshot(lake.tasks, EVENTS_NOW)


@query(
    "dag_counts",
    """SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_active AND NOT is_paused) AS active,
        COUNT(*) FILTER (WHERE is_paused) AS paused FROM x_dags""",
)
def _(lake):
    return runs.dag_counts(lake.dags)


CHECKED = f"""SELECT *, duration_minutes <= 60 AS met FROM (SELECT *,
    (epoch_us(end_date) - epoch_us(start_date)) / 1e6 / 60.0::DOUBLE AS duration_minutes
    FROM x_ti WHERE {DAY_BEFORE} AND state IN ('success', 'failed')) WHERE duration_minutes IS NOT NULL"""


@query(
    "sla_check",
    f"""SELECT dag_id, task_id, COUNT(*) AS runs_checked, COUNT(*) FILTER (WHERE met) AS sla_met,
        COUNT(*) FILTER (WHERE NOT met) AS sla_missed,
        round({pct("COUNT(*) FILTER (WHERE met)", "COUNT(*)")}, 2) AS compliance_percent
        FROM ({CHECKED}) GROUP BY 1, 2""",
)
def _(lake):
    return runs.sla_check(lake.tasks, SLA_NOW)


TRACKED = f"""SELECT dag_id, task_id, CAST(execution_date AS DATE) AS execution_date,
    start_date + INTERVAL 60 MINUTE AS expected_completion, end_date AS actual_completion, met AS sla_met,
    CASE WHEN met THEN 0 ELSE CAST(trunc((duration_minutes - 60) * 60) AS INTEGER) END AS delay_seconds
    FROM (SELECT *, row_number() OVER (PARTITION BY dag_id, task_id, CAST(execution_date AS DATE)
        ORDER BY end_date DESC, run_id DESC) AS last FROM ({CHECKED})) WHERE last = 1"""


@query(
    "sla_tracking",
    f"""WITH t AS ({TRACKED}) SELECT * FROM t WHERE length(dag_id) % 2 = 0
        UNION ALL SELECT dag_id, task_id, execution_date,
            CASE WHEN day(execution_date) % 2 = 0 THEN expected_completion - INTERVAL 7 MINUTE ELSE expected_completion END,
            actual_completion, sla_met, delay_seconds FROM t WHERE length(dag_id) % 2 = 1
        UNION ALL SELECT 'retired', 'task', DATE '2001-01-01', TIMESTAMP '2001-01-01 01:00:00',
            TIMESTAMP '2001-01-01 00:30:00', true, 0""",
)
def _(lake):
    """A check folded into a table that holds some of its keys with other outcomes, and one key of its own.

    New keys come in, known ones take the new outcome and keep their expected completion, the rest stays.
    """
    rows = runs.sla_rows(lake.tasks, SLA_NOW)
    early = F.col("expected_completion") - F.make_dt_interval(mins=F.lit(7))
    old = rows.where((F.length("dag_id") % 2 == 1) & (F.dayofmonth("execution_date") % 2 == 0)).select(
        *runs.TRACKING_KEYS, early.alias("expected_completion"), F.lit(None).cast("timestamp_ntz").alias("actual_completion"),
        F.lit(False).alias("sla_met"), F.lit(9).alias("delay_seconds"),
    )
    day = datetime(2001, 1, 1)
    retired = lake.spark.createDataFrame(
        [("retired", "task", day.date(), day + timedelta(hours=1), day + timedelta(minutes=30), True, 0)], old.schema
    )
    return runs.track_sla(old.unionByName(retired), rows)


WHOLE_RUNS = f"""SELECT dag_id, execution_date, MIN(start_date) AS start_date, MAX(end_date) AS end_date FROM x_ti
    WHERE {DAY_BEFORE} AND state IN ('success', 'failed') GROUP BY 1, 2"""


@query(
    "sla_check_dags",
    f"""SELECT dag_id, '__dag__' AS task_id, COUNT(*) AS runs_checked, COUNT(*) FILTER (WHERE m <= 90) AS sla_met,
        COUNT(*) FILTER (WHERE m > 90) AS sla_missed, round({pct("COUNT(*) FILTER (WHERE m <= 90)", "COUNT(*)")}, 2) AS compliance_percent
        FROM (SELECT *, (epoch_us(end_date) - epoch_us(start_date)) / 1e6 / 60.0::DOUBLE AS m FROM ({WHOLE_RUNS}))
        WHERE m IS NOT NULL GROUP BY 1""",
)
def _(lake):
    """The same check for whole DAG runs, kept under the key of the whole DAG."""
    done = runs.started_within(lake.tasks, SLA_NOW).where(F.col("state").isin("success", "failed"))
    whole = done.groupBy("dag_id", "execution_date").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.max("run_id").alias("run_id")
    )
    return runs.sla_check(runs.dag_runs_as_tasks(whole).withColumn("state", F.lit("success")), SLA_NOW, 90)


@query(
    "sla_platform",
    f"""SELECT round({pct(state("success"), "COUNT(*)")}, 2) AS sla_compliance_percent,
        {pct(state("success"), "COUNT(*)")} < 95 AS compliance_issue,
        (SELECT COUNT(*) FROM x_miss WHERE "timestamp" >= {SQL_SLA_NOW} - INTERVAL 24 HOUR)
            AS sla_misses_24h FROM x_ti WHERE {DAY_BEFORE}""",
)
def _(lake):
    return runs.sla_platform(lake.tasks, lake.sla_misses, SLA_NOW)


@query(
    "sla_misses_recent",
    f"""SELECT dag_id, task_id, execution_date FROM x_miss
        WHERE "timestamp" >= {SQL_SLA_NOW} - INTERVAL 24 HOUR
        ORDER BY "timestamp" DESC, dag_id, task_id LIMIT 20""",
)
def _(lake):
    return (
        lake.sla_misses.where(F.col("timestamp") >= runs.since(SLA_NOW, 24))
        .orderBy(F.desc("timestamp"), "dag_id", "task_id")
        .limit(20)
        .select("dag_id", "task_id", "execution_date")
    )


# -- volume ----------------------------------------------------------------------------------------------

RECENT = (
    "status = 'success' AND CAST(execution_date AS DATE) >= DATE '2001-08-02' - 7"
)


@query(
    "volume_sweep",
    f"""WITH v AS (SELECT source_name, CAST(SUM(row_count) AS BIGINT) AS total_rows_7d,
            {rounded_mean("row_count")} AS avg_rows, MAX(row_count) AS max_rows, MIN(row_count) AS min_rows,
            COUNT(*) AS ingestion_count FROM x_ing WHERE {RECENT} GROUP BY 1)
        SELECT *, min_rows = 0 OR (avg_rows > 0 AND min_rows < avg_rows * 0.5::DOUBLE) AS is_anomaly FROM v""",
)
def _(lake):
    return volume.volume_sweep(lake.ingestion, ORDERS_NOW)


@query(
    "volume_anomaly",
    f"""WITH c AS (SELECT source_name, CAST(floor(SUM(row_count) / 100) AS BIGINT) AS current_count FROM x_ing
            GROUP BY 1),
        h AS (SELECT source_name, {mean("row_count")} AS m, {rounded_mean("row_count")} AS historical_avg,
            round(stddev(row_count), 2) AS historical_stddev, MIN(row_count) AS historical_min,
            MAX(row_count) AS historical_max, COUNT(*) AS sample_count FROM x_ing WHERE {RECENT} GROUP BY 1)
        SELECT c.source_name, current_count, historical_avg, historical_stddev, historical_min, historical_max,
        coalesce(sample_count, 0) AS sample_count,
        round(100.0::DOUBLE * abs(current_count - m) / m, 2) AS deviation_percent,
        coalesce(100.0::DOUBLE * abs(current_count - m) / m > 50, false) AS is_anomaly
        FROM c LEFT JOIN h ON c.source_name = h.source_name""",
)
def _(lake):
    current = lake.ingestion.groupBy("source_name").agg(
        F.floor(F.sum("row_count") / 100).alias("current_count")
    )
    return volume.volume_anomaly(current, lake.ingestion, ORDERS_NOW)


# -- health ------------------------------------------------------------------------------------------------


@query("platform_health_metrics", "SELECT * FROM x_health")
def _(lake):
    return lake.health


@query(
    "health_score",
    "SELECT metric_time, health_score, health_score AS health_score_sql FROM x_health",
)
def _(lake):
    """The score as a column expression and as the SQL function, row by row."""
    register_health_score(lake.spark)
    inputs = [
        "scheduler_healthy", "failed_tasks_24h", "sla_compliance_percent", "stale_sources_count",
        "queued_tasks",
    ]
    by_sql = f"health_score({', '.join(inputs)}) AS health_score_sql"
    return lake.health.select(
        "metric_time", health_score(*[F.col(c) for c in inputs]).alias("health_score"), F.expr(by_sql)
    )


REPORT_SCORE = HEALTH_SCORE.format(
    failed="failed_tasks_24h", sla="sla_compliance_percent", stale="stale_sources_count",
    queued="queued_tasks",
)


HEALTH_SQL = f"""WITH t AS (SELECT {state("failed")} AS failed_tasks_24h, {state("success")} AS successful_tasks_24h,
            {pct(state("failed"), "COUNT(*)")} AS rate, {state("queued")} AS day_queued,
            round({pct(state("success"), "COUNT(*)")}, 2) AS sla_compliance_percent,
            {pct(state("success"), "COUNT(*)")} AS sla_exact FROM x_ti WHERE {DAY_BEFORE}),
        b AS (SELECT CAST(floor((epoch_us({SQL_SLA_NOW}) - epoch_us(MAX(start_date))) / 1000000) AS BIGINT)
            AS heartbeat_age_seconds FROM x_ti WHERE start_date <= {SQL_SLA_NOW}),
        q AS (SELECT {state("queued")} AS queued_tasks, {state("running")} AS running_tasks FROM x_ti
            WHERE start_date >= {SQL_SLA_NOW} - INTERVAL 1 HOUR OR state IN ('queued', 'running', 'scheduled')),
        s AS ({SWEEP}), f AS (SELECT COUNT(*) FILTER (WHERE NOT is_fresh) AS stale_sources_count,
            {mean("staleness_hours")} AS avg_data_freshness_hours FROM s),
        v AS (SELECT COUNT(*) FILTER (WHERE lo = 0 OR (av > 0 AND lo < av * 0.5::DOUBLE)) AS anomalies FROM
            (SELECT MIN(row_count) AS lo, {rounded_mean("row_count")} AS av FROM x_ing WHERE {RECENT}
            GROUP BY source_name)),
        d AS (SELECT COUNT(*) AS total_dags, COUNT(*) FILTER (WHERE is_active AND NOT is_paused) AS active_dags,
            COUNT(*) FILTER (WHERE is_paused) AS paused_dags FROM x_dags),
        m AS (SELECT COUNT(*) AS sla_misses_24h FROM x_miss
            WHERE "timestamp" >= {SQL_SLA_NOW} - INTERVAL 24 HOUR),
        j AS (SELECT *, heartbeat_age_seconds <= 300 AS scheduler_healthy FROM t, b, q, f, v, d, m),
        k AS (SELECT *, {REPORT_SCORE} AS health_score, concat_ws('; ',
            CASE WHEN NOT scheduler_healthy THEN 'Scheduler unhealthy' END,
            CASE WHEN rate > 10 THEN 'High failure rate' END,
            CASE WHEN day_queued > 100 THEN 'Task queue buildup' END,
            CASE WHEN stale_sources_count > 0 THEN 'Stale sources' END,
            CASE WHEN sla_misses_24h > 0 THEN 'SLA misses' END,
            CASE WHEN sla_exact < 95 THEN 'SLA compliance below threshold' END,
            CASE WHEN anomalies > 0 THEN 'Volume anomalies' END,
            CASE WHEN queued_tasks > 100 THEN 'High queue depth' END) AS issues FROM j)
        SELECT DATE '2024-01-30' AS metric_date, {SQL_SLA_NOW} AS metric_time, scheduler_healthy,
        heartbeat_age_seconds, total_dags, active_dags, paused_dags, failed_tasks_24h, successful_tasks_24h,
        running_tasks, queued_tasks, sla_compliance_percent, sla_misses_24h, avg_data_freshness_hours,
        stale_sources_count, health_score, issues, health_score < 70 OR issues <> '' AS alert,
        CASE WHEN health_score < 70 OR issues <> '' THEN
            CASE WHEN health_score < 50 THEN 'CRITICAL' ELSE 'HIGH' END END AS alert_severity FROM k"""


def _report(lake):
    swept = _sweep(lake)
    stale = F.sum(F.col("staleness_hours").cast("decimal(18,2)")).cast("double")
    fresh = swept.agg(
        F.count_if(~F.col("is_fresh")).alias("stale_sources"),
        (stale / F.count("staleness_hours")).alias("avg_staleness_hours"),
    )
    volumes = volume.volume_sweep(lake.ingestion, ORDERS_NOW)
    return health.health_report(
        SLA_NOW,
        runs.task_snapshot(lake.tasks, lake.sla_misses, SLA_NOW),
        fresh,
        volumes.agg(F.count_if("is_anomaly").alias("anomalies")),
        runs.dag_counts(lake.dags),
    )


@query("health_report", HEALTH_SQL)
def _(lake):
    return _report(lake)


@query("health_recorded", HEALTH_SQL)
def _(lake):
    """The snapshot appended to its history and read back."""
    return health.append_metrics(_report(lake), f"{new_workspace(lake.spark, 'health')}/metrics")


@query(
    "platform_health_summary",
    """WITH bands(low, high, health_status, health_color) AS (VALUES (90, 1000, 'HEALTHY', 'green'),
            (70, 90, 'DEGRADED', 'yellow'), (-1000, 70, 'UNHEALTHY', 'red'))
        SELECT metric_time, health_score, issues, health_status, health_color
        FROM x_health JOIN (SELECT MAX(metric_time) AS metric_time FROM x_health) USING (metric_time)
        JOIN bands ON health_score >= low AND health_score < high""",
)
def _(lake):
    return health.health_summary(lake.health).select("metric_time", "health_score", "issues", "health_status", "health_color")


@query(
    "daily_health_trends",
    f"""SELECT metric_date, {mean("health_score")} AS avg_health_score, MIN(health_score) AS min_health_score,
        MAX(health_score) AS max_health_score, CAST(SUM(failed_tasks_24h) AS BIGINT) AS total_failed_tasks,
        {mean("sla_compliance_percent")} AS avg_sla_compliance,
        {mean("avg_data_freshness_hours")} AS avg_data_freshness, COUNT(*) AS check_count
        FROM x_health GROUP BY 1""",
)
def _(lake):
    return health.daily_trends(lake.health)


@query(
    "health_latest",
    """SELECT metric_time, health_score, failed_tasks_24h, sla_compliance_percent, stale_sources_count
        FROM x_health ORDER BY metric_time DESC LIMIT 1""",
)
def _(lake):
    return health.latest_score(lake.health)
