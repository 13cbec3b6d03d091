"""Platform health score as a column expression and as a SQL function."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values: (input, comparison, [(limit, penalty) from worst to mildest]).
SCHEDULER_PENALTY = 20
FAILED_TASK_STEPS = [(10, 25), (5, 15), (0, 5)]
SLA_STEPS = [(80, 25), (90, 15), (95, 5)]
STALE_SOURCE_STEPS = [(5, 20), (2, 10), (0, 5)]
QUEUE_STEPS = [(100, 10), (50, 5)]


def _stepped(value: Column, steps, over: bool) -> Column:
    expr = None
    for limit, penalty in steps:
        hit = value > limit if over else value < limit
        expr = F.when(hit, penalty) if expr is None else expr.when(hit, penalty)
    return expr.otherwise(0)


def health_score(
    scheduler_healthy: Column,
    failed_tasks: Column,
    sla_compliance: Column,
    stale_sources: Column,
    queued_tasks: Column,
) -> Column:
    penalty = (
        F.when(~scheduler_healthy, SCHEDULER_PENALTY).otherwise(0)
        + _stepped(failed_tasks, FAILED_TASK_STEPS, over=True)
        + _stepped(sla_compliance, SLA_STEPS, over=False)
        + _stepped(stale_sources, STALE_SOURCE_STEPS, over=True)
        + _stepped(queued_tasks, QUEUE_STEPS, over=True)
    )
    return F.greatest(F.lit(100) - penalty, F.lit(0)).cast("int")


def _sql_steps(name, steps, op):
    whens = " ".join(f"WHEN {name} {op} {limit} THEN {penalty}" for limit, penalty in steps)
    return f"(CASE {whens} ELSE 0 END)"


def register_health_score(spark: SparkSession, name: str = "health_score") -> None:
    """Offer the score to SQL users; Catalyst inlines the body, there is no UDF call."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(
            scheduler_healthy BOOLEAN, failed_tasks BIGINT, sla_compliance DOUBLE,
            stale_sources BIGINT, queued_tasks BIGINT) RETURNS INT
        RETURN CAST(greatest(100
            - (CASE WHEN NOT scheduler_healthy THEN {SCHEDULER_PENALTY} ELSE 0 END)
            - {_sql_steps("failed_tasks", FAILED_TASK_STEPS, ">")}
            - {_sql_steps("sla_compliance", SLA_STEPS, "<")}
            - {_sql_steps("stale_sources", STALE_SOURCE_STEPS, ">")}
            - {_sql_steps("queued_tasks", QUEUE_STEPS, ">")}, 0) AS INT)"""
    )
