"""Label columns: bands, layers, colours, severities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suite name prefix to layer, most severe first, title text to alert type.
LAYER_PREFIXES = [("raw", "raw"), ("staging", "staging"), ("mart", "marts")]
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
ALERT_TITLES = [
    ("Task Failure", "task_failure"),
    ("Data Quality", "data_quality"),
    ("SLA", "sla_miss"),
    ("Platform Health", "platform_health"),
    ("Freshness", "data_freshness"),
    ("Volume", "volume_anomaly"),
]


def first_match(cases, otherwise) -> Column:
    """Ordered (condition, value) pairs; the first that holds wins."""
    expr = None
    for condition, value in cases:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr.otherwise(otherwise)


def band(value: Column, floors, lowest) -> Column:
    """Label of the highest floor reached, ``floors`` given from high to low."""
    return first_match([(value >= floor, F.lit(label)) for floor, label in floors], F.lit(lowest))


def layer_of_suite(suite: Column) -> Column:
    return first_match(
        [(suite.startswith(prefix), F.lit(layer)) for prefix, layer in LAYER_PREFIXES],
        F.lit("other"),
    )


def layer_mentioned(suite: Column) -> Column:
    """The report's looser rule: the word may stand anywhere in the name."""
    lowered = F.lower(suite)
    return first_match(
        [(lowered.contains(word), F.lit(layer)) for word, layer in LAYER_PREFIXES], F.lit("other")
    )


def severity_rank(severity: Column) -> Column:
    """1 for critical down to 4 for low, 5 for anything else."""
    ranks = [(F.lower(severity) == name, F.lit(i + 1)) for i, name in enumerate(SEVERITY_ORDER)]
    return first_match(ranks, F.lit(5))


def alert_type_of_title(title: Column) -> Column:
    return first_match(
        [(title.contains(text), F.lit(kind)) for text, kind in ALERT_TITLES], F.lit("general")
    )


# The limits and words of the status labels below.


def freshness_color(hours: Column) -> Column:
    return first_match([(hours < 6, F.lit("green")), (hours < 24, F.lit("yellow"))], F.lit("red"))


def freshness_status(is_fresh: Column, hours: Column) -> Column:
    return first_match([(~is_fresh, F.lit("STALE")), (hours < 6, F.lit("FRESH"))], F.lit("AGING"))


def health_status(score: Column) -> Column:
    return band(score, [(90, "HEALTHY"), (70, "DEGRADED")], "UNHEALTHY")


def health_color(score: Column) -> Column:
    return band(score, [(90, "green"), (70, "yellow")], "red")
