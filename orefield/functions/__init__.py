"""Functions from Column to Column; everything stays inside JVM codegen."""

from orefield.functions.keys import dataset_fingerprint, row_digest, surrogate_key
from orefield.functions.labels import (
    alert_type_of_title,
    band,
    freshness_color,
    freshness_status,
    health_color,
    health_status,
    layer_of_suite,
    layer_mentioned,
    severity_rank,
)
from orefield.functions.masking import mask_column
from orefield.functions.numeric import average, percent, ratio, rounded_average, to_integer
from orefield.functions.scoring import health_score, register_health_score
from orefield.functions.text import title_case
from orefield.functions.times import convert_timestamp, hours_between, seconds_between

__all__ = [
    "alert_type_of_title",
    "average",
    "band",
    "convert_timestamp",
    "dataset_fingerprint",
    "freshness_color",
    "freshness_status",
    "health_color",
    "health_score",
    "health_status",
    "hours_between",
    "layer_mentioned",
    "layer_of_suite",
    "mask_column",
    "percent",
    "ratio",
    "register_health_score",
    "rounded_average",
    "row_digest",
    "seconds_between",
    "severity_rank",
    "surrogate_key",
    "title_case",
    "to_integer",
]
