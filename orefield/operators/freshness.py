"""Freshness of sources and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import freshness_color, freshness_status, hours_between, layer_of_suite
from orefield.operators.latest import first_per_key, latest_per_source

# Hours within which each layer counts as fresh.
SWEEP_HOURS = {"raw": 24, "staging": 12, "marts": 6}
ALERT_HOURS = {"raw": 24, "staging": 24, "marts": 48}
GOVERNANCE_HOURS = {"bronze": 4, "silver": 6, "gold": 8}


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def hours_allowed(layer: Column, hours: dict[str, int] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (hours or SWEEP_HOURS).items() for x in kv])
    return F.element_at(table, layer)


def source_freshness(ledger: DataFrame, as_of: str, max_hours: int = 24, layer="raw") -> DataFrame:
    """Every source against one limit (reached exactly still counts); no success yet is stale."""
    done = F.when(F.col("status") == "success", F.col("updated_at"))
    exact = hours_between(_now(as_of), "last_update", digits=None)
    return (
        ledger.groupBy("source_name")
        .agg(F.max(done).alias("last_update"))
        .select(
            "source_name",
            F.lit(layer).alias("layer"),
            "last_update",
            F.round(exact, 2).alias("staleness_hours"),
            F.coalesce(exact <= max_hours, F.lit(False)).alias("is_fresh"),
            F.lit(max_hours).alias("threshold_hours"),
        )
    )


class StaleError(Exception):
    """A source is older than it may be."""


def require_fresh(checked: DataFrame, shown: int = 5) -> None:
    """Raise with the stalest sources of a freshness check; a source never loaded has no age."""
    stale = checked.where(~F.col("is_fresh"))
    rows = stale.orderBy(F.desc_nulls_first("staleness_hours"), "source_name").limit(shown).collect()
    if rows:
        def age(hours):
            return "never loaded" if hours is None else f"{hours:.1f}h"

        names = ", ".join(f"{r['source_name']} ({age(r['staleness_hours'])})" for r in rows)
        raise StaleError(f"{stale.count()} stale sources: {names}")


def freshness_state(df: DataFrame, column: str, as_of: str, warn_hours=24, error_hours=48) -> DataFrame:
    """pass / warn / error by the age of the newest row; an empty table is an error."""
    return (
        df.agg(F.max(column).cast("timestamp_ntz").alias("max_loaded_at"))
        .withColumn("exact", hours_between(_now(as_of), "max_loaded_at", digits=None))
        .select(
            "max_loaded_at",
            F.round("exact", 2).alias("age_hours"),
            F.when(F.col("exact") <= warn_hours, "pass")
            .when(F.col("exact") <= error_hours, "warn")
            .otherwise("error")
            .alias("state"),
        )
    )


def status_view(metrics: DataFrame) -> DataFrame:
    """Latest check per source and layer, with its colour and status."""
    latest = latest_per_source(metrics, ["source_name", "layer"], "check_time", ["id"])
    return latest.select(
        "source_name", "layer", "last_update_time", "row_count", "check_time", "is_fresh",
        "staleness_hours", "expected_freshness_hours",
        freshness_color(F.col("staleness_hours")).alias("freshness_color"),
        freshness_status(F.col("is_fresh"), F.col("staleness_hours")).alias("freshness_status"),
    )


def sweep(
    ledger: DataFrame,
    watermarks: DataFrame,
    validations: DataFrame,
    as_of: str,
    hours: dict[str, int] | None = None,
) -> DataFrame:
    """Freshness of all layers at once: ingestion ledger, watermarks and validated tables."""
    ingested = (
        ledger.where(F.col("status") == "success")
        .groupBy("source_name")
        .agg(F.max("updated_at").alias("last_update"), F.sum("row_count").alias("row_count"))
        .select("source_name", F.lit("raw").alias("layer"), "last_update", "row_count")
    )
    marks = watermarks.select(
        F.concat_ws(".", "source_name", "watermark_column").alias("source_name"),
        F.lit("raw").alias("layer"),
        F.col("updated_at").alias("last_update"),
        F.lit(0).cast("bigint").alias("row_count"),
    )
    layer = layer_of_suite(F.col("expectation_suite_name"))
    validated = (
        validations.where(F.col("success") & layer.isin("staging", "marts"))
        .groupBy(F.col("data_asset_name").alias("source_name"), layer.alias("layer"))
        .agg(F.max("validation_time").alias("last_update"))
        .withColumn("row_count", F.lit(0).cast("bigint"))
    )
    exact = hours_between(_now(as_of), "last_update", digits=None)
    return (
        ingested.unionByName(marks)
        .unionByName(validated)
        .withColumn("threshold_hours", hours_allowed(F.col("layer"), hours))
        .withColumn("staleness_hours", F.round(exact, 2))
        .withColumn("is_fresh", F.coalesce(exact < F.col("threshold_hours"), F.lit(False)))
    )


def stale_sources(swept: DataFrame) -> DataFrame:
    """Every stale source of every layer, one row each."""
    return swept.where(~F.col("is_fresh")).select("layer", "source_name", "staleness_hours", "threshold_hours")


def layer_summary(swept: DataFrame, hours: dict[str, int] | None = None, shown: int = 5) -> DataFrame:
    """Totals per layer, layers without any source included, and for display the ``shown`` stalest by name.

    ``stale`` counts all; ``stale_sources`` lists them.
    """
    table = hours or SWEEP_HOURS
    layers = swept.sparkSession.createDataFrame(
        list(table.items()), "layer string, threshold_hours int"
    )
    hours_total = F.sum(F.col("staleness_hours").cast("decimal(18,2)")).cast("double")
    counted = swept.groupBy("layer").agg(
        F.count("*").alias("total"),
        F.count_if("is_fresh").alias("fresh"),
        F.count_if(~F.col("is_fresh")).alias("stale"),
        (hours_total / F.count("staleness_hours")).alias("avg_staleness_hours"),
    )
    # Cut to the few shown before they are gathered into one value.
    stalest = first_per_key(
        swept.where(~F.col("is_fresh")),
        ["layer"],
        [F.desc("staleness_hours"), F.asc("source_name")],
        shown,
    )
    named = stalest.groupBy("layer").agg(
        F.array_join(F.sort_array(F.collect_list("source_name")), ",").alias("stale_sources")
    )
    zero = {"total": 0, "fresh": 0, "stale": 0, "stale_sources": ""}
    return layers.join(counted, "layer", "left").join(named, "layer", "left").fillna(zero)


def heatmap(status: DataFrame, layers=("raw", "staging", "marts")) -> DataFrame:
    """Mean staleness by source (rows) and layer (columns); the pivot values are fixed."""
    mean = F.sum("staleness_hours").cast("double") / F.count("staleness_hours")
    return status.groupBy("source_name").pivot("layer", list(layers)).agg(mean)


def heartbeat_age(events: DataFrame, producer: str, at: str, as_of: str, limit_seconds=300) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("last_seen"), _now(as_of))
    return (
        events.groupBy(F.col(producer).alias("producer"))
        .agg(F.max(at).alias("last_seen"))
        .select(
            "producer", "last_seen", age.alias("age_seconds"),
            (age <= limit_seconds).alias("healthy"),
        )
    )
