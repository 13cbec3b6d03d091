"""Ownership, metadata quality, masking and retention."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import mask_column
from orefield.functions.labels import first_match

# Fixed values
RETENTION_DAYS = {"bronze": 2555, "silver": 90}
COMPLETENESS_TARGETS = {"bronze": 95.0, "silver": 99.0, "gold": 99.5}
OWNER_COLUMNS = [
    "dataset_name", "schema_name", "database_name", "owner_name", "owner_email", "owner_team",
    "steward_name", "steward_email", "business_domain", "data_classification", "pii_flag",
]


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """(schema, dataset) rows an edge touches; an edge from a dataset to itself touches one."""
    ends = F.array(
        F.struct(F.col("source_schema").alias("schema_name"), F.col("source_name").alias("dataset_name")),
        F.struct(F.col("target_schema").alias("schema_name"), F.col("target_name").alias("dataset_name")),
    )
    return edges.select("id", F.explode(F.array_distinct(ends)).alias("end")).select("id", "end.*")


def active_ownership(owners: DataFrame, requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Owners with their approved grants and lineage connections.

    "Source or target matches" is asked as an equi-join on unpivoted endpoints, and both sides
    are counted per dataset before they are joined, so neither nested loops nor a
    requests x edges fan-out arise. Ids are primary keys, hence plain counts.
    """
    keys = ["dataset_name", "schema_name"]
    grants = requests.groupBy(*keys).agg(
        F.count_if(F.col("status") == "approved").alias("active_access_grants")
    )
    links = edge_endpoints(edges).groupBy(*keys).agg(F.count("id").alias("lineage_connections"))
    return (
        owners.select(*OWNER_COLUMNS)
        .distinct()
        .join(grants, keys, "left")
        .join(links, keys, "left")
        .fillna(0, ["active_access_grants", "lineage_connections"])
    )


def tables_without_owner(tables: DataFrame, owners: DataFrame) -> DataFrame:
    """Tables (schema_name, table_name) that no owner row names."""
    owned = owners.select("schema_name", F.col("dataset_name").alias("table_name")).distinct()
    return tables.select("schema_name", "table_name").join(
        owned, ["schema_name", "table_name"], "left_anti"
    )


def metadata_quality(
    tables: DataFrame, columns: DataFrame, owners: DataFrame, errors: int = 0
) -> DataFrame:
    """Score = 100 - half of (10 per unowned table + 1 per undocumented column), floor 0."""
    unowned = tables_without_owner(tables, owners).agg(F.count("*")).scalar()
    issues = F.col("unowned_tables") * 10 + F.col("undocumented_columns")
    score = F.col("quality_score")
    status = first_match(
        [
            (F.lit(errors > 5) | (score < 50), F.lit("critical")),
            (F.lit(errors > 0) | (score < 80), F.lit("warning")),
        ],
        F.lit("healthy"),
    )
    return (
        columns.agg(F.count_if(F.col("description").isNull()).alias("undocumented_columns"))
        .withColumn("unowned_tables", unowned)
        .withColumn("quality_score", F.greatest(F.lit(0.0), F.lit(100.0) - issues * F.lit(0.5)))
        .withColumn("overall_status", status)
    )


def mask(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Apply column tags (direct / indirect); untagged columns pass unchanged."""
    return df.select(
        *[mask_column(c, tags[c]).alias(c) if c in tags else F.col(c) for c in df.columns]
    )


def retention_report(
    parts: DataFrame, as_of: str, layer: str, day: str, days: dict[str, int] | None = None
) -> DataFrame:
    """Rows and expiry per daily partition of a layer."""
    keep = (days or RETENTION_DAYS)[layer]
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), keep)
    return (
        parts.groupBy(F.col(day).alias("partition_date"))
        .agg(F.count("*").alias("row_count"))
        .withColumn("layer", F.lit(layer))
        .withColumn("expires_on", F.date_add("partition_date", keep))
        .withColumn("expired", F.col("partition_date") < cutoff)
    )


def drop_expired(spark: SparkSession, path: str, as_of: str, layer: str, days: dict[str, int] | None = None) -> int:
    """Remove the expired year= / month= / day= folders of a table; returns how many went.

    The driver sees the table's listing only. Folders go one by one, so a run that is lost can be repeated.
    """
    keep = (days or RETENTION_DAYS)[layer]
    cutoff = date.fromisoformat(as_of[:10]) - timedelta(days=keep)
    held = spark.read.parquet(path).select("year", "month", "day").distinct().collect()
    old = [r for r in held if date(r["year"], r["month"], r["day"]) < cutoff]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in old:
        fs.delete(hadoop(f"{path}/year={r['year']}/month={r['month']}/day={r['day']}"), True)
    return len(old)


def within_retention(df: DataFrame, as_of: str, layer: str, day: str) -> DataFrame:
    """Rows to keep; on a date-partitioned table the filter prunes whole partitions."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), RETENTION_DAYS[layer])
    return df.where(F.col(day) >= cutoff)


def completeness(df: DataFrame, columns: list[str], layer: str) -> DataFrame:
    """Share of non-null values per column against the layer's objective."""
    target = COMPLETENESS_TARGETS[layer]
    counted = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in columns]
    )
    share = F.try_divide(F.lit(100.0) * F.col("r.present").cast("double"), F.col("n").cast("double"))
    return (
        counted.select("n", F.explode(rows).alias("r"))
        .select(F.lit(layer).alias("layer"), "r.column_name", share.alias("completeness_percent"))
        .withColumn("target_percent", F.lit(target))
        .withColumn("meets_target", F.col("completeness_percent") > target)
    )
