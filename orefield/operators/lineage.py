"""Lineage edges and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orefield.functions.labels import first_match
from orefield.operators.latest import insert_absent, upsert
from orefield.session import new_workspace

REACHED = "root string, node string, hops int"
WALK = "node string, next string"
EDGE_KEYS = ["source_name", "source_schema", "target_name", "target_schema"]
# Service names in qualified names, entity type per stored type.
WAREHOUSE_SERVICE = "data-warehouse-postgres.airflow"
OBJECT_SERVICE = "data-lake-minio"
DASHBOARD_SERVICE = "superset"
ENTITY_TYPES = {
    "table": "table",
    "dbt_node": "table",
    "schema": "databaseSchema",
    "container": "container",
    "dashboard": "dashboard",
}
MEDALLION_EDGES = [
    ("raw", "raw.transactions"),
    ("raw.transactions", "staging.stg_transactions"),
    ("staging.stg_transactions", "intermediate.int_daily_transactions"),
    ("staging.stg_transactions", "intermediate.int_transactions_enriched"),
    ("intermediate.int_transactions_enriched", "marts.mart_customer_analytics"),
    ("intermediate.int_transactions_enriched", "marts.mart_product_analytics"),
    ("intermediate.int_daily_transactions", "marts.mart_daily_summary"),
    ("marts.mart_customer_analytics", "customer_insights_dashboard"),
    ("marts.mart_product_analytics", "product_performance_dashboard"),
    ("marts.mart_daily_summary", "daily_operations_dashboard"),
]


def medallion_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEDALLION_EDGES, "source string, target string")


def node_name(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, r"\."), -1)


def edges_from_manifest(manifest: DataFrame, at: str) -> DataFrame:
    """Parent -> child edges from (child, parents array) rows."""
    pairs = manifest.select("child", F.explode("parents").alias("parent"))
    return pairs.select(
        F.lit("dbt_node").alias("source_type"),
        node_name(F.col("parent")).alias("source_name"),
        F.lit("dbt").alias("source_schema"),
        F.lit("dbt_node").alias("target_type"),
        node_name(F.col("child")).alias("target_name"),
        F.lit("dbt").alias("target_schema"),
        F.lit("dbt").alias("transformation_type"),
        F.lit(at).cast("timestamp_ntz").alias("updated_at"),
    ).dropDuplicates(EDGE_KEYS)


def upsert_edges(current: DataFrame, found: DataFrame) -> DataFrame:
    return upsert(current, found, EDGE_KEYS, ["updated_at"])


def absent_edges(current: DataFrame, found: DataFrame) -> DataFrame:
    return insert_absent(current, found, EDGE_KEYS)


def edge_summary(edges: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = edges.where(
        F.col("updated_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    )
    return recent.agg(
        F.count("*").alias("total_edges"),
        F.countDistinct("source_schema", "source_name").alias("source_tables"),
        F.countDistinct("target_schema", "target_name").alias("target_tables"),
        F.countDistinct("transformation_type").alias("transformation_types"),
    )


def qualified_name(kind: Column, schema: Column, name: Column) -> Column:
    in_warehouse = kind.isin("table", "dbt_node", "schema")
    return F.when(name.isNotNull() & (name != ""), first_match(
        [
            (in_warehouse, F.concat_ws(".", F.lit(WAREHOUSE_SERVICE), schema, name)),
            (kind == "container", F.concat_ws(".", F.lit(OBJECT_SERVICE), name)),
            (kind == "dashboard", F.concat_ws(".", F.lit(DASHBOARD_SERVICE), name)),
        ],
        F.concat_ws(".", schema, name),
    ))


def entity_type(kind: Column) -> Column:
    return first_match([(kind == k, F.lit(v)) for k, v in ENTITY_TYPES.items()], F.lit("table"))


def reachable(
    edges: DataFrame, roots: DataFrame, upstream: bool = False, max_hops: int | None = None
) -> DataFrame:
    """(root, node, hops) for every node reachable from each root, by the fewest hops.

    Path doubling: round k knows what is reached in fewer than 2^k hops, and the pairs that a walk of
    exactly 2^k edges joins. One join of the two reaches everything below 2^(k+1) hops, by the least sum,
    one join of the pairs with themselves doubles the walks: a chain of n nodes takes log2(n) + 2 rounds.
    A round that reaches nothing new is the last, so cycles end. Both results are written to the shared
    folder and read back: the plan stays short and a lost executor costs one round.
    """
    spark = edges.sparkSession
    folder = new_workspace(spark, "lineage")
    near, far = ("target", "source") if upstream else ("source", "target")
    _written(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct(), f"{folder}/walk=0")
    _written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")), f"{folder}/round=0")
    rounds, length = [], 1
    while max_hops is None or length <= max_hops:
        number = len(rounds)
        walks = spark.read.schema(WALK).parquet(f"{folder}/walk={number}")
        reached = _read(spark, f"{folder}/round=0", *rounds)
        ahead = reached.join(walks, "node").groupBy("root", F.col("next").alias("node")).agg((F.min("hops") + length).alias("hops"))
        ahead = ahead.join(reached.select("root", "node"), ["root", "node"], "left_anti")
        if max_hops is not None:
            ahead = ahead.where(F.col("hops") <= max_hops)
        path = f"{folder}/round={number + 1}"
        found = _written(ahead.select("root", "node", "hops"), path)
        rounds.append(path)
        length *= 2
        if not found or max_hops is not None and length > max_hops:
            break
        middle = walks.select(F.col("node").alias("start"), F.col("next").alias("node"))
        if not _written(middle.join(walks, "node").select(F.col("start").alias("node"), "next").distinct(), f"{folder}/walk={number + 1}"):
            break
    return _read(spark, *rounds) if rounds else spark.createDataFrame([], REACHED)


def _written(rows: DataFrame, path: str) -> int:
    """Write one round; its size is observed on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def _read(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(REACHED).parquet(*paths)
