"""Queries: catalog, ownership, lineage, masking, retention."""

from pyspark.sql import functions as F

from orefield.operators import governance, lineage
from orefield.session import new_workspace
from orefield.sources.schemas import schema_of_frames
from orefield.sources.tables import write_daily_partitions
from orefield.workload.oracle_tables import ORDERS_NOW as SQL_ORDERS_NOW
from orefield.workload.registry import query
from orefield.workload.tables import ORDERS_NOW


def _frames(lake):
    return {
        ("raw", "transactions"): lake.raw_transactions,
        ("staging", "stg_transactions"): lake.stg,
        ("intermediate", "int_transactions_enriched"): lake.enriched,
        ("intermediate", "int_daily_transactions"): lake.daily,
        ("marts", "mart_customer_analytics"): lake.customer_mart,
        ("marts", "mart_product_analytics"): lake.product_mart,
        ("marts", "mart_daily_summary"): lake.daily_summary,
    }


def _stored_frames(lake):
    """The same with every model written once, as its catalog would find it: counts come from footers."""
    root, out = new_workspace(lake.spark, "catalog"), {}
    for (schema, table), df in _frames(lake).items():
        if schema != "raw":
            df.write.parquet(f"{root}/{schema}/{table}")
            df = lake.spark.read.schema(df.schema).parquet(f"{root}/{schema}/{table}")
        out[schema, table] = df
    return out


@query(
    "catalog_tables",
    """SELECT 'raw' AS schema_name, 'transactions' AS table_name, 7 AS column_count, COUNT(*) AS row_count
            FROM x_raw
        UNION ALL SELECT 'staging', 'stg_transactions', 8, COUNT(*) FROM x_stg
        UNION ALL SELECT 'intermediate', 'int_transactions_enriched', 13, COUNT(*) FROM x_enr
        UNION ALL SELECT 'intermediate', 'int_daily_transactions', 7, COUNT(*) FROM x_daily
        UNION ALL SELECT 'marts', 'mart_customer_analytics', 10, COUNT(*) FROM x_cust
        UNION ALL SELECT 'marts', 'mart_product_analytics', 9, COUNT(*) FROM x_prod
        UNION ALL SELECT 'marts', 'mart_daily_summary', 7, COUNT(*) FROM x_summary""",
)
def _(lake):
    out = None
    for (schema, table), df in _stored_frames(lake).items():
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"),
            F.lit(len(df.columns)).alias("column_count"), "row_count",
        )
        out = one if out is None else out.unionByName(one)
    return out


# Columns and types each model is expected to have.
LINE = "transaction_id bigint, customer_id bigint, product_id bigint"
TYPES = {
    ("raw", "transactions", "x_raw"): f"{LINE}, amount double, currency string, quantity int, timestamp timestamp_ntz",
    ("staging", "stg_transactions", "x_stg"): f"{LINE}, amount decimal(18;2), currency string, quantity int, "
    "transaction_timestamp timestamp_ntz, _loaded_at timestamp_ntz",
    ("intermediate", "int_transactions_enriched", "x_enr"): f"{LINE}, amount decimal(18;2), currency string, "
    "quantity int, transaction_timestamp timestamp_ntz, total_value decimal(18;2), transaction_hour int, "
    "transaction_day_of_week int, is_high_value boolean, time_category string, _loaded_at timestamp_ntz",
    ("intermediate", "int_daily_transactions", "x_daily"): "transaction_date date, total_transactions bigint, "
    "total_amount decimal(28;2), avg_amount double, unique_customers bigint, unique_products bigint, "
    "total_revenue decimal(28;2)",
    ("marts", "mart_customer_analytics", "x_cust"): "customer_id bigint, total_transactions bigint, "
    "total_spent decimal(28;2), avg_transaction_value double, first_transaction_date timestamp_ntz, "
    "last_transaction_date timestamp_ntz, customer_lifetime_days int, unique_products_purchased bigint, "
    "high_value_transaction_count bigint, total_units_purchased bigint",
    ("marts", "mart_product_analytics", "x_prod"): "product_id bigint, total_transactions bigint, "
    "total_units_sold bigint, total_revenue decimal(28;2), unique_customers bigint, avg_price_per_unit double, "
    "first_sale_date timestamp_ntz, last_sale_date timestamp_ntz, high_value_transaction_count bigint",
    ("marts", "mart_daily_summary", "x_summary"): "date date, total_transactions bigint, "
    "total_revenue decimal(28;2), total_amount decimal(28;2), avg_transaction_value double, "
    "unique_customers bigint, unique_products bigint",
}
PORTABLE = {
    "bigint": "integer", "int": "integer", "double": "float", "decimal": "float", "boolean": "boolean",
    "date": "timestamp", "timestamp_ntz": "timestamp", "string": "string",
}


def catalog_sql():
    parts = []
    for (schema, table, source), columns in TYPES.items():
        for i, column in enumerate(columns.split(", ")):
            name, dtype = column.replace(";", ",").split(" ")
            parts.append(
                f"SELECT '{schema}' AS schema_name, '{table}' AS table_name, {i + 1} AS position, "
                f"'{name}' AS column_name, '{dtype}' AS data_type, '{PORTABLE[dtype.split('(')[0]]}' "
                f"AS portable_type, COUNT(*) FILTER (WHERE \"{name}\" IS NULL) AS null_count FROM {source}"
            )
    return " UNION ALL ".join(parts)


@query("catalog_columns", catalog_sql())
def _(lake):
    """Column catalog with the null count of each column over the whole table."""
    frames = _stored_frames(lake)
    catalog = schema_of_frames(frames, lake.spark)
    counted = None
    for (schema, table), df in frames.items():
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        rows = nulls.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
                        for c in df.columns
                    ]
                )
            ).alias("r")
        ).select(F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "r.*")
        counted = rows if counted is None else counted.unionByName(rows)
    return catalog.join(counted, ["schema_name", "table_name", "column_name"])


@query(
    "lineage_edges_upsert",
    """WITH p AS (SELECT o_custkey, 'orders_' || (o_orderkey % 50) AS source_name FROM orders
            UNION SELECT o_custkey, 'seg_' || (o_custkey % 5) FROM orders),
        e AS (SELECT source_name, 'cust_' || o_custkey AS target_name, o_custkey % 3 < 2 AS old, o_custkey % 3 > 0 AS new FROM p)
        SELECT 'dbt_node' AS source_type, source_name, 'dbt' AS source_schema, 'dbt_node' AS target_type,
        target_name, 'dbt' AS target_schema, 'dbt' AS transformation_type,
        if(new, TIMESTAMP '2024-01-31 00:00:00', TIMESTAMP '2024-01-01 00:00:00') AS updated_at FROM e""",
)
def _(lake):
    """Edges of an older manifest and those of a newer one: a third in either alone, a third in both."""
    third = F.substring_index("child", "_", -1).cast("bigint") % 3
    old = lineage.edges_from_manifest(lake.manifest.where(third < 2), "2024-01-01")
    new = lineage.edges_from_manifest(lake.manifest.where(third > 0), "2024-01-31")
    return lineage.upsert_edges(old, new)


@query(
    "lineage_insert_absent",
    """SELECT DISTINCT source_name, source_schema, target_name, target_schema FROM x_edge n
        WHERE updated_at >= TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM x_edge o
            WHERE o.updated_at < TIMESTAMP '1999-01-01' AND o.source_name = n.source_name
            AND o.source_schema = n.source_schema AND o.target_name = n.target_name
            AND o.target_schema = n.target_schema)""",
)
def _(lake):
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    current = lake.edges.where(F.col("updated_at") < cut)
    found = lake.edges.where(F.col("updated_at") >= cut)
    return lineage.absent_edges(current, found).select(*lineage.EDGE_KEYS)


@query(
    "lineage_summary",
    f"""SELECT COUNT(*) AS total_edges, COUNT(DISTINCT source_schema || '.' || source_name) AS source_tables,
        COUNT(DISTINCT target_schema || '.' || target_name) AS target_tables,
        COUNT(DISTINCT transformation_type) AS transformation_types FROM x_edge
        WHERE updated_at >= {SQL_ORDERS_NOW} - INTERVAL 30 DAY""",
)
def _(lake):
    return lineage.edge_summary(lake.edges, ORDERS_NOW)


@query(
    "lineage_fqn",
    """SELECT id, CASE WHEN source_type IN ('table', 'dbt_node', 'schema')
            THEN 'data-warehouse-postgres.airflow.' || source_schema || '.' || source_name
            WHEN source_type = 'container' THEN 'data-lake-minio.' || source_name
            WHEN source_type = 'dashboard' THEN 'superset.' || source_name
            ELSE source_schema || '.' || source_name END AS fqn,
        CASE source_type WHEN 'schema' THEN 'databaseSchema' WHEN 'container' THEN 'container'
            WHEN 'dashboard' THEN 'dashboard' ELSE 'table' END AS entity_type FROM x_edge""",
)
def _(lake):
    kind = F.col("source_type")
    return lake.edges.select(
        "id",
        lineage.qualified_name(kind, F.col("source_schema"), F.col("source_name")).alias("fqn"),
        lineage.entity_type(kind).alias("entity_type"),
    )


@query(
    "lineage_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'part_' || l_partkey AS source, 'supplier_' || l_suppkey AS target
            FROM lineitem
            UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
            UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation),
        r AS (SELECT 'region_' || r_regionkey AS root, 'region_' || r_regionkey AS node, 0 AS hops FROM region
            UNION SELECT r.root, e.source, r.hops + 1 FROM r JOIN e ON e.target = r.node)
        SELECT root, node, MIN(hops) AS hops FROM r WHERE hops > 0 GROUP BY 1, 2""",
)
def _(lake):
    """Everything upstream of each region: nations, suppliers and the parts they supplied."""
    roots = lake.table("region").select(
        F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("root")
    )
    return lineage.reachable(lake.supply_edges, roots, upstream=True)


@query(
    "active_ownership",
    """WITH g AS (SELECT dataset_name, schema_name, COUNT(*) FILTER (WHERE status = 'approved') AS n FROM x_req
            GROUP BY 1, 2),
        t AS (SELECT id, source_name AS d, source_schema AS s FROM x_edge
            UNION SELECT id, target_name, target_schema FROM x_edge),
        l AS (SELECT d, s, COUNT(DISTINCT id) AS n FROM t GROUP BY 1, 2)
        SELECT x_own.*, coalesce(g.n, 0) AS active_access_grants, coalesce(l.n, 0) AS lineage_connections
        FROM x_own LEFT JOIN g ON x_own.dataset_name = g.dataset_name AND x_own.schema_name = g.schema_name
        LEFT JOIN l ON x_own.dataset_name = l.d AND x_own.schema_name = l.s""",
)
def _(lake):
    return governance.active_ownership(lake.owners, lake.access_requests, lake.edges)


UNOWNED = """SELECT schema_name, table_name FROM x_cat c WHERE NOT EXISTS (SELECT 1 FROM x_own o
    WHERE o.schema_name = c.schema_name AND o.dataset_name = c.table_name)"""


@query("tables_without_owner", UNOWNED)
def _(lake):
    return governance.tables_without_owner(lake.catalog_tables, lake.owners)


@query(
    "metadata_quality",
    f"""WITH u AS (SELECT COUNT(*) AS unowned_tables FROM ({UNOWNED})),
        d AS (SELECT COUNT(*) FILTER (WHERE description IS NULL) AS undocumented_columns FROM x_cat),
        q AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - (unowned_tables * 10 + undocumented_columns) * 0.5::DOUBLE)
            AS quality_score FROM u, d)
        SELECT *, CASE WHEN quality_score < 50 THEN 'critical' WHEN quality_score < 80 THEN 'warning'
            ELSE 'healthy' END AS overall_status FROM q""",
)
def _(lake):
    return governance.metadata_quality(lake.catalog_tables, lake.catalog_columns, lake.owners)


@query(
    "pii_mask",
    r"""SELECT dataset_name, regexp_replace(regexp_replace(owner_name, '[A-Za-z]', 'x', 'g'), '[0-9]', 'n', 'g')
            AS owner_name, sha256(owner_email) AS owner_email, owner_team,
        regexp_replace(regexp_replace(steward_name, '[A-Za-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS steward_name
        FROM x_own""",
)
def _(lake):
    rows = lake.owners.select("dataset_name", "owner_name", "owner_email", "owner_team", "steward_name")
    tags = {"owner_name": "direct", "steward_name": "direct", "owner_email": "indirect"}
    return governance.mask(rows, tags)


@query(
    "retention_report",
    """SELECT order_date AS partition_date, COUNT(*) AS row_count, 'silver' AS layer,
        order_date + 90 AS expires_on, order_date < DATE '2001-08-02' - 90 AS expired
        FROM x_orders GROUP BY 1""",
)
def _(lake):
    return governance.retention_report(lake.stg_orders, ORDERS_NOW, "silver", "order_date")


@query(
    "retention_kept",
    "SELECT order_id, order_date, total_amount FROM x_orders WHERE order_date >= DATE '2001-08-02' - 90",
)
def _(lake):
    kept = governance.within_retention(lake.stg_orders, ORDERS_NOW, "silver", "order_date")
    return kept.select("order_id", "order_date", "total_amount")


@query(
    "retention_removed",
    """SELECT year(order_date)::INTEGER AS year, month(order_date)::INTEGER AS month, COUNT(*) AS orders
        FROM x_orders WHERE order_date >= DATE '2001-08-02' - 90 GROUP BY 1, 2""",
)
def _(lake):
    """What is left of a daily table once its expired folders are gone, read back from storage."""
    path = f"{new_workspace(lake.spark, 'retention')}/orders"
    write_daily_partitions(lake.stg_orders.select("order_id", "order_date"), "order_date", path)
    governance.drop_expired(lake.spark, path, ORDERS_NOW, "silver")
    held = lake.spark.read.schema("order_id bigint, order_date date, year int, month int, day int").parquet(path)
    return held.groupBy("year", "month").agg(F.count("*").alias("orders"))
