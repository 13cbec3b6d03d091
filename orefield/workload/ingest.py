"""Queries: file and table ingestion, loads, layers, schemas, ledgers, watermarks.

The writing queries land their data in a fresh folder below the session's shared directory and
report on what they wrote, so their work grows with the given tables.
"""

from pyspark.sql import functions as F

from orefield.functions import dataset_fingerprint
from orefield.operators import ledger, watermarks
from orefield.plans import customers, sales
from orefield.plans.snapshots import apply_snapshot, slowly_changing
from orefield.session import new_workspace
from orefield.sources import files, json_types, layers, schemas, tables
from orefield.workload.registry import query
from orefield.workload.tables import EVENTS_NOW

ALL = "SELECT * FROM "
ORDER_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_seen", "o_orderpriority", "o_note",
]
# Quotes and line breaks inside quoted text.
TEXT = {"multiLine": True, "escape": '"'}


def sql_fingerprint(columns):
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '_null_')" for c in columns)
    digest = f"CAST(concat('0x', substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT)"
    return f"CAST(SUM({digest}) AS DECIMAL(38,0))"


def sql_manifest(source, condition="true"):
    return f"""SELECT '{source}' AS source_name, COUNT(*) AS row_count,
        {sql_fingerprint(ORDER_COLUMNS)} AS fingerprint FROM x_ord WHERE {condition}"""


def manifest(source, df, row_count=None):
    counted = F.count("*") if row_count is None else F.lit(row_count).cast("bigint")
    return df.agg(
        counted.alias("row_count"), dataset_fingerprint(*ORDER_COLUMNS).alias("fingerprint")
    ).select(F.lit(source).alias("source_name"), "row_count", "fingerprint")


def _orders(lake):
    """Orders with money, a date, a time, and free text with quotes, line breaks and nulls."""
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\n then; é '), F.col("o_custkey").cast("string"))
    return lake.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
        F.to_date("o_orderdate").alias("o_orderdate"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").cast("timestamp_ntz").alias("o_seen"),
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 > 0, note).alias("o_note"),
    )


# -- files ---------------------------------------------------------------------------------------


@query("src_csv_ingest", sql_manifest("orders.csv"))
def _(lake):
    """CSV part files -> bronze Parquet; the row count is the one observed by the load."""
    root = new_workspace(lake.spark, "csv")
    tables.export_csv(_orders(lake), f"{root}/in")
    schema = _orders(lake).schema
    done = files.ingest_file(lake.spark, f"{root}/in", root, "orders/orders.csv", "csv", schema, **TEXT)
    return manifest("orders.csv", lake.spark.read.parquet(done.uri), done.row_count)


@query("src_json_ingest", sql_manifest("orders.json"))
def _(lake):
    root = new_workspace(lake.spark, "json")
    _orders(lake).write.json(f"{root}/in")
    schema = _orders(lake).schema
    done = files.ingest_file(lake.spark, f"{root}/in", root, "orders/orders.json", "json", schema)
    return manifest("orders.json", lake.spark.read.parquet(done.uri), done.row_count)


PAGE_ROWS = 100


@query("src_json_pages", sql_manifest("orders_api"))
def _(lake):
    """Landed API responses: pages of a bounded number of records in one JSON document each."""
    root = new_workspace(lake.spark, "pages")
    orders = _orders(lake)
    # Pages are cut inside each part, so that no key, null or repeated, can make a page grow.
    place = F.monotonically_increasing_id()
    parts = orders.withColumns({"part": F.spark_partition_id(), "page": F.floor(place.bitwiseAND((1 << 33) - 1) / PAGE_ROWS)})
    pages = parts.groupBy("part", "page").agg(F.collect_list(F.struct(*ORDER_COLUMNS)).alias("items")).drop("part")
    pages.write.json(f"{root}/in")
    rows = files.landed_json_pages(lake.spark, f"{root}/in", "items", pages.schema)
    rows.write.parquet(layers.layer_path(root, "bronze", "orders_api.parquet"))
    return manifest(
        "orders_api", lake.spark.read.parquet(layers.layer_path(root, "bronze", "orders_api.parquet"))
    )


def _batch_sql(where, name, kind, status="success", bad=0, error="NULL"):
    return f"""SELECT '{name}' AS source, '{kind}' AS file_type, COUNT(*) AS row_count, {bad} AS bad_rows,
        '{status}' AS status, {error} AS error, coalesce({sql_fingerprint(BATCH_COLUMNS)}, 0) AS fingerprint FROM x_ord WHERE {where}"""


BATCH_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "src_batch_glob",
    " UNION ALL ".join(
        [
            _batch_sql("o_orderkey % 4 = 0", "lines", "json"),
            _batch_sql("o_orderkey % 4 = 1", "array", "json"),
            _batch_sql("o_orderkey % 4 = 2", "turned", "csv"),
            _batch_sql("false", "header", "csv"),
            """SELECT 'broken', 'csv', (SELECT COUNT(*) FROM x_ord WHERE o_orderkey % 4 = 3), 1, 'failed', '1 malformed records', 0""",
            """SELECT 'nothing', 'json', 0, 0, 'failed', 'empty file', 0""",
        ]
    ),
)
def _(lake):
    """NDJSON, an array over several lines, CSV in another column order, a header alone, a broken and an empty file.

    The outcome of each file, with the fingerprint of what its bronze partition holds.
    """
    root, spark = new_workspace(lake.spark, "batch"), lake.spark
    orders, part = _orders(lake).select(BATCH_COLUMNS), F.col("o_orderkey") % 4
    folder = f"{root}/in"
    orders.where(part == 0).coalesce(1).write.json(f"{folder}/lines")
    documents = orders.where(part == 1).select(F.to_json(F.struct("*")).alias("value"))
    lines = documents.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("value")), ",\n"), F.lit("\n]")).alias("value"))
    lines.write.option("lineSep", "\n").text(f"{folder}/array")
    tables.export_csv(orders.where(part == 2).select(*reversed(BATCH_COLUMNS)).coalesce(1), f"{folder}/turned")
    spark.createDataFrame([(",".join(BATCH_COLUMNS),)], "value string").coalesce(1).write.text(f"{folder}/header")
    broken = orders.where(part == 3).select(F.concat_ws(",", *[F.col(c).cast("string") for c in BATCH_COLUMNS]).alias("value"))
    first = spark.createDataFrame([(",".join(BATCH_COLUMNS),), ("1,2,3,4,5,6,7",)], "value string")
    first.union(broken).coalesce(1).write.text(f"{folder}/broken")
    spark.createDataFrame([("",)], "value string").coalesce(1).write.text(f"{folder}/nothing")
    named = _named_copies(spark, folder, {"lines": "json", "array": "json", "turned": "csv", "header": "csv", "broken": "csv", "nothing": "json"})
    found = files.ingest_batch(spark, named, root, "batch/orders", orders.schema)
    held = spark.read.schema(orders.schema.add("source_file", "string")).parquet(layers.layer_path(root, "bronze", "batch/orders"))
    prints = held.groupBy(F.col("source_file").alias("file")).agg(dataset_fingerprint(*BATCH_COLUMNS).alias("fingerprint"))
    return found.join(prints, "file", "left").select(
        F.split("file", r"\.")[0].alias("source"), "file_type", "row_count", F.col("bad_rows").cast("int").alias("bad_rows"), "status",
        "error", F.coalesce("fingerprint", F.lit(0).cast("decimal(38,0)")).alias("fingerprint"),
    )


def _named_copies(spark, folder, kinds, name_of=str):
    """The part file of each folder under its own name and extension, as a feed would drop it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for name, kind in kinds.items():
        for part in fs.globStatus(path(f"{folder}/{name}/part-*")):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part.getPath(), fs, path(f"{folder}/batch/{name_of(name)}.{kind}"), False, conf)
    return f"{folder}/batch"


# -- tables ----------------------------------------------------------------------------------------


@query("src_full_snapshot", sql_manifest("orders"))
def _(lake):
    root = new_workspace(lake.spark, "full")
    uri, rows = tables.extract_full(_orders(lake), root, "orders.parquet")
    return manifest("orders", lake.spark.read.parquet(uri), rows)


@query(
    "incremental_extract",
    "SELECT id, source_name, status, row_count, updated_at FROM x_ing "
    "WHERE updated_at > TIMESTAMP '1999-06-30 12:00:00'",
)
def _(lake):
    delta = tables.incremental_rows(lake.ingestion, "updated_at", "1999-06-30 12:00:00")
    return delta.select("id", "source_name", "status", "row_count", "updated_at")


@query(
    "incremental_extract_int",
    "SELECT * FROM x_ord WHERE o_orderkey > 9999",
)
def _(lake):
    return tables.incremental_rows(_orders(lake), "o_orderkey", "9999")


@query(
    "incremental_extract_runs",
    """SELECT 'first' AS run, COUNT(*) AS row_count, strftime(MAX(ts), '%Y-%m-%d') AS watermark_day
            FROM events WHERE ts < TIMESTAMP '2024-01-16'
        UNION ALL SELECT 'second', COUNT(*), strftime(MAX(ts), '%Y-%m-%d') FROM events
            WHERE ts >= TIMESTAMP '2024-01-16'
        UNION ALL SELECT 'third', 0, (SELECT strftime(MAX(ts), '%Y-%m-%d') FROM events)""",
)
def _(lake):
    """Three runs over a growing table: everything so far, the delta, then an empty delta."""
    root = new_workspace(lake.spark, "delta")
    source = lake.table("events").select("event_id", "ts")
    early = source.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    rows = []
    for run, df in [("first", early), ("second", source), ("third", source)]:
        done = tables.incremental_run(df, root, f"events/{run}", "events", "ts", f"{root}/marks")
        rows.append((run, done["row_count"], done["watermark"][:10]))
    return lake.spark.createDataFrame(rows, "run string, row_count bigint, watermark_day string")


@query(
    "incremental_extract_rerun",
    f"""SELECT 'events' AS source_name, COUNT(*) AS row_count, {sql_fingerprint(["event_id", "user_id", "props"])} AS fingerprint,
        CAST(1 AS BIGINT) AS marks FROM events""",
)
def _(lake):
    """The same key extracted twice: the second run finds nothing new, and bronze keeps all rows."""
    root = new_workspace(lake.spark, "rerun")
    source = lake.table("events")
    for _ in range(2):
        tables.incremental_run(source, root, "events", "events", "ts", f"{root}/marks")
    columns = ["event_id", "user_id", "props"]
    held = lake.spark.read.parquet(layers.layer_path(root, "bronze", "events"))
    marks = lake.spark.read.parquet(f"{root}/marks").agg(F.count("*")).scalar()
    return held.agg(F.count("*").alias("row_count"), dataset_fingerprint(*columns).alias("fingerprint")).select(
        F.lit("events").alias("source_name"), "row_count", "fingerprint", marks.alias("marks")
    )


@query(
    "ledger_of_runs",
    """SELECT 'csv' AS source_name, 'success' AS status, COUNT(*) AS row_count, false AS has_error FROM orders
        UNION ALL SELECT 'broken', 'failed', NULL, true
        UNION ALL SELECT 'extract', 'success', COUNT(*), false FROM events
        UNION ALL SELECT 'load', 'success', COUNT(*), false FROM orders""",
)
def _(lake):
    """What the ledger holds after a good file, a broken one, an extract and a load."""
    root, spark = new_workspace(lake.spark, "ledger"), lake.spark
    log, history = f"{root}/ledger", f"{root}/schemas"
    orders = _orders(lake)
    tables.export_csv(orders, f"{root}/in")
    how = {"kind": "csv", "schema": orders.schema, **TEXT}
    done = files.ingest_logged(spark, f"{root}/in", root, "orders.csv", log, history, "r1", "csv", "2024-01-31", **how)
    spark.createDataFrame([("o_orderkey,o_custkey",), ("x,y",)], "value string").coalesce(1).write.text(f"{root}/broken")
    try:
        files.ingest_logged(spark, f"{root}/broken", root, "broken.csv", log, history, "r2", "broken", "2024-01-31", **how)
    except files.IngestionError:
        pass  # in the ledger
    events = lake.table("events")
    ledger.logged(spark, log, "r3", "extract", lambda: tables.incremental_run(events, root, "events", "events", "ts", f"{root}/marks"))
    ledger.logged(spark, log, "r4", "load", lambda: {"row_count": tables.load_parquet(spark, done.uri, f"{root}/warehouse/orders")})
    runs = ledger.current_runs(spark.read.parquet(log))
    return runs.select("source_name", "status", "row_count", F.col("error_message").isNotNull().alias("has_error"))


@query(
    "param_sql",
    """SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders
        WHERE o_orderstatus = 'F' AND o_totalprice > 400000""",
)
def _(lake):
    return lake.spark.sql(
        "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice "
        "FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :floor",
        args={"status": "F", "floor": 400000},
        orders=lake.orders,
    )


@query(
    "custom_query_extract",
    """SELECT 'custom_query:SELECT * FROM recent_orders#' || left(md5('SELECT * FROM recent_orders'), 12) AS source_name,
        COUNT(*) AS row_count FROM x_orders o JOIN x_customers c ON o.customer_id = c.customer_id
        WHERE order_date >= DATE '1998-01-01'""",
)
def _(lake):
    """A query's result written to bronze, under its default source name."""
    root = new_workspace(lake.spark, "query")
    customers.orders_with_customers(
        lake.stg_orders, lake.stg_customers, "1998-01-01"
    ).createOrReplaceTempView("recent_orders")
    done = tables.extract_query(lake.spark, "SELECT * FROM recent_orders", root, "recent.parquet")
    out = lake.spark.read.parquet(done["uri"]).agg(F.count("*").alias("row_count"))
    return out.select(F.lit(done["source_name"]).alias("source_name"), "row_count")


@query("load_replace", sql_manifest("orders"))
def _(lake):
    root = new_workspace(lake.spark, "load")
    uri, _rows = tables.extract_full(_orders(lake), root, "orders.parquet")
    target = f"{root}/warehouse/orders"
    for _ in range(2):
        tables.load_parquet(lake.spark, uri, target, "replace")
    return manifest("orders", lake.spark.read.parquet(target))


@query(
    "load_append",
    f"""SELECT 'orders' AS source_name, 2 * COUNT(*) AS row_count,
        CAST(2 * {sql_fingerprint(ORDER_COLUMNS)} AS DECIMAL(38,0)) AS fingerprint FROM x_ord""",
)
def _(lake):
    root = new_workspace(lake.spark, "load")
    uri, _rows = tables.extract_full(_orders(lake), root, "orders.parquet")
    target = f"{root}/warehouse/orders"
    for _ in range(2):
        tables.load_parquet(lake.spark, uri, target, "append")
    return manifest("orders", lake.spark.read.parquet(target))


@query("load_incremental_skip", sql_manifest("orders"))
def _(lake):
    """The second load offers all objects again; those in the ledger are skipped."""
    root = new_workspace(lake.spark, "skip")
    objects = _orders(lake).withColumn(
        "object_key", F.concat(F.lit("part_"), (F.col("o_orderkey") % 8).cast("string"))
    )
    first = objects.where(F.col("o_orderkey") % 8 < 5)
    tables.load_new_objects(lake.spark, first, f"{root}/ledger", f"{root}/orders")
    tables.load_new_objects(lake.spark, objects, f"{root}/ledger", f"{root}/orders")
    return manifest("orders", lake.spark.read.parquet(f"{root}/orders"))


@query(
    "dataset_fingerprint",
    f"""SELECT 'customer' AS dataset, COUNT(*) AS row_count,
            {sql_fingerprint(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])} AS fingerprint FROM customer
        UNION ALL SELECT 'orders', COUNT(*), {sql_fingerprint(ORDER_COLUMNS)} FROM x_ord
        UNION ALL SELECT 'events', COUNT(*),
            {sql_fingerprint(["event_id", "user_id", "event_type", "CAST(value AS DECIMAL(18,2))",
                              "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "props"])} FROM events""",
)
def _(lake):
    events = lake.table("events").withColumns(
        {"value": F.col("value").cast("decimal(18,2)"), "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")}
    )
    wanted = {
        "customer": (lake.table("customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
        "orders": (_orders(lake), ORDER_COLUMNS),
        "events": (events, ["event_id", "user_id", "event_type", "value", "ts", "props"]),
    }
    out = None
    for name, (df, columns) in wanted.items():
        one = df.agg(
            F.count("*").alias("row_count"), dataset_fingerprint(*columns).alias("fingerprint")
        )
        one = one.select(F.lit(name).alias("dataset"), "row_count", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "file_checksums",
    """WITH f AS (SELECT o_orderstatus, string_agg(o_orderkey, chr(10) ORDER BY o_orderkey) || chr(10) AS body FROM orders GROUP BY 1)
        SELECT 'o_orderstatus=' || o_orderstatus AS folder, CAST(strlen(body) AS BIGINT) AS size_bytes, md5(body) AS md5, sha256(body) AS sha256 FROM f""",
)
def _(lake):
    """md5 and sha256 of files whose bytes are known: the order keys of each status, in order."""
    root = new_workspace(lake.spark, "sums")
    keys = lake.orders.select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value"), "o_orderkey")
    keys = keys.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").drop("o_orderkey")
    keys.write.partitionBy("o_orderstatus").text(f"{root}/keys")
    return files.file_checksums(lake.spark, f"{root}/keys").select("folder", "size_bytes", "md5", "sha256")


@query(
    "partitioned_daily",
    """SELECT CAST(year(transaction_timestamp) AS INTEGER) AS year,
        CAST(month(transaction_timestamp) AS INTEGER) AS month,
        CAST(day(transaction_timestamp) AS INTEGER) AS day, COUNT(*) AS transactions,
        CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount FROM x_stg GROUP BY 1, 2, 3""",
)
def _(lake):
    """Staged transactions in a year= / month= / day= layout, read back by partition."""
    root = new_workspace(lake.spark, "daily")
    target = layers.layer_path(root, "gold", "transactions")
    tables.write_daily_partitions(lake.stg, "transaction_timestamp", target)
    total = F.sum("amount").cast("decimal(28,2)")
    return (
        lake.spark.read.parquet(target)
        .groupBy("year", "month", "day")
        .agg(F.count("*").alias("transactions"), total.alias("total_amount"))
    )


@query("export_csv", sql_manifest("orders", "o_orderstatus = 'F'"))
def _(lake):
    root = new_workspace(lake.spark, "export")
    tables.export_csv(_orders(lake).where("o_orderstatus = 'F'"), f"{root}/csv")
    back = files.read_csv(lake.spark, f"{root}/csv", _orders(lake).schema, **TEXT)
    return manifest("orders", back)


@query(
    "seed_currency_ref",
    """SELECT currency, CASE currency WHEN 'USD' THEN 'US Dollar' WHEN 'EUR' THEN 'Euro' ELSE 'Pound Sterling'
        END AS currency_name, COUNT(*) AS transactions, CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount
        FROM x_stg GROUP BY 1, 2""",
)
def _(lake):
    """A seed table joined to the facts after they are reduced to one row per currency."""
    seed = lake.spark.createDataFrame(
        [("USD", "US Dollar"), ("EUR", "Euro"), ("GBP", "Pound Sterling")],
        "currency string, currency_name string",
    )
    used = lake.stg.groupBy("currency").agg(
        F.count("*").alias("transactions"), F.sum("amount").cast("decimal(28,2)").alias("total_amount")
    )
    return used.join(seed, "currency", "left").select(
        "currency", "currency_name", "transactions", "total_amount"
    )


@query(
    "scd2_snapshot",
    """WITH v AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day,
            arg_max(o_orderpriority, o_orderkey) AS tier FROM orders GROUP BY 1, 2),
        c AS (SELECT *, lag(tier) OVER (PARTITION BY customer_id ORDER BY day) AS before FROM v),
        s AS (SELECT customer_id, tier, day AS valid_from FROM c WHERE tier IS DISTINCT FROM before)
        SELECT customer_id, tier, valid_from,
            lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) AS valid_to,
            lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) IS NULL AS is_current
        FROM s""",
)
def _(lake):
    versions = lake.orders.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("tier"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderkey",
    )
    return slowly_changing(versions, ["customer_id"], ["tier"], "day", ["o_orderkey"])


@query(
    "scd2_apply",
    """WITH v AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day,
            arg_max(o_orderpriority, o_orderkey) AS tier FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1, 2),
        c AS (SELECT *, lag(tier) OVER (PARTITION BY customer_id ORDER BY day) AS before FROM v),
        s AS (SELECT customer_id, tier, day AS valid_from,
            lead(day) OVER (PARTITION BY customer_id ORDER BY day) AS valid_to FROM c WHERE tier IS DISTINCT FROM before),
        n AS (SELECT o_custkey AS customer_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS tier FROM orders
            WHERE o_orderdate >= '1997-07-01' GROUP BY 1),
        h AS (SELECT s.*, n.tier AS now FROM s LEFT JOIN n USING (customer_id))
        SELECT customer_id, tier, valid_from,
            coalesce(valid_to, CASE WHEN now <> tier THEN DATE '1999-01-01' END) AS valid_to,
            valid_to IS NULL AND (now IS NULL OR now = tier) AS is_current FROM h
        UNION ALL SELECT customer_id, n.tier, DATE '1999-01-01', NULL, true FROM n LEFT JOIN
            (SELECT customer_id, tier FROM s WHERE valid_to IS NULL) o USING (customer_id) WHERE o.tier IS DISTINCT FROM n.tier""",
)
def _(lake):
    """A history up to 1997 with a later snapshot folded in: ranges closed, opened and kept."""
    rows = lake.orders.select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("tier"),
        F.to_date("o_orderdate").alias("day"), "o_orderkey",
    )
    before = slowly_changing(rows.where("day < '1998-01-01'"), ["customer_id"], ["tier"], "day", ["o_orderkey"])
    newest = rows.where("day >= '1997-07-01'").groupBy("customer_id").agg(F.max_by("tier", F.struct("day", "o_orderkey")).alias("tier"))
    return apply_snapshot(before, newest, ["customer_id"], ["tier"], "1999-01-01")


@query(
    "file_date_partition",
    """SELECT 'orders' AS dataset, make_date(year(o_orderdate), 1, 31) AS file_date, COUNT(*) AS orders FROM orders GROUP BY 1, 2""",
)
def _(lake):
    """Files whose names carry a date, read as a dataset with that date."""
    root, spark = new_workspace(lake.spark, "dated"), lake.spark
    years = lake.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    years.repartition("year").write.partitionBy("year").parquet(f"{root}/by")
    found = [r["year"] for r in spark.read.parquet(f"{root}/by").select("year").distinct().collect()]
    folder = _named_copies(spark, f"{root}/by", {f"year={y}": "parquet" for y in found}, lambda n: f"orders_{n[5:]}0131")
    name, day = layers.file_date_partition()
    rows = spark.read.parquet(folder).select(name.alias("dataset"), day.alias("file_date"))
    return rows.groupBy("dataset", "file_date").agg(F.count("*").alias("orders"))


# -- layers ----------------------------------------------------------------------------------------


def _three_layers(lake, label):
    """Orders by status in bronze and silver, a daily report in gold."""
    root = new_workspace(lake.spark, label)
    orders = _orders(lake).withColumn("status", F.col("o_orderstatus"))
    orders.write.partitionBy("status").parquet(layers.layer_path(root, "bronze", "sales/orders"))
    kept = lake.spark.read.parquet(layers.layer_path(root, "bronze", "sales/orders"))
    kept.write.partitionBy("status").parquet(layers.layer_path(root, "silver", "sales/orders"))
    daily = sales.daily_orders(lake.stg_orders)
    daily.write.parquet(layers.layer_path(root, "gold", "reports/daily_orders"))
    return root


@query(
    "layer_listing",
    "SELECT 'sales/orders/status=' || o_orderstatus AS folder, COUNT(*) AS row_count, true AS has_objects FROM orders GROUP BY 1",
)
def _(lake):
    """The folders of a layer below a prefix, from its listing, with the rows each one holds."""
    root = _three_layers(lake, "listing")
    listed = layers.list_layer(lake.spark, root, "bronze", "sales/").where(F.col("object_key").endswith(".parquet"))
    folder = F.regexp_replace("object_key", "/[^/]*$", "")
    listed = listed.groupBy(folder.alias("folder")).agg((F.count("*") > 0).alias("has_objects"))
    held = lake.spark.read.parquet(layers.layer_path(root, "bronze", "sales/orders"))
    held = held.groupBy(F.concat(F.lit("sales/orders/status="), "status").alias("folder")).agg(F.count("*").alias("row_count"))
    return held.join(listed, "folder", "full").select("folder", "row_count", "has_objects")


@query("promote_layer", sql_manifest("orders"))
def _(lake):
    root = _three_layers(lake, "promote")
    path = layers.promote(lake.spark, root, "sales/orders", "silver", "gold", "copies/orders")
    return manifest("orders", lake.spark.read.parquet(path))


@query(
    "layer_size_summary",
    """SELECT layer, n <= COUNT(DISTINCT o_orderstatus) OR layer <> 'gold' AS has_objects, true AS has_bytes
        FROM orders, (VALUES ('bronze', 1), ('silver', 1), ('gold', 1)) AS l(layer, n) GROUP BY layer, n""",
)
def _(lake):
    """Every layer has objects, at least one for each folder written, and bytes."""
    root = _three_layers(lake, "sizes")
    found = layers.layer_sizes(layers.list_objects(lake.spark, root))
    folders = lake.orders.agg(F.countDistinct("o_orderstatus")).scalar()
    least = F.when(F.col("layer") == "gold", F.lit(1)).otherwise(folders)
    return found.select("layer", (F.col("object_count") >= least).alias("has_objects"), (F.col("total_bytes") > 0).alias("has_bytes"))


@query(
    "layer_prefix_summary",
    "SELECT * FROM (VALUES ('bronze', 'sales', true), ('silver', 'sales', true), ('gold', 'reports', true)) AS t(layer, prefix, has_objects)",
)
def _(lake):
    root = _three_layers(lake, "prefixes")
    found = layers.layer_prefixes(layers.list_objects(lake.spark, root))
    return found.where("prefix <> ''").select("layer", "prefix", (F.col("object_count") > 0).alias("has_objects"))


@query(
    "verify_layers",
    "SELECT layer, COUNT(o_orderkey) > 0 AS verified FROM orders, (VALUES ('bronze'), ('silver'), ('gold')) AS l(layer) GROUP BY layer",
)
def _(lake):
    root = _three_layers(lake, "verify")
    keys = {"bronze": "sales/orders", "silver": "sales/orders", "gold": "reports/daily_orders"}
    return layers.verify_layers(lake.spark, root, keys).select("layer", (F.col("object_count") > 0).alias("verified"))


@query("table_ready", "SELECT 'orders' AS table_name, COUNT(*) >= 100 AS ready FROM orders")
def _(lake):
    ready = layers.table_ready(lake.orders, 100)
    return lake.spark.createDataFrame([("orders", ready)], "table_name string, ready boolean")


# -- schemas ---------------------------------------------------------------------------------------


def _schema_sql(source, columns):
    rows = "UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS portable_type, "
        f"(SELECT bool_or({c} IS NULL) FROM {source}) AS nullable "
        for i, (c, t) in enumerate(columns)
    )
    size = f"(SELECT COUNT(*) FROM {source})"
    return f"SELECT *, {size} AS sample_rows, {size} AS row_count FROM ({rows})"


ORDER_TYPES = [
    ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
    ("o_orderdate", "timestamp"), ("o_seen", "timestamp"), ("o_orderpriority", "string"), ("o_note", "string"), ("late", "integer"),
]
EVENT_TYPES = [
    ("event_id", "integer"), ("event_type", "string"), ("late", "string"), ("props", "string"), ("ts", "string"),
    ("user_id", "integer"), ("value", "float"),
]
LATE_SQL = "SELECT *, CASE WHEN {0} < (SELECT MAX({0}) FROM {1}) THEN {2} END AS late FROM {1}"


def _with_late(df, key, value):
    """A column that is null in the last row only: any sample of the first rows would miss it."""
    last = df.agg(F.max(key)).scalar()
    return df.withColumn("late", F.when(F.col(key) < last, value)).orderBy(key)


@query("detect_schema_csv", _schema_sql("(" + LATE_SQL.format("o_orderkey", "x_ord", "o_custkey") + ")", ORDER_TYPES))
def _(lake):
    root = new_workspace(lake.spark, "schema-csv")
    tables.export_csv(_with_late(_orders(lake), "o_orderkey", F.col("o_custkey")), root)
    return schemas.detect_schema(files.read_csv(lake.spark, root, **TEXT))


@query("detect_schema_json", _schema_sql("(" + LATE_SQL.format("event_id", "events", "event_type") + ")", EVENT_TYPES))
def _(lake):
    root = new_workspace(lake.spark, "schema-json")
    _with_late(lake.table("events"), "event_id", F.col("event_type")).write.json(root)
    return schemas.detect_schema(files.read_json(lake.spark, root))


# Twenty groups of files whose columns change type: numbers, text, objects; some records are broken.
TYPES_SQL = """WITH r AS (SELECT event_id % 20 AS part, event_id % 97 = 0 AS bad, event_id // 20 % 2 AS half FROM events),
    c AS (SELECT part, 'id' AS k, 'integer' AS t FROM r WHERE NOT bad
        UNION ALL SELECT part, 'amount', CASE WHEN part < 5 THEN 'integer' WHEN part < 10 THEN 'float'
            WHEN part < 15 OR half = 1 THEN 'string' ELSE 'integer' END FROM r WHERE NOT bad
        UNION ALL SELECT part, 'props', CASE WHEN part % 2 = 0 THEN 'object integer' ELSE 'object string' END FROM r WHERE NOT bad
        UNION ALL SELECT part, 'late', CASE WHEN half = 0 THEN 'null' ELSE 'string' END FROM r WHERE NOT bad AND part % 5 = 0),
    g AS (SELECT part, k, COUNT(*) FILTER (t <> 'null') AS present, list_sort(list(DISTINCT t) FILTER (t <> 'null')) AS ts
        FROM c GROUP BY GROUPING SETS ((part, k), (k))),
    w AS (SELECT part, k, present, CASE WHEN coalesce(len(ts), 0) = 0 THEN 'null' WHEN len(ts) = 1 THEN ts[1]
        WHEN ts = ['float', 'integer'] THEN 'float' WHEN ts[1] LIKE 'object%' THEN 'object mixed' ELSE 'mixed' END AS t FROM g)"""


def _typed_files(lake):
    """JSON lines of the events, in one folder for each of twenty groups."""
    part, half = F.col("event_id") % 20, F.expr("event_id div 20 % 2")
    number, quoted = F.col("user_id").cast("string"), F.concat(F.lit('"t'), F.col("user_id").cast("string"), F.lit('"'))
    amount = (
        F.when(part < 5, number).when(part < 10, F.concat(number, F.lit(".5"))).when((part < 15) | (half == 1), quoted).otherwise(number)
    )
    late = F.when(part % 5 > 0, "").when(half == 0, ', "late": null').otherwise(', "late": "y"')
    inner = F.when(part % 2 == 0, number).otherwise(quoted)
    line = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "amount": '), amount, F.lit(', "props": {"p": '), inner, F.lit("}"), late, F.lit("}")
    )
    value = F.when(F.col("event_id") % 97 == 0, '{"id": ').otherwise(line)
    root = new_workspace(lake.spark, "json-types")
    lake.table("events").select(part.alias("part"), value.alias("value")).write.partitionBy("part").text(root)
    lines = files.text_lines(lake.spark, root).select(F.regexp_extract("file", "part=([0-9]+)", 1).alias("file"), "value")
    return json_types.type_counts(lines)


@query(
    "json_types_merged",
    TYPES_SQL + """ SELECT k AS column_name, CASE WHEN t = 'mixed' THEN 'string' ELSE split_part(t, ' ', 1) END AS portable_type,
        present, present < (SELECT COUNT(*) FROM r WHERE NOT bad) AS nullable FROM w WHERE part IS NULL""",
)
def _(lake):
    """Columns of mixed JSON files with the type that holds all their values."""
    return json_types.merged_types(_typed_files(lake)).drop("variant_type")


@query(
    "json_types_drift",
    TYPES_SQL + """, d AS (SELECT o.part, COUNT(*) AS columns, COUNT(*) FILTER (o.t <> a.t AND o.t <> 'null') AS widened
            FROM w o JOIN w a ON o.k = a.k AND a.part IS NULL WHERE o.part IS NOT NULL GROUP BY 1),
        n AS (SELECT part, COUNT(*) AS records, COUNT(*) FILTER (bad) AS bad_rows FROM r GROUP BY 1),
        m AS (SELECT *, (SELECT COUNT(*) FROM w WHERE part IS NULL) - coalesce(columns, 0) AS missing FROM n LEFT JOIN d USING (part))
        SELECT CAST(part AS VARCHAR) AS file, records, bad_rows, coalesce(columns, 0) AS columns, missing, coalesce(widened, 0) AS widened,
            missing > 0 OR coalesce(widened, 0) > 0 AS drifted FROM m""",
)
def _(lake):
    """Columns that each group of JSON files lacks or has with a narrower type than all files together."""
    return json_types.drift_by_file(_typed_files(lake))


TABLE_TYPES = [
    ("event_id", "integer"), ("ts", "timestamp"), ("user_id", "integer"), ("event_type", "string"), ("value", "float"), ("props", "string"),
]


@query("detect_schema_table", _schema_sql("events", TABLE_TYPES))
def _(lake):
    return schemas.detect_schema(lake.table("events").select(*[c for c, _ in TABLE_TYPES]))


@query(
    "log_schema",
    """SELECT 'orders' AS source_name, 6 AS column_count, COUNT(*) AS row_count FROM orders
        UNION ALL SELECT 'lineitem', 11, COUNT(*) FROM lineitem
        UNION ALL SELECT 'events', 6, COUNT(*) FROM events""",
)
def _(lake):
    """Schemas of the given tables appended to the history, read back."""
    path = new_workspace(lake.spark, "schema-log")
    for name in ("orders", "lineitem", "events"):
        df = lake.table(name)
        columns = schemas.describe_schema(df.schema)
        row = schemas.schema_change_row(lake.spark, name, columns, "2024-01-31", None)
        counted = row.withColumn("row_count", df.agg(F.count("*")).scalar())
        counted.write.mode("append").parquet(path)
    return ledger.column_counts(lake.spark.read.parquet(path)).select(
        "source_name", "column_count", "row_count"
    )


@query(
    "schema_drift",
    """WITH d AS (SELECT source_name, execution_date,
            CAST(arg_max(k, (created_at, id)) % 7 + 1 AS INTEGER) AS column_count, COUNT(*) AS detections
            FROM x_hist GROUP BY 1, 2),
        l AS (SELECT *, lag(column_count) OVER (PARTITION BY source_name ORDER BY execution_date)
            AS previous_count FROM d)
        SELECT *, coalesce(column_count <> previous_count, false) AS drifted FROM l""",
)
def _(lake):
    return ledger.schema_drift(lake.schema_history)


@query(
    "schema_column_counts",
    """SELECT source_name, execution_date, id, CAST(k % 7 + 1 AS INTEGER) AS column_count FROM x_hist""",
)
def _(lake):
    return ledger.column_counts(lake.schema_history).select(
        "source_name", "execution_date", "id", "column_count"
    )


@query(
    "schema_history_source",
    """SELECT id, source_name, schema_metadata, execution_date, created_at FROM x_hist
        WHERE source_name = 'feed_3'""",
)
def _(lake):
    return ledger.schema_history_of(lake.schema_history, "feed_3")


# -- ledgers and watermarks --------------------------------------------------------------------------


@query(
    "run_ledger_current",
    """SELECT id AS run_id, source_name, status, CASE WHEN status = 'success' THEN row_count END AS row_count,
        error_message, CASE WHEN status = 'running' THEN created_at ELSE updated_at END AS updated_at
        FROM x_ing""",
)
def _(lake):
    return ledger.current_runs(lake.run_events)


@query(
    "last_successful_run",
    """SELECT source_name, id, execution_date, row_count, created_at FROM (SELECT *, row_number() OVER
        (PARTITION BY source_name ORDER BY created_at DESC, id DESC) AS rn FROM x_ing
        WHERE status = 'success') WHERE rn = 1""",
)
def _(lake):
    return ledger.last_successful_runs(lake.ingestion)


@query(
    "stg_ingestion_metadata",
    """SELECT id AS ingestion_id, source_name, source_type, execution_date, row_count, file_size_bytes,
        checksum, status, error_message, created_at, updated_at FROM x_ing""",
)
def _(lake):
    return ledger.stage_ledger(lake.ingestion)


@query(
    "recent_successes",
    """SELECT id, source_name, execution_date, row_count, created_at FROM x_ing WHERE status = 'success'
        ORDER BY created_at DESC, id DESC LIMIT 20""",
)
def _(lake):
    return ledger.recent_successes(lake.ingestion)


@query(
    "failed_ingestions",
    """SELECT id, source_name, execution_date, error_message, created_at FROM x_ing
        WHERE status = 'failed'""",
)
def _(lake):
    return ledger.failed_runs(lake.ingestion)


@query(
    "daily_ingestion_summary",
    """SELECT execution_date, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE status = 'success') AS successful,
        COUNT(*) FILTER (WHERE status = 'failed') AS failed, CAST(SUM(row_count) AS BIGINT) AS total_rows
        FROM x_ing GROUP BY 1""",
)
def _(lake):
    return ledger.daily_ingestion(lake.ingestion)


@query(
    "recent_runs",
    """SELECT id, source_name, status, execution_date, updated_at FROM x_ing
        ORDER BY updated_at DESC, id DESC LIMIT 20""",
)
def _(lake):
    return ledger.recent_runs(lake.ingestion)


@query("watermark_lookup", ALL + "x_wm_now WHERE source_name = 'src_7'")
def _(lake):
    marks = lake.watermark_ledger.where(F.col("source_name") == "src_7")
    return watermarks.current_watermarks(marks)


@query("watermark_upsert", ALL + "x_wm_now")
def _(lake):
    """Marks up to 1998 as the stored state, the later ones as upserts on top."""
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    old = lake.watermark_ledger.where(F.col("updated_at") < cut)
    new = lake.watermark_ledger.where(F.col("updated_at") >= cut)
    return watermarks.upsert_watermarks(watermarks.current_watermarks(old), new)


@query("stg_watermarks", ALL + "x_wm")
def _(lake):
    return watermarks.stage_watermarks(lake.watermark_ledger)


@query("watermarks_current", ALL + "x_wm_now ORDER BY updated_at DESC, source_name, watermark_column")
def _(lake):
    return watermarks.newest_watermarks(watermarks.current_watermarks(lake.watermark_ledger))


@query(
    "watermark_reset",
    """SELECT source_name, watermark_column, watermark_value, watermark_type, updated_at FROM x_wm_now
        WHERE source_name <> 'src_3' AND source_name <> 'src_4'
        UNION ALL SELECT 'src_4', 'updated_at', '1995-01-01 00:00:00', 'timestamp',
            TIMESTAMP '2024-01-31 00:00:00'""",
)
def _(lake):
    """One mark deleted, one moved back; the others stay."""
    gone = watermarks.reset_row(lake.spark, "src_3", "updated_at", None)
    at = F.lit(EVENTS_NOW).cast("timestamp_ntz")
    gone = gone.withColumn("updated_at", at)
    back = watermarks.reset_row(lake.spark, "src_4", "updated_at", None, "1995-01-01 00:00:00")
    back = back.withColumn("updated_at", at)
    return watermarks.current_watermarks(
        lake.watermark_ledger.unionByName(gone).unionByName(back)
    )
