"""Table extracts, loads and sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orefield.operators import watermarks
from orefield.sources.files import write_counted
from orefield.sources.layers import layer_path, path_exists

SOURCE_NAME_LENGTH = 80


class ExtractError(Exception):
    """An extract or load could not run."""


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **options,
) -> DataFrame:
    """A database table; with a partition column it is read by ``partitions`` parallel queries."""
    conf = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **options}
    if partition_column:
        if not bounds:
            raise ExtractError("a partitioned read needs the column's bounds")
        conf.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return spark.read.format("jdbc").options(**conf).load()


def jdbc_sink(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options):
    conf = {"url": url, "dbtable": table, "batchsize": str(batch), **options}
    df.write.format("jdbc").mode(_save_mode(mode)).options(**conf).save()


def newer_than(column: str, value: str | None, dtype: str) -> Column | None:
    """Strict high-water predicate with a typed literal, None where there is no mark yet.

    The literal is cast, not the column, so the comparison is pushed into the scan and integer
    marks never compare as text.
    """
    return None if value is None else F.col(column) > F.lit(value).cast(dtype)


def incremental_rows(df: DataFrame, column: str, value: str | None, dtype: str | None = None) -> DataFrame:
    dtype = dtype or df.schema[column].dataType.simpleString()
    predicate = newer_than(column, value, dtype)
    return df if predicate is None else df.where(predicate)


def extract_full(df: DataFrame, root: str, key: str) -> tuple[str, int]:
    target = layer_path(root, "bronze", key)
    return target, write_counted(df, target)["row_count"]


def extract_incremental(
    df: DataFrame, root: str, key: str, column: str, value: str | None
) -> dict:
    """Write the delta below ``key`` in a folder named after the mark it starts from.

    Row count and new mark are observed by the write itself. When nothing is new, nothing is written,
    ``uri`` is None and the mark stays. The caller saves the mark after this returns, so a lost run is
    repeated onto its own folder, and a later run with the same key never touches it.
    """
    delta = incremental_rows(df, column, value)
    if delta.isEmpty():
        return {"uri": None, "row_count": 0, "watermark": value}
    since = "start" if value is None else "".join(c if c.isalnum() else "-" for c in value)
    target = f"{layer_path(root, 'bronze', key)}/since={since}"
    seen = write_counted(delta, target, mark=F.max(column).cast("string"))
    return {"uri": target, "row_count": seen["row_count"], "watermark": seen["mark"]}


def incremental_run(
    df: DataFrame, root: str, key: str, source: str, column: str, marks_path: str
) -> dict:
    """Extract what is newer than the stored mark, then append the new mark.

    The mark is written last: a run lost before that is repeated from the old mark onto the same
    folder, so nothing is missed and nothing is loaded twice; a run without new rows writes nothing.
    """
    spark = df.sparkSession
    mark = None
    if path_exists(spark, marks_path):
        mark = watermarks.lookup(spark.read.parquet(marks_path), source, column)
    done = extract_incremental(df, root, key, column, mark)
    if done["row_count"]:
        kind = df.schema[column].dataType.simpleString()
        row = watermarks.watermark_row(spark, source, column, done["watermark"], kind, None)
        now = F.current_timestamp().cast("timestamp_ntz")
        row.withColumn("updated_at", now).write.mode("append").parquet(marks_path)
    return done


def query_name(query: str) -> str:
    """The default source name: the query's beginning, and a digest that tells equal beginnings apart."""
    digest = hashlib.md5(query.encode()).hexdigest()[:12]
    return f"custom_query:{query[:SOURCE_NAME_LENGTH]}#{digest}"


def extract_query(spark: SparkSession, query: str, root: str, key: str, args=None, name=None) -> dict:
    df = spark.sql(query, args=args) if args else spark.sql(query)
    uri, rows = extract_full(df, root, key)
    source = name or query_name(query)
    return {"uri": uri, "row_count": rows, "source_name": source}


def _save_mode(mode: str) -> str:
    modes = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}
    if mode not in modes:
        raise ExtractError(f"unknown load mode: {mode}")
    return modes[mode]


def load_parquet(spark: SparkSession, path: str, target: str, mode: str = "replace") -> int:
    """Bronze Parquet into a warehouse table path; empty input writes nothing and returns 0."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        return 0
    return bulk_insert(df, target, mode)


def bulk_insert(df: DataFrame, target: str, mode: str = "append") -> int:
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("row_count"))
    writer = counted.write.mode(_save_mode(mode))
    if mode == "replace":
        # A load replaces the table, not only the partitions it carries.
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(target)
    return seen.get["row_count"]


def objects_to_load(objects: DataFrame, load_ledger: DataFrame) -> DataFrame:
    """Objects the ledger does not list as loaded (the skip rule of the incremental load)."""
    loaded = load_ledger.where(F.col("status") == "success").select("object_key").distinct()
    return objects.join(loaded, "object_key", "left_anti")


def load_new_objects(
    spark: SparkSession, objects: DataFrame, ledger_path: str, target: str
) -> None:
    """Append rows of objects not loaded before and note them in the ledger.

    ``objects`` carries object_key and the rows; target files are partitioned by object key, so a
    run that died between the two writes is repeated onto the same partitions.
    """
    if path_exists(spark, ledger_path):
        objects = objects_to_load(objects, spark.read.parquet(ledger_path))
    # Rows are gathered by object: few files each, and the hint lets AQE split a large object.
    (
        objects.hint("rebalance", "object_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("object_key")
        .parquet(target)
    )
    # Row counts come from the new folders' footers; what the ledger lists is not counted again.
    held = spark.read.parquet(target)
    if path_exists(spark, ledger_path):
        held = objects_to_load(held.select("object_key"), spark.read.parquet(ledger_path))
    held = held.groupBy("object_key").agg(F.count("*").alias("row_count"))
    held.withColumn("status", F.lit("success")).write.mode("append").parquet(ledger_path)


def write_daily_partitions(df: DataFrame, day, path: str, codec: str = "zstd") -> None:
    """Hive-style year= / month= / day= folders.

    Rows are gathered by day so that a day is a few large files; the rebalance hint lets AQE split
    a day too big for one task and merge the small ones.
    """
    parts = df.withColumns(
        {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    )
    (
        parts.hint("rebalance", "year", "month", "day")
        .write.mode("overwrite")
        .option("compression", codec)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "day")
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str, **options) -> None:
    """Quotes are doubled inside quoted text, so that any text comes back as it was."""
    df.write.mode("overwrite").options(**{"header": True, "escape": '"', **options}).csv(path)
