"""Schema detection and description in portable type names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def portable_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "string"


def describe_schema(schema: T.StructType) -> list[dict]:
    return [
        {"name": f.name, "type": portable_type(f.dataType), "nullable": f.nullable}
        for f in schema.fields
    ]


def schema_json(columns: list[dict], row_count: int | None = None) -> str:
    return json.dumps({"columns": columns, "row_count": row_count})


def detect_schema(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row per column: position, portable type, whether a null was seen, row counts.

    Nulls are counted over all rows; only a caller that asks for ``sample_rows`` gets a preview of so
    many, whose nullability is that of the preview. ``row_count`` always counts the whole input.
    """
    fields = df.schema.fields
    sample = df if sample_rows is None else df.limit(sample_rows)
    has_null = [F.max(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(fields)]
    seen = sample.agg(F.count("*").alias("sample_rows"), *has_null)
    if sample_rows is None:
        seen = seen.withColumn("row_count", F.col("sample_rows"))
    else:
        seen = seen.withColumn("row_count", df.agg(F.count("*")).scalar())
    columns = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(portable_type(f.dataType)).alias("portable_type"),
                F.coalesce(F.col(f"n{i}"), F.lit(False)).alias("nullable"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return seen.select(F.explode(columns).alias("c"), "sample_rows", "row_count").select(
        "c.*", "sample_rows", "row_count"
    )


def table_schema(spark: SparkSession, name: str) -> list[dict]:
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no such table: {name}")
    return describe_schema(spark.table(name).schema)


def schema_change_row(spark: SparkSession, source, columns, execution_date, created_at) -> DataFrame:
    """A schema_history row, ready to append."""
    return spark.createDataFrame(
        [(source, schema_json(columns), execution_date, created_at)],
        "source_name string, schema_metadata string, execution_date string, created_at timestamp_ntz",
    )


def schema_of_frames(frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Column catalog of registered tables; one row per column, built from the plans alone."""
    rows = [
        (layer, table, i + 1, f.name, f.dataType.simpleString(), portable_type(f.dataType))
        for (layer, table), df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "schema_name string, table_name string, position int, column_name string, "
        "data_type string, portable_type string",
    )
